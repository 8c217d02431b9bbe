"""Secret scans over every historical version of a path, with a ledger of what was scanned before.

A version's text is a blob, addressed by its SHA-256. The ledger is a Parquet table with one row per blob and set of
rule versions that were run on it, findings or not. A scan looks only at pairs of blob and rule version that are not
there, appends them, and joins the findings of all pairs back to every path that ever held the blob. A changed
pattern has another version, so it is run again on all blobs, the others are not.

Defined cases: a null text is the empty blob; repeated rows each get their result; a null path is kept; an empty
history gives no rows and writes an empty ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import utf8
from plumbline.session import cut

SPAN = "struct<start:int,rank:int,end:int,kind:string,version:string>"
LEDGER = f"blob binary, scanned array<string>, found array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``needles``: lower-case pieces of which a matching text holds one; texts without are not searched.
    """

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1
    needles: tuple[bytes, ...] = ()

    @property
    def version(self) -> str:
        return self.kind + "-" + hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]


#: the three base rules, whose patterns and lengths are fixed by the contract
BASE_RULES = (
    Rule(
        "assign",
        rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 6, (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    ),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20, (b"akia",)),
    Rule("hex", rb"[0-9a-f]+", 0, 24),
)
#: formats of public credential types beyond the base rules
MORE_RULES = (
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, (b"private key-----",)),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, (b"eyj",)),
)
RULES = BASE_RULES + MORE_RULES


def _found(rules: Sequence[tuple[int, Rule, re.Pattern]], text: bytes) -> list[dict]:
    lowered = text.lower()
    spans = []
    for rank, rule, pattern in rules:
        if rule.needles and not any(needle in lowered for needle in rule.needles):
            continue
        for match in pattern.finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                spans.append((match.start(), rank, match.end(), rule))
    points = _points(text, {offset for start, _, end, _ in spans for offset in (start, end)})
    return [
        {"start": points[start], "rank": rank, "end": points[end], "kind": rule.kind, "version": rule.version}
        for start, rank, end, rule in spans
    ]


def _points(text: bytes, offsets: set[int]) -> dict[int, int]:
    """The code points before each byte offset, in one pass over the text."""
    if text.isascii():
        return {offset: offset for offset in offsets}
    points, at, count = {}, 0, 0
    for offset in sorted(offsets):
        count += len(text[at:offset].decode("utf-8", "replace"))
        at, points[offset] = offset, count
    return points


def _compiled(rule: Rule) -> re.Pattern:
    """A run of one character class needs no look at runs that are too short anyway."""
    if rule.group == 0 and rule.pattern.endswith(b"]+") and rule.pattern.startswith(b"[") and rule.pattern.count(b"[") == 1:
        return re.compile(rule.pattern[:-1] + b"{%d,}" % rule.least)
    return re.compile(rule.pattern)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Run the ``pending`` rule versions of each row of (blob, bytes, pending); rows in the ledger's layout."""
    ranked = [(rank, rule) for rank, rule in enumerate(rules)]
    layout = pa.schema([
        ("blob", pa.binary()), ("scanned", pa.list_(pa.string())),
        ("found", pa.list_(pa.struct([
            ("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("version", pa.string()),
        ]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple, list] = {}
        for batch in batches:
            found, pending = [], batch.column("pending").to_pylist()
            for text, versions in zip(batch.column("bytes").to_pylist(), pending):
                key = tuple(versions)
                if key not in ready:
                    ready[key] = [(rank, rule, _compiled(rule)) for rank, rule in ranked if rule.version in versions]
                found.append(_found(ready[key], text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array(pending, layout.field("scanned").type), pa.array(found, layout.field("found").type)],
                schema=layout,
            )

    return blobs.select("blob", "bytes", "pending").mapInArrow(scan, LEDGER)


def blob_id(text: Column | str) -> Column:
    return F.unhex(F.sha2(utf8(text), 256))


def update_ledger(history: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan the unseen pairs of ``history`` and append them to the table at ``ledger``; return the table.

    Texts are scanned where they are read, copies of a blob each, and only findings cross the network, of which the ledger gets
    one row per blob; a ledger too large to broadcast moves the texts once to be joined. The append is committed as a whole:
    after a failure the next run finds the pairs unseen and scans them.
    """
    spark = history.sparkSession
    versions = [rule.version for rule in rules]
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = (
        spark.read.schema(LEDGER).parquet(ledger)
        .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    )
    every = F.array(*[F.lit(v) for v in versions])
    blobs = history.select(blob_id(text).alias("blob"), utf8(text).alias("bytes"))
    unseen = (
        blobs.join(seen, "blob", "left")
        .withColumn("pending", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        .filter(F.size("pending") > 0)
    )
    scan_blobs(unseen, rules).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(table: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with findings by the given rules, spans by start, then rule order."""
    versions = F.array(*[F.lit(rule.version) for rule in rules])
    wanted = F.filter("found", lambda x: F.array_contains(versions, x["version"]))
    return (
        table.select("blob", wanted.alias("found")).filter(F.size("found") > 0)
        .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("spans"))
    )


def scan_history(history: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``history`` without its text, plus ``blob`` and ``spans`` (empty where nothing was found).

    ``history`` holds one row per path and version; columns named blob or spans are replaced.
    """
    found = findings(update_ledger(history, ledger, text, rules), rules)
    keyed = history.withColumn("blob", blob_id(text)).drop("spans", text)
    return keyed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def redact(docs: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with each found span replaced by ``[SECRET]``; a column n_chars follows the new length."""
    # written, so that Spark sees how small the findings are and need not move the texts again to join them
    found = cut(findings(update_ledger(docs, ledger, text, rules), rules))
    mark, cover = "_blob_of_redact", "_spans_of_redact"
    columns = docs.columns
    joined = docs.withColumn(mark, blob_id(text)).join(
        found.select(F.col("blob").alias(mark), F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias(cover)), mark, "left"
    )
    schema = docs.schema

    def replace(value: str, spans: list[dict]) -> str:
        pieces, at = [], 0
        for start, end in sorted(tuple(span.values()) for span in spans):
            if end > at:
                if start >= at:
                    pieces += [value[at:start], "[SECRET]"]
                at = end
        return "".join(pieces) + value[at:]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = batch.column(cover)
            batch = batch.select(columns)
            if covers.null_count < len(covers):
                spans = covers.to_pylist()
                texts = [t if s is None else replace(t, s) for t, s in zip(batch.column(text).to_pylist(), spans)]
                at = batch.schema.get_field_index(text)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if "n_chars" in columns:
                    at = batch.schema.get_field_index("n_chars")
                    kind = batch.schema.field(at).type
                    if pa.types.is_integer(kind):
                        sizes = [n if s is None else len(t) for n, t, s in zip(batch.column(at).to_pylist(), texts, spans)]
                        batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, kind))
            yield batch

    return joined.select(*columns, cover).mapInArrow(apply, schema)
