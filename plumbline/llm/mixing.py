"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size says how often each of its documents should be taken. The whole part is taken by
all; the fractional part is a probability that is rounded to 0 or 1. Documents are paired, and a pair randomly
transfers mass (probability times words) from one to the other until one probability is integral: its expectation is
kept, and so is the pair's expected number of words. The other one meets the next document. A source's taken words
thus differ from its target by less than one document.

Rounding is a reduction tree: every bucket of a source's documents is rounded in one pass with one open document in
memory, and leaves at most one; ``fan_in`` buckets' leftovers form a bucket of the next level, until a source has one
bucket, whose last leftover is drawn. Buckets and draws come from hashes of id and text, so reruns agree, however the
rows are spread.

Defined cases: a null text has no words; documents without words are never taken; sources are ordered by code point
with null last; repeated rows are documents of their own, and a row may be taken while its copy is not; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, partitions
from plumbline.session import cut

WEIGHTS = (5, 2, 1)
#: most copies of a document
MOST = 3
BUCKET_ROWS = 8192
FAN_IN = 64

_EXACT = 1e-9


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, place): place counts from 0 by code point, null last; no task sees all sources."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = F.col("source").asc_nulls_last()
    ranged = cut(sums.repartitionByRange(partitions(sized.sparkSession), order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("local", local).join(offsets, "part").select(
        "source", "source_size", "n_docs", (F.col("offset") + F.col("local")).alias("place")
    )


def with_targets(sources: DataFrame, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Add ``target``: ``share`` of all words dealt by ``weight``, at most ``most`` times a source's words.

    What a source cannot take is dealt to the others again. All open sources get the same number of words per weight,
    the rate, which only grows, so a round needs two sums over the sources.
    """
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.col("source_size") * most
    rate = 0.0
    while True:
        full = F.lit(rate) * F.col("weight") > cap
        row = sources.agg(
            F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        following = (total - (row["capped"] or 0)) / row["open"]
        if following <= rate:
            break
        rate = following
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(rate) * F.col("weight")))


def _draw(value: int, level: int) -> float:
    """A uniform number in [0, 1) from a hash and a level."""
    z = (value + (level + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def transfer(p: float, size: int, q: float, other: int, u: float) -> tuple[float, float]:
    """Move words between two fractional documents until one is integral; ``u`` is uniform."""
    up = min((1 - p) * size, q * other)
    down = min(p * size, (1 - q) * other)
    if u * (up + down) < down:
        full, empty = (1 - p) * size <= up, q * other <= up
        p, q = (1.0 if full else p + up / size), (0.0 if empty else q - up / other)
    else:
        empty, full = p * size <= down, (1 - q) * other <= down
        p, q = (0.0 if empty else p - down / size), (1.0 if full else q + down / other)
    return p, q


def _settle(p: float) -> float:
    return 0.0 if p < _EXACT else 1.0 if p > 1 - _EXACT else p


def round_buckets(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Round ``p`` within each (place, bucket); at most one row of a bucket stays fractional, none if ``last``."""
    parts = partitions(rows.sparkSession)
    dealt = rows.repartition(parts, "place", "bucket").sortWithinPartitions("place", "bucket", "key", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            place, bucket, size, p, key = (batch.column(c).to_pylist() for c in ("place", "bucket", "size", "p", "key"))
            open_ = None
            for i in range(batch.num_rows):
                p[i] = _settle(p[i])
                if p[i] in (0.0, 1.0):
                    continue
                if open_ is not None and place[open_] == place[i] and bucket[open_] == bucket[i]:
                    a, b = transfer(p[open_], size[open_], p[i], size[i], _draw(key[i], 2 * level))
                    p[open_], p[i] = _settle(a), _settle(b)
                    if p[open_] in (0.0, 1.0):
                        open_ = None if p[i] in (0.0, 1.0) else i
                    continue
                if open_ is not None and last:
                    p[open_] = float(_draw(key[open_], 2 * level + 1) < p[open_])
                open_ = i
            at = batch.schema.get_field_index("p")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(p, pa.float64()))
            held = None
            if open_ is not None:
                held = batch.slice(open_, 1)
                rest = [batch.slice(0, open_), batch.slice(open_ + 1)]
                yield from (x for x in rest if x.num_rows)
            else:
                yield batch
        if held is not None:
            if last:
                drawn = float(_draw(held.column("key")[0].as_py(), 2 * level + 1) < held.column("p")[0].as_py())
                at = held.schema.get_field_index("p")
                held = held.set_column(at, held.schema.field(at), pa.array([drawn], pa.float64()))
            yield held

    return dealt.mapInArrow(run, rows.schema)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST,
    bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row; ``weights`` repeat over the sources."""
    sized = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(doc_id, text).alias("key"),
    ))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = cut(with_targets(cut(ranked_sources(sized).withColumn("weight", weight)), share, most).withColumn("ratio", ratio))
    buckets = F.ceil(F.col("n_docs") / bucket_rows)
    whole = F.floor(F.col("ratio") + _EXACT)
    fraction = F.when(F.col("size") > 0, F.greatest(F.col("ratio") - whole, F.lit(0.0))).otherwise(0.0)
    planned = sized.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source"))).select(
        "doc_id", "source", "size", "key", "source_size", "target", "place", whole.alias("whole"), fraction.alias("p"),
        F.pmod(F.xxhash64("key"), buckets).alias("bucket"),
    )
    most_buckets = sources.agg(F.max(buckets)).first()[0] or 1
    done, level = [], 0
    while True:
        last = most_buckets <= 1
        rounded = round_buckets(planned, level, last)
        if last:
            done.append(rounded)
            break
        rounded = cut(rounded)
        settled = F.col("p").isin(0.0, 1.0)
        done.append(rounded.filter(settled))
        planned = rounded.filter(~settled).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        most_buckets, level = math.ceil(most_buckets / fan_in), level + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(0)
    return result.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )
