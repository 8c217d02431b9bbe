"""The registered queries of the corpus operators: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import balltree, capfilters, conversations, decontaminate, licenses, linkgraph, merkle, mixing, quality, secrets, simhash, toxicity, warc
from plumbline.llm.common import table
from plumbline.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    LLM_QUERIES[function.__name__] = function
    return function


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query
def op5_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["template"])))
    return found.select(
        "doc_id", F.size("places").cast("long").alias("n_places"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("coverage"),
    )


@query
def op6_decontaminate(spark, sf_dir):
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("begin"), (m["doc_word"] + m["length"]).alias("end"))))
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda state, s: F.struct(
            F.greatest(state["end"], s["end"]).alias("end"),
            (state["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], state["end"]))).alias("hit"),
        ),
        lambda state: state["hit"].cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    return found.select("doc_id", "n_words", union.alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fifth."""
    return table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.train(docs, training_labels(spark, sf_dir)))


@query
def op7_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secrets.scan_history(docs, scratch(spark, "secret-ledger"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [rule.kind for rule in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["rank"] < len(kinds))
    return scanned.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op10_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op1_simhash(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_link_graph(spark, sf_dir):
    judged = linkgraph.judge(table(spark, sf_dir, "pages"), linkgraph.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op9_warc_packages(spark, sf_dir):
    packages = warc.write_packages(table(spark, sf_dir, "pages"), scratch(spark, "warc-packages"))
    return warc.read_packages(packages, payload=False).select(
        warc.page_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").cast("long").alias("refers_to"),
    )


@query
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_texts(docs, quality.train(docs, training_labels(spark, sf_dir)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op4_ball_tree_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return balltree.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    values = [F.col("n_chars") + 1 if name == "n_chars" else F.col(name) for name in merkle.FIELDS]
    found = merkle.manifest(docs, also={"tampered": F.when(tampers, merkle.leaf_digest(values))})
    siblings = F.concat_ws("", F.transform("proof", lambda step: F.substring(step, 2, 64)))
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage to conversations, by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20."""
    def known(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(kind == 4, "user").otherwise(known("role"))
    kept = rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return kept.drop("copy")


@query
def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(damaged(rows), rows)


@query
def op11_cap_filters(spark, sf_dir):
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))
