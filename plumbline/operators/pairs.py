"""Which image pairs to match."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.neighbors import nearest_neighbors, spread
from plumbline.operators.ordering import with_position
from plumbline.session import cut

#: places of a collection that one task of the exact search compares with as many others
EXACT_BLOCK = 8192


def sequential_pairs(
    images: DataFrame, overlap: int, key: str, id_column: str, order: Sequence[Column], hot_rows: float | None = None
) -> DataFrame:
    """Each image with its next ``overlap`` images in order; an equi-join on positions, also for one long video."""
    placed = with_position(images, [key], order, hot_rows=hot_rows).select(key, "pos", F.col(id_column).alias("id"))
    left = placed.select(
        key, F.col("id").alias("first_id"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + overlap)).alias("pos")
    )
    return left.join(placed.withColumnRenamed("id", "second_id"), [key, "pos"]).select(key, "first_id", "second_id")


def exhaustive_ranges(
    images: DataFrame, key: str, id_column: str, order: Sequence[Column], hot_rows: float | None = None
) -> DataFrame:
    """All pairs, written as the range of partner positions of each image.

    The pairs themselves grow with the square of a video, so they are never listed: image ``pos`` pairs with
    the images at ``partner_from .. partner_to``.
    """
    placed = with_position(images, [key], order, hot_rows=hot_rows).select(key, F.col(id_column).alias("first_id"), "pos")
    totals = images.groupBy(key).agg(F.count(F.lit(1)).alias("partner_to"))
    return placed.join(totals, key).select(
        key, "first_id", "pos", (F.col("pos") + 1).alias("partner_from"), "partner_to",
        (F.col("partner_to") - F.col("pos")).alias("partners"),
    )


def _unordered(rows: DataFrame, key: str, a: str, b: str, score: str) -> DataFrame:
    return rows.select(
        key, F.least(a, b).alias("first_id"), F.greatest(a, b).alias("second_id"), score
    ).groupBy(key, "first_id", "second_id").agg(F.min(score).alias(score))


def spatial_pairs(positions: DataFrame, k: int, key: str, id_column: str, max_distance: float | None = None) -> DataFrame:
    """Pairs of images of which one is among the ``k`` nearest of the other."""
    near = nearest_neighbors(positions, k, key, id_column)
    if max_distance is not None:
        near = near.filter(F.col("distance") <= max_distance)
    return _unordered(near, key, id_column, "neighbor_id", "distance")


def exact_similar_pairs(vectors: DataFrame, k: int, key: str, id_column: str, vector: str, block: int = EXACT_BLOCK) -> DataFrame:
    """The ``k`` images with the highest cosine similarity to each image: ``(key, id, rank, similar_id, cosine)``.

    Exact at every size: a collection is dealt into blocks of about ``block`` places, and each two blocks are compared
    in a task of their own, which only the best of each place leave. The work grows with the square of a collection.
    """
    rows, places = _places(vectors, k, key, id_column, vector)
    blocks = places.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    member = cut(places.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    at = (key, "i", "j")
    asking = member.withColumn("i", F.col("own")).withColumn("j", every).select(*at, "place", "v")
    asked = member.withColumn("j", F.col("own")).withColumn("i", every).select(*at, "ids", "v")
    return _best(rows, asking, asked, at, k, key, id_column)


def _places(vectors: DataFrame, k: int, key: str, id_column: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the name of their place, and the places with the ``k + 1`` smallest ids of their equal vectors."""
    rows = vectors.select(key, F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # two hashes name a place, so that different vectors do not share one
    rows = rows.withColumn("place", F.concat_ws("/", F.xxhash64("v").cast("string"), F.xxhash64(F.lit(1), "v").cast("string")))
    same = Window.partitionBy(key, "place").orderBy("id")
    kept = rows.withColumn("_rank", F.row_number().over(same)).filter(F.col("_rank") <= k + 1)
    places = cut(kept.groupBy(key, "place").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    return rows, places


def _best(rows: DataFrame, asking: DataFrame, asked: DataFrame, at: Sequence[str], k: int, key: str, id_column: str) -> DataFrame:
    """The ``k`` best answers of each row, from places that ask and places that are asked in the same group ``at``."""
    types = dict(rows.dtypes)
    id_type, key_type = types["id"], types[key]

    def unit(column: pd.Series) -> np.ndarray:
        matrix = np.stack(column.to_numpy())
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms > 0, norms, 1.0)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "place": [], "hits": []})
        queries, matrix = unit(left["v"]), unit(right["v"])
        owner = np.repeat(np.arange(len(right)), right["ids"].str.len())
        ids = np.concatenate([np.asarray(i) for i in right["ids"]])
        hits = []
        for start in range(0, len(queries), 256):
            for line in (queries[start: start + 256] @ matrix.T)[:, owner]:
                near = np.arange(len(line))
                if len(line) > k + 1:
                    near = np.flatnonzero(line >= np.partition(line, len(line) - k - 1)[len(line) - k - 1])
                best = near[np.lexsort((ids[near], -line[near]))][: k + 1]
                hits.append([{"cosine": float(line[n]), "id": ids[n].item()} for n in best])
        return left[[key, "place"]].assign(hits=hits)

    hit = f"{key} {key_type}, place string, hits array<struct<cosine:double,id:{id_type}>>"
    found = spread(asking, *at).groupBy(*at).cogroup(spread(asked, *at).groupBy(*at)).applyInPandas(compare, hit)
    exploded = found.select(key, "place", F.explode("hits").alias("h"))
    once = exploded.groupBy(key, "place", F.col("h.id").alias("similar_id")).agg(F.max("h.cosine").alias("cosine"))
    best = Window.partitionBy(key, "place").orderBy(F.desc("cosine"), "similar_id")
    answers = once.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k + 1)
    joined = rows.select(key, "id", "place").join(answers, [key, "place"]).filter("id <> similar_id")
    final = Window.partitionBy(key, "id").orderBy(F.desc("cosine"), "similar_id")
    return joined.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        key, F.col("id").alias(id_column), "rank", "similar_id", "cosine"
    )
