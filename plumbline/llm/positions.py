"""Positions in a total order, from range partitions, so that one key may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import partitions
from plumbline.session import cut


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``pos``, the 0-based place of a row within its key, and ``size``, the rows of the key.

    Rows go by ``order``, nulls first; the order should be total, else equal rows are placed either way. Each range
    partition is sorted and numbered where it lies; only the counts of (partition, key) are summed up in a window.
    """
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranged = df.repartitionByRange(partitions(df.sparkSession), *columns).sortWithinPartitions(*columns)
    # numbers of partitions and rows are data from here on: written once, the same for every later attempt
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_run"), *[F.col(k).alias(f"_run_{k}") for k in keys], "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_run_{k}")) for k in keys], F.col("_part") == F.col("_run"))
    return placed.join(runs, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "size")
