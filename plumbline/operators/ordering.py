"""Order-dependent operators that stay exact when one key holds most of the rows.

A window ``PARTITION BY key`` puts a whole key into one task. That is the right plan while every key is small,
so each function first measures the largest key with one aggregate. Beyond ``hot_rows`` it switches to a form
whose tasks are bounded: range partitions with one carried row per partition, or a narrow band around a quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut

#: rows of one key that a single task may sort
HOT_ROWS = 2_000_000

_QUANTILE_ACCURACY = 100_000
_BAND = 4 / _QUANTILE_ACCURACY


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key; map-side combined, one number comes back."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return row["n"] or 0


def measured(df: DataFrame, keys: Sequence[str]) -> float:
    """A ``hot_rows`` value for several operators on rows derived from ``df``, so that the largest key is measured once.

    Callers pass the plain input table, not the joins built on it.
    """
    return 0 if largest_group(df.select(*keys), keys) > HOT_ROWS else math.inf


def is_hot(df: DataFrame, keys: Sequence[str], hot_rows: float | None) -> bool:
    """Whether a key exceeds ``hot_rows``; 0 and infinity answer without a job."""
    if hot_rows in (0, math.inf):
        return hot_rows == 0
    return largest_group(df, keys) > (HOT_ROWS if hot_rows is None else hot_rows)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos", hot_rows: float | None = None
) -> DataFrame:
    """Add the 1-based rank of each row within its key; ``order`` must be total within a key."""
    if not is_hot(df, keys, hot_rows):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    # the partition number is data from here on: written once, the same for every later task attempt
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    sizes = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        local.join(offsets, ["_part", *keys])
        .withColumn(name, F.col("_before") + F.col("_rank"))
        .drop("_part", "_rank", "_before")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Sequence[str],
    name: str = "pos",
    hot_rows: float | None = None,
) -> DataFrame:
    """Add the position and the values the listed columns had one row earlier as ``prev_<column>``."""
    if not is_hot(df, keys, hot_rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        shifted = [F.lag(c).over(window).alias(f"prev_{c}") for c in columns]
        return df.select("*", F.row_number().over(window).cast("bigint").alias(name), *shifted)
    placed = cut(with_position(df, keys, order, name, hot_rows))
    earlier = placed.select(
        *keys, (F.col(name) + 1).alias(name), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return placed.join(earlier, [*keys, name], "left")


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Sequence[str],
    name: str = "pos",
    hot_rows: float | None = None,
) -> DataFrame:
    """Like :func:`with_previous`, one row later, as ``next_<column>``."""
    if not is_hot(df, keys, hot_rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        shifted = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
        return df.select("*", F.row_number().over(window).cast("bigint").alias(name), *shifted)
    placed = cut(with_position(df, keys, order, name, hot_rows))
    later = placed.select(*keys, (F.col(name) - 1).alias(name), *[F.col(c).alias(f"next_{c}") for c in columns])
    return placed.join(later, [*keys, name], "left")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", hot_rows: float | None = None
) -> DataFrame:
    """Exact median per key.

    For a hot key an approximate quantile gives a narrow band that surely holds the middle; rows below the band
    are only counted, and equal values inside the band are merged before they are ranked.
    """
    rows = df.filter(F.col(value).isNotNull())
    if not is_hot(rows, keys, hot_rows):
        return rows.groupBy(*keys).agg(F.median(value).alias(name))
    band = cut(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx(value, [0.5 - _BAND, 0.5 + _BAND], _QUANTILE_ACCURACY).alias("_q"),
        )
    )
    tagged = rows.select(*keys, F.col(value).alias("_v")).join(band, list(keys))
    low, high = F.col("_q")[0], F.col("_q")[1]
    below = tagged.groupBy(*keys).agg(F.count_if(F.col("_v") < low).alias("_below"))
    inside = tagged.filter(F.col("_v").between(low, high)).groupBy(*keys, "_n", "_v").agg(
        F.count(F.lit(1)).alias("_same")
    )
    upto = Window.partitionBy(*keys).orderBy("_v")
    ranked = inside.join(below, list(keys)).withColumn("_last", F.col("_below") + F.sum("_same").over(upto))
    first = F.col("_last") - F.col("_same") + 1
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    weight = lower.between(first, F.col("_last")).cast("int") + upper.between(first, F.col("_last")).cast("int")
    return ranked.groupBy(*keys).agg((F.sum(F.col("_v") * weight) / 2).alias(name))


def running_max(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Largest ``value`` on earlier rows of the key, by dense ``position``; NULL values are skipped.

    Rows are scanned in slices of positions, and one row per slice is carried over, so no task holds a whole key.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(position) / slice_rows)).withColumn("_value", value)
    earlier = (Window.unboundedPreceding, -1)
    inside = F.max("_value").over(Window.partitionBy(*keys, "_slice").orderBy(position).rowsBetween(*earlier))
    tops = sliced.groupBy(*keys, "_slice").agg(F.max("_value").alias("_top"))
    carried = tops.select(
        *keys, "_slice", F.max("_top").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*earlier)).alias("_carry")
    )
    joined = sliced.withColumn("_inside", inside).join(carried, [*keys, "_slice"])
    return joined.select(*df.columns, F.greatest("_inside", "_carry").alias(name))
