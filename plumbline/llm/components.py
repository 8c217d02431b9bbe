"""Connected components of an edge table by alternating large and small stars.

Every round hangs all neighbours of a node on its smallest neighbour; the edge table never grows beyond two rows per
edge, no task holds a node's neighbours (a minimum is pre-aggregated, and the join on it may be split where a node is
hot), and the number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(high, low))"), F.expr("bit_xor(xxhash64(low, high, 7))")).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge, but for the roots themselves; the root is a component's smallest node."""
    high, low = F.greatest(a, b), F.least(a, b)
    current = cut(edges.filter(F.col(a) != F.col(b)).select(high.alias("high"), low.alias("low")).distinct())
    state = _state(current)
    while state[0]:
        both = current.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(current.select(F.col("low"), F.col("high")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("high"), F.col("m").alias("low"))
        large = cut(large.distinct())
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(lowest, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        current = cut(small.unionAll(lowest.select("high", F.col("m").alias("low"))).distinct())
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
