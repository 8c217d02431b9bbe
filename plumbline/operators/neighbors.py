"""Exact k-nearest and radius self-joins of points.

Space is cut into tiles of about equal point count: each pass splits the overfull tiles along their widest axis
at approximate quantiles, so dense regions simply get more and smaller tiles. A task then searches the points of
one tile through a k-d tree. The k-th distance inside the own tile bounds the search; only tiles that this ball touches
are visited, and crowded tiles are visited by several tasks. Nothing is ever paired up in a shuffle, and equal
coordinates are merged with a weight before any of this, so no group of copies can fill a tile.

In a tile, queries pass in blocks of neighbours. The leaves nearest to a block give a first k-th distance, and only leaves
whose box is no farther than the running k-th distance are read. Radius counts walk down from the root: a node wholly
outside the balls of a block is left, one wholly inside them adds its weight, and only leaves between are compared.
Boxes and points are measured by the same sums of squares, which rounding keeps in order, so ties are never lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import cut

#: distinct points of a tile, which one task searches
TILE_POINTS = 32_768
#: queries that one task answers for one tile
TILE_QUERIES = 16_384
#: points of a leaf, and queries that are answered together
LEAF_POINTS = 64
#: leaves of queries that go through a tree together, distances held at once, leaves read first and at most in a round
_BLOCKS = 64
_HELD = 1 << 15
_LEAVES_FIRST = 4
_LEAVES_MOST = 64
#: coordinates up to which squared distances are finite
_LARGEST = 1e150

#: parts one axis can be cut into at once, and room for the parts of one node in a tile number
_QUANTILES = 64
_BASE = 256
#: points of a tile in the sample that tiles are planned on
_SAMPLED = 256
_GRID_PASSES = 2
_MAX_DEPTH = 7
_AXES = ("x", "y", "z")
_SLACK = 1 + 1e-12


@dataclass
class Tiling:
    """Points with their tile, the tile boxes, the split tables from the root down, the boxes of the split nodes, and the
    cell of each tile: nothing of another tile lies in ``lo < v < hi``."""

    points: DataFrame
    tiles: DataFrame
    levels: list[DataFrame]
    inner: DataFrame | None = None
    cells: DataFrame | None = None


def _inner_cuts(quantiles: Column, parts: Column, low: Column, high: Column) -> Column:
    """Cuts at the quantiles; where values only differ by rounding a cut moves to the next gap, else neighbours would part."""
    def gap(value: Column) -> Column:
        return value - F.coalesce(F.array_max(F.filter(quantiles, lambda e: e < value)), low)

    width = F.floor(_QUANTILES / (4 * parts)).cast("int")

    def pick(i: Column) -> Column:
        at = F.round(i * _QUANTILES / parts).cast("int")
        around = F.slice(quantiles, F.greatest(F.lit(1), at - width), 2 * width + 1)
        widest = F.array_max(F.transform(around, lambda e: F.struct(gap(e).alias("gap"), e.alias("value"))))
        own = F.element_at(quantiles, at)
        return F.when(gap(own) < 1e-6 * widest["gap"], widest["value"]).otherwise(own)

    picks = F.array_sort(F.transform(F.sequence(F.lit(1), parts - 1), pick))
    # a cut at the minimum would leave an empty part; without any other cut the maximum is split off
    inner = F.array_distinct(F.filter(picks, lambda e: e > low))
    return F.when(F.size(inner) > 0, inner).otherwise(F.array(high))


def _split_rule(tile_points: int, depth: int) -> list[Column]:
    """Cut positions of a node on each axis, from its aggregates; all NULL if it is small enough.

    The first passes cut all axes at once. Points along a line or sheet fill few cells of such a grid, so later
    passes cut the widest axis only, which always divides what is left.
    """
    low, high = ({a: F.col(f"{side}_{a}") for a in _AXES} for side in ("min", "max"))
    spread = {a: (high[a] > low[a]).cast("int") for a in _AXES}
    used = spread["x"] + spread["y"] + spread["z"]
    fill = F.col("n") / (0.75 * tile_points)
    splits = (F.col("n") > tile_points) & (used > 0)
    widest = F.greatest(*[high[a] - low[a] for a in _AXES])
    taken = F.lit(False)
    edges = []
    for a in _AXES:
        if depth < _GRID_PASSES:
            most = F.when(used == 3, 6).when(used == 2, 14).otherwise(_QUANTILES)
            parts = F.least(most, F.ceil(F.pow(fill, 1 / F.greatest(used, F.lit(1)))).cast("int"))
            cuts = splits & (spread[a] > 0)
        else:
            parts = F.least(F.lit(_QUANTILES), F.ceil(fill).cast("int"))
            cuts = splits & ~taken & (high[a] - low[a] == widest)
            taken = taken | (high[a] - low[a] == widest)
        parts = F.greatest(F.lit(2), parts)
        inner = _inner_cuts(F.col(f"q_{a}"), parts, low[a], high[a])
        edges.append(F.when(cuts, inner).when(splits, F.array().cast("array<double>")).alias(f"edges_{a}"))
    return edges


def _index_of(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def _child(tile: Column, ix: Column, iy: Column, iz: Column) -> Column:
    across = [F.size(F.col(f"edges_{a}")) + 1 for a in ("y", "z")]
    return tile * _BASE + (ix * across[0] + iy) * across[1] + iz


def _slabs(tiles: DataFrame, key: str, levels: list[DataFrame]) -> list[DataFrame]:
    """Per level (key, tile, top_x, top_y, top_z): the largest coordinate of the points in each part of a split node's axis."""
    steps = F.sequence(F.lit(1), F.lit(_MAX_DEPTH))
    lines = F.transform(steps, lambda i: F.struct(
        F.call_function("shiftright", F.col("tile"), i * 8).alias("node"),
        (F.call_function("shiftright", F.col("tile"), (i - 1) * 8) % _BASE).alias("part"),
    ))
    above = tiles.select(key, F.explode(F.filter(lines, lambda e: e["node"] > 0)).alias("_at"), *[f"max_{a}" for a in _AXES])
    parts = cut(above.groupBy(key, F.col("_at.node").alias("tile"), F.col("_at.part").alias("part")).agg(*[F.max(f"max_{a}").alias(f"max_{a}") for a in _AXES]))
    out = []
    for level in levels:
        ny, nz = (F.size(f"edges_{a}") + 1 for a in ("y", "z"))
        index = {"x": F.floor(F.col("part") / (ny * nz)), "y": F.floor(F.col("part") / nz) % ny, "z": F.col("part") % nz}
        found = parts.join(level, [key, "tile"])
        tops = F.array_sort(F.collect_list(F.struct("at", "top")))
        for a in _AXES:
            listed = found.groupBy(key, "tile", index[a].cast("int").alias("at")).agg(F.max(f"max_{a}").alias("top")).groupBy(key, "tile").agg(tops.alias(f"top_{a}"))
            level = level.join(listed, [key, "tile"], "left")
        out.append(cut(level))
    return out


def _cells(nodes: DataFrame, key: str, levels: list[DataFrame]) -> DataFrame:
    """(key, tile, lo_x, hi_x, ...) of all tiles, by walking the split tables from the root; one row a tile.

    Below a tile's own part of an axis nothing lies above the largest coordinate of the parts there, which bounds the cell.
    """
    open_ends = [F.lit(end).alias(f"{side}_{a}") for a in _AXES for side, end in (("lo", -float("inf")), ("hi", float("inf")))]
    cells = nodes.select(key, F.lit(1).cast("bigint").alias("tile"), *open_ends).distinct()
    for level in _slabs(nodes, key, levels):
        cells = cells.join(level, [key, "tile"], "left")
        for a in _AXES:
            edges = F.coalesce(F.col(f"edges_{a}"), F.array().cast("array<double>"))
            tops = F.coalesce(F.col(f"top_{a}"), F.array().cast("array<struct<at:int,top:double>>"))
            low = F.transform(
                F.sequence(F.lit(0), F.size(edges)),
                lambda i: F.aggregate(F.filter(tops, lambda t: t["at"] < i), F.col(f"lo_{a}"), lambda acc, t: F.greatest(acc, t["top"])),
            ).alias("lo")
            high = F.concat(edges, F.array(f"hi_{a}")).alias("hi")
            cells = cells.select("*", F.posexplode(F.arrays_zip(low, high)).alias(f"at_{a}", f"cell_{a}"))
            cells = cells.withColumns({f"{side}_{a}": F.col(f"cell_{a}.{side}") for side in ("lo", "hi")})
        child = _child(F.col("tile"), *[F.col(f"at_{a}") for a in _AXES])
        cells = cells.select(
            key, F.when(F.col("edges_x").isNotNull(), child).otherwise(F.col("tile")).alias("tile"),
            *[f"{side}_{a}" for a in _AXES for side in ("lo", "hi")],
        )
    return cells


def _moved(points: DataFrame, level: DataFrame, key: str) -> DataFrame:
    """Points of the split nodes in their children."""
    child = _child(F.col("tile"), *[_index_of(F.col(f"edges_{a}"), F.col(a)) for a in _AXES])
    moved = F.when(F.col("edges_x").isNotNull(), child).otherwise(F.col("tile"))
    return points.join(level, [key, "tile"], "left").withColumn("tile", moved).drop(*[f"edges_{a}" for a in _AXES])


def _boxes(points: DataFrame, key: str) -> DataFrame:
    """(key, tile, n, weight, min_x, max_x, ...) of each tile."""
    sides = [side(a).alias(f"{name}_{a}") for a in _AXES for name, side in (("min", F.min), ("max", F.max))]
    return points.groupBy(key, "tile").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *sides)


def _split(points: DataFrame, key: str, tile_points: int, share: int, depth: int) -> DataFrame:
    """Split table (key, tile, edges_x, edges_y, edges_z) of the overfull tiles; ``points`` is one in ``share``."""
    fractions = [i / _QUANTILES for i in range(1, _QUANTILES)]
    quantiles = points.groupBy(key, "tile").agg(*[F.percentile_approx(a, fractions, 2000).alias(f"q_{a}") for a in _AXES])
    nodes = _boxes(points, key).join(quantiles, [key, "tile"]).withColumn("n", F.col("n") * share)
    ruled = cut(nodes.select(key, "tile", *_split_rule(tile_points, depth)))
    return ruled.filter(F.col("edges_x").isNotNull())


def build_tiles(distinct_points: DataFrame, key: str, tile_points: int = TILE_POINTS) -> Tiling:
    """Tile distinct points ``(key, x, y, z, weight, ...)``.

    Splits are planned on a sample, of which every tile has some hundred points, and all points go to their tiles in one
    pass. Tiles that are overfull all the same, or points of clouds that the sample missed, are split by all their points.
    """
    rooted = F.lit(1).cast("bigint")
    written = cut(distinct_points)
    share = max(1, tile_points // _SAMPLED)
    drawn = written.select(key, *_AXES, "weight").filter(F.pmod(F.xxhash64(*_AXES), F.lit(share)) == 0) if share > 1 else written
    planned = cut(drawn.withColumn("tile", rooted))
    levels: list[DataFrame] = []

    def plan(points: DataFrame, share: int) -> DataFrame:
        while len(levels) < _MAX_DEPTH:
            level = _split(points, key, tile_points, share, len(levels))
            if level.isEmpty():
                break
            levels.append(level)
            points = cut(_moved(points, level, key))
        return points

    points = plan(planned, share)
    if share > 1:
        points = written.withColumn("tile", rooted)
        for level in levels:
            points = _moved(points, level, key)
        points = cut(points)
    nodes = cut(_boxes(points, key))
    spread_out = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in _AXES]) > 0
    overfull = nodes.filter((F.col("n") > 2 * tile_points) & spread_out).select(key, "tile")
    if share > 1 and len(levels) < _MAX_DEPTH and not overfull.isEmpty():
        before = len(levels)
        plan(cut(points.join(overfull, [key, "tile"], "left_semi")), 1)
        for level in levels[before:]:
            points = _moved(points, level, key)
        points = cut(points)
        nodes = cut(_boxes(points, key))
    tiles = nodes.drop("n").withColumnRenamed("weight", "tile_weight")
    if not levels:
        return Tiling(points, tiles, levels)
    steps = F.sequence(F.lit(1), F.lit(_MAX_DEPTH))
    parents = F.transform(steps, lambda i: F.call_function("shiftright", F.col("tile"), i * 8))
    sides = [side(f"{name}_{a}").alias(f"{name}_{a}") for a in _AXES for name, side in (("min", F.min), ("max", F.max))]
    inner = (
        nodes.withColumn("tile", F.explode(F.filter(parents, lambda p: p > 0)))
        .groupBy(key, "tile").agg(F.sum("weight").alias("weight"), *sides)
    )
    # parts of the grid without points are no tiles
    cells = cut(_cells(nodes, key, levels).join(tiles.select(key, "tile"), [key, "tile"], "left_semi"))
    return Tiling(points, tiles, levels, cut(inner), cells)


def _tiles_in_reach(queries: DataFrame, tiling: Tiling, key: str) -> DataFrame:
    """Pair each query ``(key, x, y, z, reach, home)`` with every other tile its ball touches.

    The split tables are walked from the root, so the number of rows follows the touched tiles.
    """
    found = queries.withColumn("tile", F.lit(1).cast("bigint"))
    for level in tiling.levels:
        touched = [
            F.sequence(
                _index_of(F.col(f"edges_{a}"), F.col(a) - F.col("reach")), _index_of(F.col(f"edges_{a}"), F.col(a) + F.col("reach"))
            )
            for a in _AXES
        ]
        children = F.flatten(F.transform(touched[0], lambda ix: F.flatten(F.transform(
            touched[1], lambda iy: F.transform(touched[2], lambda iz: _child(F.col("tile"), ix, iy, iz))))))
        children = F.when(F.col("edges_x").isNotNull(), children).otherwise(F.array("tile"))
        found = (
            found.join(level, [key, "tile"], "left")
            .withColumn("_next", F.explode(children))
            .drop(*[f"edges_{a}" for a in _AXES], "tile")
            .withColumnRenamed("_next", "tile")
        )
    near2, far2 = F.lit(0.0), F.lit(0.0)
    for a in _AXES:
        low, high, v = F.col(f"min_{a}"), F.col(f"max_{a}"), F.col(a)
        gap = F.greatest(low - v, v - high, F.lit(0.0))
        reach = F.greatest(F.abs(v - low), F.abs(high - v))
        near2, far2 = near2 + gap * gap, far2 + reach * reach
    return (
        found.filter("tile <> home")
        .join(tiling.tiles, [key, "tile"])
        .filter(F.sqrt(near2) <= F.col("reach"))
        .withColumn("covered", F.sqrt(far2) * _SLACK <= F.col("reach"))
        .select(*queries.columns, "tile", "tile_weight", "covered")
    )


def _salted(visits: DataFrame, points: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Spread the visits of a crowded tile over several tasks, each with a copy of that one tile."""
    counts = visits.groupBy(key, "tile").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).cast("int").alias("salts"))
    pick = F.pmod(F.xxhash64("x", "y", "z"), F.col("salts")).cast("int")
    queries = visits.join(counts, [key, "tile"]).withColumn("salt", pick).drop("salts")
    copies = points.join(counts, [key, "tile"]).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    ).drop("salts")
    return queries, copies


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitions of a fixed number: few bytes here still mean much work, so they must not be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy()


def _coordinates(table: pa.Table) -> np.ndarray:
    return np.stack([_numbers(table, c) for c in _AXES], axis=1)


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.Array:
    """List column of ``values`` with as many for each row as its part has."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


class _Tree:
    """A k-d tree of points: node ``i`` holds ``order[start[i]:end[i]]`` and has the children ``child[i]`` and ``child[i] + 1``, or 0."""

    def __init__(self, points: np.ndarray, weights: np.ndarray | None = None, leaf: int = LEAF_POINTS):
        self.axes = [np.ascontiguousarray(points[:, i]) for i in range(3)]
        self.measured = 0
        order, start, end, child, low, high = np.arange(len(points)), [0], [len(points)], [0], [], []
        node = 0
        while node < len(start):
            own = points[order[start[node] : end[node]]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if len(own) > leaf:
                # points of one value stay together, else the boxes of both halves would hold them
                along = own[:, int(np.argmax(high[-1] - low[-1]))]
                middle = np.partition(along, len(own) // 2)[len(own) // 2]
                left, half = along < middle, len(own) // 2
                below, upto = int(left.sum()), int((along <= middle).sum())
                if upto < len(own) and upto - half < half - below or not below:
                    left, below = along <= middle, upto
                if 0 < below < len(own):
                    half, part = below, np.concatenate((np.flatnonzero(left), np.flatnonzero(~left)))
                    order[start[node] : end[node]] = order[start[node] : end[node]][part]
                child[node] = len(start)
                start += [start[node], start[node] + half]
                end += [start[node] + half, end[node]]
                child += [0, 0]
            node += 1
        self.order, self.start, self.end, self.child = order, np.array(start), np.array(end), np.array(child)
        self.low, self.high = np.array(low), np.array(high)
        self.leaves = np.flatnonzero(self.child == 0)
        if weights is not None:
            upto = np.concatenate(([0], np.cumsum(weights[order])))
            self.weight = upto[self.end] - upto[self.start]

    def blocks(self) -> Iterator[np.ndarray]:
        """Points in groups that lie close together."""
        for leaf in self.leaves:
            yield self.order[self.start[leaf] : self.end[leaf]]

    def padded_rows(self) -> np.ndarray:
        """Points of each leaf in a row, short rows filled with the leaf's first point."""
        start, end = self.start[self.leaves], self.end[self.leaves]
        place = np.arange((end - start).max())
        return self.order[np.where(place < (end - start)[:, None], start[:, None] + place, start[:, None])]

    def padded(self) -> list[np.ndarray]:
        """Coordinates of each leaf's points in a row per axis, infinite where there is none, and one row without points."""
        rows, sizes = self.padded_rows(), (self.end - self.start)[self.leaves]
        empty = np.vstack((np.arange(rows.shape[1]) >= sizes[:, None], np.ones(rows.shape[1], dtype=bool)))
        return [np.where(empty, np.inf, axis[np.vstack((rows, rows[:1]))]) for axis in self.axes]

    def points(self, nodes: np.ndarray) -> np.ndarray:
        sizes = self.end[nodes] - self.start[nodes]
        return self.order[np.arange(sizes.sum()) + np.repeat(self.start[nodes] - np.cumsum(sizes) + sizes, sizes)]

    def squared(self, queries: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the points ``among``."""
        self.measured += len(queries) * len(among)
        total = np.zeros((len(queries), len(among)))
        for i, axis in enumerate(self.axes):
            step = queries[:, i, None] - axis[among]
            total += np.multiply(step, step, out=step)
        return total

    def _gaps(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least squared distance between boxes of nodes and the box of a block."""
        gap = np.maximum(np.maximum(self.low[nodes] - high, low - self.high[nodes]), 0.0)
        gap *= gap
        return gap[:, 0] + gap[:, 1] + gap[:, 2]

    def _from_each(self, nodes: np.ndarray, queries: np.ndarray, farthest: bool = False) -> np.ndarray:
        """Least or largest squared distance of each query to the box of each node."""
        total = np.zeros((len(queries), len(nodes)))
        for i in range(3):
            at, low, high = queries[:, i, None], self.low[nodes, i], self.high[nodes, i]
            step = np.maximum(np.abs(high - at), np.abs(at - low)) if farthest else np.maximum(np.maximum(low - at, at - high), 0.0)
            total += np.multiply(step, step, out=step)
        return total

    def candidates(
        self, queries: np.ndarray, k: int, reach: np.ndarray | None = None
    ) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Points among which every query finds its ``k`` nearest, as far as they lie within ``reach``, and their squared
        distances, both in pieces; and the ``k`` least distances of each query in any order."""
        gaps = self._gaps(self.leaves, queries.min(axis=0), queries.max(axis=0))
        limit = np.full(len(queries), np.inf) if reach is None else reach * reach * (_SLACK * _SLACK)
        order = np.argsort(gaps, kind="stable")
        gaps, nodes = gaps[order], self.leaves[order]
        read, ahead = 0, int(np.searchsorted(np.cumsum((self.end - self.start)[nodes]), 2 * k)) + 1
        found, parts, nearest = [], [], np.empty((len(queries), 0))
        while True:  # nearest leaves first, until none is nearer than the k-th distance so far
            stop = min(int(np.searchsorted(gaps, limit.max(), side="right")), ahead)
            if stop <= read:
                break
            near = nodes[read:stop]
            near = near[(self._from_each(near, queries) <= limit[:, None]).any(axis=0)]
            read, ahead = stop, 4 * stop
            if not near.size:
                continue
            found.append(self.points(near))
            parts.append(self.squared(queries, found[-1]))
            nearest = np.concatenate((nearest, parts[-1]), axis=1)
            if nearest.shape[1] >= k:
                nearest = np.partition(nearest, k - 1, axis=1)[:, :k]
                limit = np.minimum(limit, nearest[:, k - 1])
        return found, parts, nearest

    def count(self, queries: np.ndarray, limit: float, weights: np.ndarray, enough: int | None = None) -> np.ndarray:
        """Weight within the squared distance ``limit`` of each query; with ``enough`` a count above it may be too low."""
        low, high = queries.min(axis=0), queries.max(axis=0)
        found, nodes = np.zeros(len(queries), dtype=np.int64), np.zeros(1, dtype=np.int64)
        while nodes.size:
            reach = np.maximum(np.abs(self.high[nodes] - low), np.abs(high - self.low[nodes]))
            reach *= reach
            whole = reach[:, 0] + reach[:, 1] + reach[:, 2] <= limit
            found += int(self.weight[nodes[whole]].sum())
            if enough is not None and found.min() > enough:
                break
            nodes = nodes[~whole & (self._gaps(nodes, low, high) <= limit)]
            leaf = self.child[nodes] == 0
            if leaf.any():
                ends = nodes[leaf]
                inside = self._from_each(ends, queries, farthest=True) <= limit
                found += inside @ self.weight[ends]
                cut_by = (self._from_each(ends, queries) <= limit) & ~inside
                some = cut_by.any(axis=0)
                among, sizes = self.points(ends[some]), (self.end - self.start)[ends[some]]
                counts = (self.squared(queries, among) <= limit) & np.repeat(cut_by[:, some], sizes, axis=1)
                found += counts @ weights[among]
            nodes = np.repeat(self.child[nodes[~leaf]], 2)
            nodes[1::2] += 1
        return found


def _repeat_by_weight(distances: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Sorted distances with each entry repeated by its weight, cut to ``k``; short rows end in NaN."""
    filled = np.cumsum(np.minimum(weights, k), axis=1)
    slots = np.arange(k)
    at = (filled[:, None, :] <= slots[None, :, None]).sum(axis=2)
    padded = np.concatenate([distances, np.full((len(distances), 1), np.nan)], axis=1)
    return np.take_along_axis(padded, at, axis=1)


def _expanded(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray | None:
    """Rows of ``points`` with each repeated by its weight, ``k`` at most; None if copies or huge numbers forbid that."""
    copies = np.minimum(weights, k)
    if copies.sum() > 2 * len(points) or np.abs(points).max(initial=0.0) > _LARGEST:
        return None
    return np.repeat(np.arange(len(points)), copies)


def _sorted_distances(tree: _Tree, asked: _Tree, k: int, reach: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``asked`` and their sorted distances to the ``k`` nearest points of ``tree``, NaN behind the last.

    Many leaves of ``asked`` go through ``tree`` together, each reading its nearest leaves until none is within the k-th
    distance so far of one of its points, or within their ``reach``.
    """
    targets, members = tree.padded(), asked.padded_rows()
    wide, none = targets[0].shape[1], len(tree.leaves)
    room = [np.empty(0), np.empty(0)]
    for start in range(0, len(members), _BLOCKS):
        rows = members[start : start + _BLOCKS]
        at = [axis[rows] for axis in asked.axes]
        own = asked.leaves[start : start + _BLOCKS]
        gaps = np.zeros((len(rows), none))
        for i in range(3):
            low, high = asked.low[own, i, None], asked.high[own, i, None]
            step = np.maximum(np.maximum(tree.low[tree.leaves, i] - high, low - tree.high[tree.leaves, i]), 0.0)
            gaps += np.multiply(step, step, out=step)
        order = np.argsort(gaps, axis=1)
        gaps = np.take_along_axis(gaps, order, axis=1)
        limit = np.full(rows.shape, np.inf) if reach is None else reach[rows] ** 2 * (_SLACK * _SLACK)
        nearest = np.full((*rows.shape, k), np.inf)
        read, ahead, active = 0, _LEAVES_FIRST, np.arange(len(rows))
        while active.size:
            chosen = order[active, read : read + ahead]
            near = gaps[active, read : read + ahead] <= limit[active].max(axis=1)[:, None]
            if read:  # the first leaves have to be read, later ones only if some point's own ball touches them
                alone = np.zeros((*limit[active].shape, chosen.shape[1]))
                for i in range(3):
                    here, leaves = at[i][active][:, :, None], tree.leaves[chosen][:, None, :]
                    step = np.maximum(np.maximum(tree.low[leaves, i] - here, here - tree.high[leaves, i]), 0.0)
                    alone += np.multiply(step, step, out=step)
                near &= (alone <= limit[active][:, :, None]).any(axis=1)
            chosen = np.take_along_axis(np.where(near, chosen, none), np.argsort(~near, axis=1, kind="stable"), axis=1)
            counts = near.sum(axis=1)
            by_count = np.argsort(counts, kind="stable")
            at_once, done = 0, int(np.searchsorted(counts[by_count], 1))
            while done < len(by_count):
                # blocks that read about as many leaves share one array
                at_once = max(1, _HELD // (rows.shape[1] * wide * int(counts[by_count[min(done + at_once, len(by_count) - 1)]])))
                part = by_count[done : done + at_once]
                done += len(part)
                blocks, leaves = active[part], chosen[part][:, : counts[part[-1]]]
                shape = (len(part), rows.shape[1], leaves.shape[1] * wide)
                size = shape[0] * shape[1] * shape[2]
                if size > len(room[0]):
                    room = [np.empty(size), np.empty(size)]
                total, step = (r[:size].reshape(shape) for r in room)
                for i in range(3):
                    np.subtract(at[i][blocks][:, :, None], targets[i][leaves].reshape(len(part), 1, -1), out=step)
                    if i:
                        total += np.multiply(step, step, out=step)
                    else:
                        np.multiply(step, step, out=total)
                tree.measured += size
                best = np.partition(np.concatenate((nearest[blocks], total), axis=2) if read else total, k - 1, axis=2)[:, :, :k] if (
                    read or total.shape[2] >= k
                ) else np.pad(total, ((0, 0), (0, 0), (0, k - total.shape[2])), constant_values=np.inf)
                nearest[blocks] = best
                limit[blocks] = np.minimum(limit[blocks], best.max(axis=2))
            read, ahead = read + ahead, min(2 * ahead, _LEAVES_MOST)
            active = active[gaps[active, read] <= limit[active].max(axis=1)] if read < none else active[:0]
        nearest.sort(axis=2)
        distances = np.sqrt(nearest)
        distances[np.isinf(distances)] = np.nan
        yield rows.ravel(), distances.reshape(-1, k)


def _distance_rows(queries: pa.Table, points: pa.Table, k: int, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Per query the sorted distances to its ``k`` nearest points in a row, and how many there are within ``reach``."""
    at, among = _coordinates(queries), _coordinates(points)
    weights = _numbers(points, "weight")
    rows, ends = np.full((len(at), k), np.nan), np.zeros(len(at), dtype=np.int64)
    if not len(at):
        return rows, ends
    copies = _expanded(among, weights, k)
    if copies is not None and np.abs(at).max() <= _LARGEST:
        tree = _Tree(among[copies])
        asked = tree if queries is points else _Tree(at)
        for place, distances in _sorted_distances(tree, asked, k, reach):
            # copies of a query have the same distances
            rows[copies[place] if queries is points else place] = distances
        with np.errstate(invalid="ignore"):
            return rows, (rows <= (np.inf if reach is None else reach[:, None])).sum(axis=1)
    tree = _Tree(among)
    for block in (tree if queries is points else _Tree(at)).blocks():
        found, parts, _ = tree.candidates(at[block], k, None if reach is None else reach[block])
        if not found:
            continue
        squared, own = np.concatenate(parts, axis=1), weights[np.concatenate(found)]
        keep = min(k, squared.shape[1])
        index = np.argpartition(squared, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(squared, index, axis=1)
        order = np.argsort(best, axis=1, kind="stable")
        index = np.take_along_axis(index, order, axis=1)
        distances = _repeat_by_weight(np.sqrt(np.take_along_axis(best, order, axis=1)), own[index], k)
        rows[block, : distances.shape[1]] = distances
        with np.errstate(invalid="ignore"):
            ends[block] = (distances <= (np.inf if reach is None else reach[block, None])).sum(axis=1)
    return rows, ends


def _leading(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """List column of the first ``ends`` values of each row."""
    offsets = np.concatenate(([0], np.cumsum(ends))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[np.arange(rows.shape[1]) < ends[:, None]]))


def _leaves_cell(tile: pa.Table, cell: pa.Table, reach: np.ndarray) -> pa.Array:
    """Whether the ball of each point may hold points of other tiles."""
    out = np.zeros(tile.num_rows, dtype=bool)
    for a in _AXES:
        at = _numbers(tile, a)
        out |= (at - _numbers(cell, f"lo_{a}")[0] <= reach) | (_numbers(cell, f"hi_{a}")[0] - at <= reach)
    return pa.array(out)


def _own_tiles(tiling: Tiling, key: str, found: Callable[[pa.Table], tuple[pa.Array, np.ndarray]], column: str, schema: str) -> DataFrame:
    """Every point with what its own tile gives as ``column``, and ``open``: whether its ball leaves the tile's cell.

    ``found`` gives the column and the radius of each ball.
    """
    names = [f for f in (key, "tile", *_AXES, "weight") if f in tiling.points.columns]

    def inside(tile: pa.Table, cell: pa.Table) -> pa.Table:
        values, reach = found(tile)
        return tile.select(names).append_column(column, values).append_column("open", _leaves_cell(tile, cell, reach))

    points = spread(tiling.points, key, "tile").groupBy(key, "tile")
    cells = spread(tiling.cells, key, "tile").groupBy(key, "tile")
    return cut(points.cogroup(cells).applyInArrow(inside, f"{schema}, open boolean"))


def _merge_equal(points: DataFrame, key: str) -> DataFrame:
    finite = points.filter(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    return finite.groupBy(key, *_AXES).agg(F.count(F.lit(1)).alias("weight"))


def _diagonal(low: str, high: str) -> Column:
    sides = [F.col(f"{high}_{a}") - F.col(f"{low}_{a}") for a in _AXES]
    return F.sqrt(sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2]) * (1 + 1e-9)


def _sparse_reach(tiling: Tiling, k: int, key: str) -> DataFrame:
    """For tiles of fewer than ``k`` points: the diagonal of the smallest node around them that holds ``k``.

    A node's number without its last digit, to the base of the tiles, is its parent's, so the nodes around a tile need
    no walk. The ball of that diagonal around any of the tile's points holds the whole node.
    """
    tile, up = F.col("tile"), F.col("_up")
    sparse = tiling.tiles.filter(F.col("tile_weight") < k).select(key, "tile")
    parents = F.transform(F.sequence(F.lit(1), F.lit(_MAX_DEPTH)), lambda i: F.call_function("shiftright", tile, i * 8))
    around = sparse.select(key, "tile", F.explode(F.filter(parents, lambda p: p > 0)).alias("_up"))
    nodes = tiling.inner.filter(F.col("weight") >= k).select(
        F.col(key).alias("_key"), F.col("tile").alias("_node"), _diagonal("min", "max").alias("_diagonal")
    )
    found = around.join(nodes, (F.col(key) == F.col("_key")) & (up == F.col("_node")))
    return found.groupBy(key, "tile").agg(F.max_by("_diagonal", "_up").alias("_near"))


def _bounded(result: DataFrame, k: int, key: str, tiling: Tiling, size: Column, kth: Column) -> DataFrame:
    """Add ``reach``: the k-th distance found so far; where the own tile has fewer points, the diagonal of the smallest
    node around it that has enough, or of the cloud if it has too few altogether."""
    whole = tiling.tiles.groupBy(key).agg(
        *[F.min(f"min_{a}").alias(f"lo_{a}") for a in _AXES], *[F.max(f"max_{a}").alias(f"hi_{a}") for a in _AXES]
    ).select(key, _diagonal("lo", "hi").alias("_all"))
    joined = result.join(whole, key).join(_sparse_reach(tiling, k, key), [key, "tile"], "left")
    reach = F.when(size >= k, kth).otherwise(F.coalesce("_near", "_all")) * _SLACK
    return joined.withColumn("reach", reach).drop("_all", "_near")


def _mean(distances: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Mean of the first ``ends`` values of each row, added from left to right as an engine does."""
    sums = np.cumsum(distances, axis=1)[np.arange(len(ends)), np.maximum(ends - 1, 0)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return pa.array(sums / ends)


def _distances(points: DataFrame, k: int, key: str, tile_points: int, lists: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, x, y, z, weight, mean_distance, distances) of the points that their own tile settles, with ``distances`` if
    ``lists``, and rows (key, x, y, z, weight, distances) of the others, None if there is no other tile."""
    tiling = build_tiles(_merge_equal(points, key), key, max(tile_points, k))
    key_type = dict(points.dtypes)[key]
    own_schema = f"{key} {key_type}, tile bigint, x double, y double, z double, weight bigint, mean_distance double, distances array<double>"

    def inside(tile: pa.Table) -> pa.Table:
        rows, ends = _distance_rows(tile, tile, k, None)
        named = tile.select([key, "tile", *_AXES, "weight"]).append_column("mean_distance", _mean(rows, ends))
        return named.append_column("distances", _leading(rows, ends))

    if not tiling.levels:
        return spread(tiling.points, key, "tile").groupBy(key, "tile").applyInArrow(inside, own_schema).drop("tile"), None

    def settled(tile: pa.Table, cell: pa.Table) -> pa.Table:
        rows, ends = _distance_rows(tile, tile, k, None)
        # its own tile may have fewer points than the ball needs
        leaves = _leaves_cell(tile, cell, np.where(ends >= k, rows[:, k - 1] * _SLACK, np.inf))
        named = tile.select([key, "tile", *_AXES, "weight"]).append_column("mean_distance", _mean(rows, ends))
        # the lists of open points are merged with those of other tiles
        kept = ends if lists else np.where(leaves, ends, 0)
        return named.append_column("distances", _leading(rows, kept)).append_column("open", leaves)

    points_by, cells_by = (spread(df, key, "tile").groupBy(key, "tile") for df in (tiling.points, tiling.cells))
    own = cut(points_by.cogroup(cells_by).applyInArrow(settled, f"{own_schema}, open boolean"))
    kth = F.try_element_at("distances", F.lit(k))
    beyond = own.filter("open")
    queries = _bounded(beyond, k, key, tiling, F.size("distances"), kth).select(
        key, *_AXES, "reach", F.col("tile").alias("home")
    )
    visits = cut(_tiles_in_reach(queries, tiling, key).select(key, *_AXES, "reach", "tile"))
    visit = (key, "tile", "salt")
    asked, copies = _salted(visits, tiling.points, key)
    cross_schema = f"{key} {key_type}, x double, y double, z double, distances array<double>"

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select([key, *_AXES]).append_column("distances", pa.array([[]] * left.num_rows, pa.list_(pa.float64()))).slice(0, 0)
        found = _leading(*_distance_rows(left, right, k, _numbers(left, "reach")))
        table = left.select([key, *_AXES]).append_column("distances", found)
        return table.filter(pa.compute.greater(pa.compute.list_value_length(found), 0))

    cross = (
        spread(asked, *visit).groupBy(*visit).cogroup(spread(copies, *visit).groupBy(*visit))
        .applyInArrow(across, cross_schema)
    )
    merged = beyond.select(key, *_AXES, "weight", "distances").unionByName(cross, allowMissingColumns=True)
    all_found = F.array_sort(F.flatten(F.collect_list("distances")))
    merged = merged.groupBy(key, *_AXES).agg(F.max("weight").alias("weight"), F.slice(all_found, 1, k).alias("distances"))
    return own.filter("NOT open").drop("tile", "open"), merged


def nearest_distances(points: DataFrame, k: int, key: str = "cloud_id", tile_points: int = TILE_POINTS) -> DataFrame:
    """Sorted distances to the ``k`` nearest points, the point itself included, per distinct coordinate.

    Returns ``(key, x, y, z, weight, distances)``. Fewer than ``k`` entries mean the whole cloud has fewer points.
    """
    columns = (key, *_AXES, "weight", "distances")
    settled, merged = _distances(points, k, key, tile_points, True)
    return settled.select(*columns) if merged is None else settled.select(*columns).unionByName(merged)


def mean_distances(points: DataFrame, k: int, key: str = "cloud_id", tile_points: int = TILE_POINTS) -> DataFrame:
    """``(key, x, y, z, weight, mean_distance)``: the mean of what :func:`nearest_distances` lists.

    The lists themselves are written for those points only that other tiles have a part in.
    """
    columns = (key, *_AXES, "weight", "mean_distance")
    settled, merged = _distances(points, k, key, tile_points, False)
    if merged is None:
        return settled.select(*columns)
    mean = F.aggregate("distances", F.lit(0.0), lambda acc, d: acc + d) / F.size("distances")
    return settled.select(*columns).unionByName(merged.withColumn("mean_distance", mean).select(*columns))


def radius_counts(
    points: DataFrame,
    radius: float,
    key: str = "cloud_id",
    enough: int | None = None,
    tile_points: int = TILE_POINTS,
) -> DataFrame:
    """Points within ``radius`` of each distinct coordinate, the point itself included.

    Returns ``(key, x, y, z, weight, neighbors)``. With ``enough`` a coordinate that has more than that many in its
    own tile is not searched further, so counts above ``enough`` are lower bounds. Tiles that lie wholly inside
    the ball add their size without being visited.
    """
    tiling = build_tiles(_merge_equal(points, key), key, tile_points)
    key_type = dict(points.dtypes)[key]
    limit = radius * radius

    def weights_in_reach(queries: pa.Table, targets: pa.Table) -> pa.Array:
        if not queries.num_rows:
            return pa.array([], pa.int64())
        at, weights = _coordinates(queries), _numbers(targets, "weight")
        tree, found = _Tree(_coordinates(targets), weights), np.zeros(len(at), dtype=np.int64)
        asked, dense = tree if queries is targets else _Tree(at), np.zeros(0, dtype=bool)
        if queries is targets and enough is not None:
            # a leaf no wider than the radius is inside the balls of its own points
            sides = (tree.high - tree.low)[tree.leaves] ** 2
            dense = (sides[:, 0] + sides[:, 1] + sides[:, 2] <= limit) & (tree.weight[tree.leaves] > enough)
        for leaf, block in enumerate(asked.blocks()):
            if dense.size and dense[leaf]:
                found[block] = tree.weight[tree.leaves[leaf]]
            else:
                found[block] = tree.count(at[block], limit, weights, enough)
        return pa.array(found)

    def inside(tile: pa.Table) -> pa.Table:
        return tile.select([key, "tile", *_AXES, "weight"]).append_column("neighbors", weights_in_reach(tile, tile))

    own_schema = f"{key} {key_type}, tile bigint, x double, y double, z double, weight bigint, neighbors bigint"
    if not tiling.levels:
        return spread(tiling.points, key, "tile").groupBy(key, "tile").applyInArrow(inside, own_schema).drop("tile")

    def found(tile: pa.Table) -> tuple[pa.Array, np.ndarray]:
        return weights_in_reach(tile, tile), np.full(tile.num_rows, radius * _SLACK)

    own = _own_tiles(tiling, key, found, "neighbors", own_schema)
    more = F.lit(True) if enough is None else F.col("neighbors") <= enough
    queries = own.filter(F.col("open") & more).select(key, *_AXES, F.lit(radius).alias("reach"), F.col("tile").alias("home"))
    visits = cut(_tiles_in_reach(queries, tiling, key).select(key, *_AXES, "tile", "tile_weight", "covered"))
    visit = (key, "tile", "salt")
    asked, copies = _salted(visits.filter("not covered"), tiling.points, key)

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        return left.select([key, *_AXES]).append_column("neighbors", weights_in_reach(left, right))

    cross = (
        spread(asked, *visit).groupBy(*visit).cogroup(spread(copies, *visit).groupBy(*visit))
        .applyInArrow(across, f"{key} {key_type}, x double, y double, z double, neighbors bigint")
    )
    covered = visits.filter("covered").select(key, *_AXES, F.col("tile_weight").alias("neighbors"))
    columns = (key, *_AXES, "weight", "neighbors")
    merged = own.filter(F.col("open") & more).select(*columns).unionByName(cross, True).unionByName(covered, True)
    merged = merged.groupBy(key, *_AXES).agg(F.max("weight").alias("weight"), F.sum("neighbors").alias("neighbors"))
    return own.filter(~(F.col("open") & more)).select(*columns).unionByName(merged)


def nearest_neighbors(
    points: DataFrame, k: int, key: str = "cloud_id", id_column: str = "point_id", tile_points: int = TILE_POINTS
) -> DataFrame:
    """The ``k`` nearest other points of each point as ``(key, id, neighbor_rank, neighbor_id, distance)``.

    Ties go to the smaller id; ``id_column`` must be unique within a key. Of many points at one place only the
    ``k + 1`` smallest ids can ever be an answer, so only those are carried.
    """
    key_type, id_type = dict(points.dtypes)[key], dict(points.dtypes)[id_column]
    finite = points.select(key, F.col(id_column).alias("id"), *_AXES).filter(
        ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    )
    # the row_number limit is applied before the shuffle as well, so copies do not pile up
    same_place = Window.partitionBy(key, *_AXES).orderBy("id")
    kept = finite.withColumn("_rank", F.row_number().over(same_place)).filter(F.col("_rank") <= k + 1)
    places = kept.groupBy(key, *_AXES).agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("weight")
    )
    tiling = build_tiles(places, key, max(tile_points, k + 1))
    hit = f"array<struct<distance:double,id:{id_type}>>"
    hit_type = pa.struct([("distance", pa.float64()), ("id", to_arrow_type(points.schema[id_column].dataType))])

    def hits(queries: pa.Table, targets: pa.Table, reach: np.ndarray | None) -> pa.Array:
        if not queries.num_rows:
            return pa.array([], pa.list_(hit_type))
        groups = targets["ids"].combine_chunks()
        flat = groups.flatten().to_numpy()
        sizes = pa.compute.list_value_length(groups).to_numpy()
        first = np.cumsum(sizes) - sizes
        at, tree = _coordinates(queries), _Tree(_coordinates(targets))
        distances, ids = [np.empty(0)] * len(at), [flat[:0]] * len(at)
        for block in (tree if queries is targets else _Tree(at)).blocks():
            found, parts, _ = tree.candidates(at[block], k + 1, None if reach is None else reach[block])
            if not found:
                continue
            among = np.concatenate(found)
            copies = sizes[among]
            place = np.repeat(np.arange(len(among)), copies)
            names = flat[np.arange(copies.sum()) + np.repeat(first[among] - np.cumsum(copies) + copies, copies)]
            # ties between places are settled by id
            for row, line in zip(block, np.sqrt(np.concatenate(parts, axis=1))[:, place]):
                bound = np.partition(line, k)[k] if len(line) > k + 1 else np.inf
                if reach is not None:
                    bound = min(bound, reach[row])
                near = np.flatnonzero(line <= bound)
                near = near[np.lexsort((names[near], line[near]))][: k + 1]
                distances[row] = line[near]
                ids[row] = names[near]
        values = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(distances)), pa.array(np.concatenate(ids), hit_type["id"].type)], fields=list(hit_type)
        )
        return _lists(distances, values)

    def inside(tile: pa.Table) -> pa.Table:
        return tile.select([key, "tile", *_AXES, "weight"]).append_column("hits", hits(tile, tile, None))

    own_schema = f"{key} {key_type}, tile bigint, x double, y double, z double, weight bigint, hits {hit}"
    if not tiling.levels:
        merged = spread(tiling.points, key, "tile").groupBy(key, "tile").applyInArrow(inside, own_schema).drop("tile", "weight")
    else:
        def found(tile: pa.Table) -> tuple[pa.Array, np.ndarray]:
            lists = hits(tile, tile, None)
            ends, size = lists.offsets.to_numpy()[1:], pa.compute.list_value_length(lists).to_numpy()
            last = lists.values.field("distance").to_numpy()[np.maximum(ends - 1, 0)]
            return lists, np.where(size > k, last * _SLACK, np.inf)

        own = _own_tiles(tiling, key, found, "hits", own_schema)
        kth = F.try_element_at("hits", F.lit(k + 1))["distance"]
        beyond = own.filter("open")
        queries = _bounded(beyond, k + 1, key, tiling, F.size("hits"), kth).select(
            key, *_AXES, "reach", F.col("tile").alias("home")
        )
        visits = cut(_tiles_in_reach(queries, tiling, key).select(key, *_AXES, "reach", "tile"))
        visit = (key, "tile", "salt")
        asked, copies = _salted(visits, tiling.points, key)

        def across(left: pa.Table, right: pa.Table) -> pa.Table:
            found = hits(left, right, _numbers(left, "reach"))
            return left.select([key, *_AXES]).append_column("hits", found)

        cross = (
            spread(asked, *visit).groupBy(*visit).cogroup(spread(copies, *visit).groupBy(*visit))
            .applyInArrow(across, f"{key} {key_type}, x double, y double, z double, hits {hit}")
        )
        columns = (key, *_AXES, "hits")
        merged = beyond.select(*columns).unionByName(cross).groupBy(key, *_AXES).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits")
        )
        merged = own.filter("NOT open").select(*columns).unionByName(merged)
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)
    return (
        finite.join(merged, [key, *_AXES])
        .select(key, F.col("id").alias(id_column), F.posexplode(others).alias("_at", "_hit"))
        .select(
            key, id_column, (F.col("_at") + 1).alias("neighbor_rank"),
            F.col("_hit.id").alias("neighbor_id"), F.col("_hit.distance").alias("distance"),
        )
    )
