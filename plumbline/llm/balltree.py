"""Exact inner-product search: ball trees over shards, branch and bound with a shared k-th score.

Vectors are quantised to integers, packed by 256 and dealt over shards of about ``shard_vectors``. A task builds the
ball trees of its shard once and then meets the query packs one after the other. A query walks a tree best first:
nodes wait in a heap by the upper bound ``q.c + |q| r`` of any inner product in their ball, and the walk ends when the
best bound is below the query's k-th score. That score is shared in two waves: every query pack first visits one
shard, dealt by a hash, and takes the k-th score found there to all others as a floor.

The result is exact. Upper bounds carry a slack for rounding, scores are integers, and nodes that only tie the k-th
score are still visited, because a smaller id wins a tie.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
vectors of other lengths than the query's are no candidates; rows with the query's own id are no candidates; a
repeated query row gets its result again; scores beyond a long saturate; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions
from plumbline.session import cut

SCALE = 1024
K = 10
PACK = 256
SHARD_VECTORS = 8192
LEAF = 64

_NONE = -(1 << 63)
_LONG = (-(1 << 63), (1 << 63) - 1)
_PACKS = "dim int, ids binary, vectors binary"


def usable(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    infinite = float("inf")
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))


def pack(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows of (id, vector) as packs of up to 256 vectors of one length, quantised to floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def packed(dim: int, rows: list) -> pa.RecordBatch:
            ids, vectors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)
            ints = np.clip(np.floor(vectors * scale), -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([ints.tobytes()], pa.binary()),
            })

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                rows = waiting.setdefault(len(vector), [])
                rows.append((key, vector))
                if len(rows) == PACK:
                    yield packed(len(vector), waiting.pop(len(vector)))
        for dim, rows in waiting.items():
            yield packed(dim, rows)

    return vectors.mapInArrow(run, _PACKS).withColumn("uid", F.monotonically_increasing_id())


@dataclass
class Tree:
    """A ball tree: node i holds rows ``start[i]:end[i]`` and has the children ``child[i]`` and ``child[i] + 1``, or 0."""

    ids: np.ndarray
    rows: np.ndarray
    exact: np.ndarray
    start: list[int]
    end: list[int]
    child: list[int]
    center: np.ndarray
    radius: np.ndarray
    largest: int


def build(ids: np.ndarray, ints: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split at the median of the widest component, by rank, so that equal vectors do not deepen the tree."""
    order, rows = np.arange(len(ids)), ints.astype(np.float64)
    start, end, child, center, radius = [0], [len(ids)], [0], [], []
    node = 0
    while node < len(start):
        own = rows[order[start[node] : end[node]]]
        middle = own.mean(axis=0)
        center.append(middle)
        radius.append(float(np.sqrt(((own - middle) ** 2).sum(axis=1).max())))
        size = len(own)
        if size > leaf and radius[-1] > 0:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = size // 2
            part = np.argpartition(own[:, axis], half)
            order[start[node] : end[node]] = order[start[node] : end[node]][part]
            child[node] = len(start)
            start += [start[node], start[node] + half]
            end += [start[node] + half, end[node]]
            child += [0, 0]
        node += 1
    largest = max(abs(int(ints.min(initial=0))), abs(int(ints.max(initial=0))))
    return Tree(ids[order], rows[order], ints[order], start, end, child, np.array(center), np.array(radius), largest)


def best(tree: Tree, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query in one tree, padded with the least long; scores below the floor may be left out."""
    q = queries.astype(np.float64)
    norm = np.sqrt((q * q).sum(axis=1))
    inner = q @ tree.center.T
    reach = norm[:, None] * tree.radius[None, :]
    upper = inner + reach + 1e-9 * (np.abs(inner) + reach + norm[:, None] * np.sqrt((tree.center**2).sum(axis=1))[None, :]) + 1e-6
    exact = tree.largest * max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0)))) * max(1, queries.shape[1]) < 2**53
    out_scores, out_ids = np.full((len(ids), k), _NONE, np.int64), np.full((len(ids), k), _NONE, np.int64)
    for row in range(len(ids)):
        bound, vector, own = upper[row].tolist(), q[row], ids[row]
        kth, scores, found = int(floors[row]), np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            value, node = heapq.heappop(heap)
            if -value < kth:
                break
            if child := tree.child[node]:
                for c in (child, child + 1):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (max(value, -bound[c]), c))
                continue
            span = slice(tree.start[node], tree.end[node])
            if exact:
                got = (tree.rows[span] @ vector).astype(np.int64)
            else:
                got = np.array([min(max(sum(map(int.__mul__, x, queries[row].tolist())), _LONG[0]), _LONG[1]) for x in tree.exact[span].tolist()], np.int64)
            keep = np.flatnonzero((got >= kth) & (tree.ids[span] != own))
            if not keep.size:
                continue
            scores, found = np.concatenate((scores, got[keep])), np.concatenate((found, tree.ids[span][keep]))
            top = np.lexsort((found, -1 - scores))[:k]
            scores, found = scores[top], found[top]
            if len(scores) == k:
                kth = max(kth, int(scores[-1]))
        out_scores[row, : len(scores)], out_ids[row, : len(found)] = scores, found
    return out_scores, out_ids


def _longs(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(shape)


_FOUND = "uid long, home int, dim int, ids binary, vectors binary, floors binary, scores binary, found binary"


def visit(data: DataFrame, queries: DataFrame, k: int, leaf: int) -> DataFrame:
    """Query packs with the best of the shard they visit; ``data`` and ``queries`` have a ``shard``."""
    empty = F.lit(None).cast("binary")
    rows = data.select("shard", F.lit(0).alias("kind"), "uid", F.lit(-1).alias("home"), "dim", "ids", "vectors", empty.alias("floors")).unionAll(
        queries.select("shard", F.lit(1), "uid", "home", "dim", "ids", "vectors", "floors")
    )
    rows = rows.repartition(partitions(data.sparkSession), "shard").sortWithinPartitions("shard", "kind", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, trees = None, {}, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "uid", "home", "dim", "ids", "vectors", "floors")]
            for shard, kind, uid, home, dim, ids, vectors, floors in zip(*columns):
                if shard != current:
                    current, parts, trees = shard, {}, {}
                ids = _longs(ids, -1)
                ints = _longs(vectors, len(ids), dim)
                if kind == 0:
                    parts.setdefault(dim, []).append((ids, ints))
                    continue
                if dim in parts:
                    trees[dim] = build(*map(np.concatenate, zip(*parts.pop(dim))), leaf)
                low = _longs(floors, -1) if floors is not None else np.full(len(ids), _NONE, np.int64)
                if dim in trees:
                    scores, found = best(trees[dim], ids, ints, low, k)
                else:
                    scores = found = np.full((len(ids), k), _NONE, np.int64)
                row = (uid, home, dim, ids.tobytes(), vectors, np.maximum(low, scores[:, -1]).tobytes(), scores.tobytes(), found.tobytes())
                types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
                names = ["uid", "home", "dim", "ids", "vectors", "floors", "scores", "found"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return rows.mapInArrow(run, _FOUND)


def merged(visits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from all visits of each query pack, one pack in memory at a time."""
    rows = visits.select("uid", "ids", "scores", "found").repartition(partitions(visits.sparkSession), "uid").sortWithinPartitions("uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, scores, found):
            rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), scores.shape)
            # an unused place holds the least long as id and score
            used = ~((scores == _NONE) & (found == _NONE))
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.broadcast_to(ids[:, None], scores.shape)[used], rank[used], found[used], scores[used])],
                names=["query_id", "rank", "vec_id", "score"],
            )

        current = None
        for batch in batches:
            for uid, ids, scores, found in zip(*[c.to_pylist() for c in batch.columns]):
                ids = _longs(ids, -1)
                scores, found = _longs(scores, len(ids), k), _longs(found, len(ids), k)
                if current and current[0] == uid:
                    scores, found = np.hstack((current[2], scores)), np.hstack((current[3], found))
                    unused = (scores == _NONE) & (found == _NONE)
                    top = np.lexsort((found, -1 - scores, unused), axis=1)[:, :k]
                    scores, found = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
                elif current:
                    yield done(*current[1:])
                current = (uid, ids, scores, found)
        if current:
            yield done(*current[1:])

    return rows.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def top_k(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
    scale: int = SCALE, shard_vectors: int = SHARD_VECTORS, leaf: int = LEAF,
) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows, ties to the smaller id."""
    def packs(df: DataFrame) -> DataFrame:
        kept = df.filter(F.col(vec_id).isNotNull() & usable(vector))
        return cut(pack(kept.select(F.col(vec_id).cast("long"), vector), scale))

    data, asked = packs(vectors), packs(queries)
    total = data.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_vectors))
    dealt = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    data = data.withColumn("shard", dealt)
    asked = asked.withColumn("home", dealt).withColumn("floors", F.lit(None).cast("binary"))
    first = cut(visit(data, asked.withColumn("shard", F.col("home")), k, leaf))
    if shards == 1:
        return merged(first, k)
    others = first.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    return merged(first.unionAll(visit(data, others, k, leaf)), k)
