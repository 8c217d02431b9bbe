"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is the cap of all unit vectors whose inner product with a direction is ``alpha`` or more. Directions are not
stored: each is a product of one short random word a block, so a code of a few hundred words a block stands for
millions of directions, and a vector is list-decoded to all caps it lies in by extending only such products of words
that can still reach ``alpha``. Vectors meet in the caps they share. ``alpha``, the words and the number of independent
codes follow from the number of vectors: caps become so small that a quarter of an unrelated vector is expected in
one, and the codes so many that simulated pairs at the threshold itself share a cap in 98 of 100 cases.

Dense groups never become lists of pairs. Vectors are sorted by a coarse code and merged into balls small enough that all
members of one are linked by the triangle inequality. Balls, most of them a single vector, are what meets in caps, by
the caps of any member. A pair of balls is linked or unlinked as a whole where the distance of their centers and
their radii decide it, and then only adds a size to a counter; the rest is compared in packs of 256 members. Single
vectors that meet are first compared by 64 signs (a pair at the threshold passes in 9,999 of 10,000 cases), then
verified in double precision. So each reported link is exact; a link is found or not by its caps.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths are not linked; repeated rows are vectors of their own; a row without an id takes part in links, never
names a component and is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from plumbline.llm.common import partitions
from plumbline.llm.components import components
from plumbline.session import cut

THRESHOLD = 0.9
#: share of simulated pairs at the threshold that meet in a cap
FOUND = 0.98
#: expected unrelated vectors in a cap
CROWD = 0.25
#: caps of a vector in one code
MOST_CAPS = 100
WINDOW = 2048
CARRIED = 256
PACK = 256
SIGNS, MOST_SIGNS = 64, 4.2

_SLACK = 1e-6
_TRIALS = 400


def cap_height(dim: int, share: float) -> float:
    """The inner product that a unit vector has with a random direction with probability ``share``."""
    if dim < 2:
        return 0.9
    t = np.linspace(-1, 1, 200_001)[1:-1]
    above = 1 - np.cumsum(w := (1 - t * t) ** ((dim - 3) / 2)) / w.sum()
    return float(t[np.searchsorted(-above, -share)])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Code:
    """``repeats`` independent product codes of ``blocks`` blocks with ``words`` words each, for caps of height ``alpha``."""

    dim: int
    blocks: int
    words: int
    alpha: float
    repeats: int

    def drawn(self, repeat: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The rotation, the blocks' limits and their words; a task draws them once."""
        known = self.__dict__.setdefault("_known", {})
        if repeat not in known:
            draw = np.random.default_rng([self.dim, self.blocks, self.words, repeat])
            turn = np.linalg.qr(draw.normal(size=(self.dim, self.dim)))[0]
            cuts = np.linspace(0, self.dim, self.blocks + 1).astype(int)
            words = [draw.normal(size=(self.words, b - a)) for a, b in zip(cuts, cuts[1:])]
            known[repeat] = turn, cuts, [w / (np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(self.blocks)) for w in words]
        return known[repeat]

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cap) for every cap that a unit vector lies in."""
        found = []
        for repeat in range(self.repeats):
            turn, cuts, words = self.drawn(repeat)
            turned = rows @ turn
            products = [turned[:, a:b] @ w.T for a, b, w in zip(cuts, cuts[1:], words)]
            best = np.array([p.max(axis=1) for p in products])
            row, total, code = np.arange(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            for block, product in enumerate(products):
                # words that reach alpha with the best of all other blocks, in ascending order for each row
                at, word = np.nonzero(product >= (self.alpha - best.sum(axis=0) + best[block])[:, None])
                order = np.argsort(key := 4.0 * at + product[at, word])
                key, value, word = key[order], product[at, word][order], word[order]
                least = self.alpha - total - best[block + 1 :].sum(axis=0)[row]
                first = np.searchsorted(key, 4.0 * row + np.clip(least, -1.9, 1.9))
                count = np.maximum(np.searchsorted(key, 4.0 * row + 1.95) - first, 0)
                grown = np.repeat(np.arange(len(row)), count)
                take = np.arange(len(grown)) - np.repeat(np.cumsum(count) - count, count) + first[grown]
                row, total, code = row[grown], total[grown] + value[take], code[grown] * self.words + word[take]
            name = (code * 256 + repeat) * 0x1E3779B97F4A7C15 + (self.dim << 40)
            found.append((row, name ^ (name >> 29)))
        row, cap = (np.concatenate(x) for x in zip(*found))
        return row, cap


def _tried(code: Code, threshold: float) -> tuple[float, float]:
    """Share of random pairs at ``threshold`` that meet in a cap of a code with a single repeat, and the caps of a vector."""
    draw = np.random.default_rng(code.dim)
    a, b = (unit(draw.normal(size=(_TRIALS, code.dim))) for _ in range(2))
    if code.dim == 1:
        b = a
    else:
        b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        b = threshold * a + math.sqrt(1 - threshold**2) * b
    mine, others = (set(zip(*map(np.ndarray.tolist, code.decode(x)))) for x in (a, b))
    return len({row for row, _ in mine & others}) / _TRIALS, len(mine) / _TRIALS


def fit_code(dim: int, vectors: int, threshold: float = THRESHOLD, found: float = FOUND) -> Code:
    """The code for so many vectors of a length: fewest blocks, then fewest words, that find a third of the pairs at a time.

    Where that takes more than ``MOST_CAPS`` caps a vector, as it does in few dimensions, caps are made larger.
    """
    alpha = cap_height(dim, CROWD / max(vectors, 256))
    while True:
        for blocks in range(min(2, dim), min(4, dim) + 1):
            for words in (16, 32, 64, 128, 256, 512, 1024):
                share, caps = _tried(Code(dim, blocks, words, alpha, 1), threshold)
                if caps > MOST_CAPS:
                    break
                if share >= 0.3:
                    repeats = 1 if share >= found else math.ceil(math.log(1 - found) / math.log(1 - share))
                    return Code(dim, blocks, words, alpha, repeats)
        alpha -= 0.05


def signs(rows: np.ndarray) -> np.ndarray:
    """The signs of 64 random inner products as a long."""
    planes = np.random.default_rng(rows.shape[1]).normal(size=(rows.shape[1], SIGNS))
    return np.packbits(rows @ planes >= 0, axis=1).view(np.int64).ravel()


def most_signs(threshold: float) -> int:
    """Differing signs that a pair at the threshold hardly exceeds."""
    p = math.acos(threshold) / math.pi
    return math.floor(SIGNS * p + MOST_SIGNS * math.sqrt(SIGNS * p * (1 - p)))


def usable(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Unit vectors from binary cells of one length."""
    return unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, dim, home, vec): the components as bytes, and a coarse code for sorting: the nearest of 32 directions, four times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector").to_numpy(zero_copy_only=False)
            cells = [np.asarray(v, kind) for v in values]
            dims = np.array([len(c) for c in cells], np.int32)
            home = np.zeros(len(cells), np.int64)
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                rows = unit(np.array([cells[i] for i in of], np.float64))
                directions = np.random.default_rng(int(dim)).normal(size=(dim, 4, 32))
                near = np.argmax(np.einsum("nd,dlw->nlw", rows, directions), axis=2)
                home[of] = near @ (32 ** np.arange(3, -1, -1))
            arrays = [batch.column("vec_id"), pa.array(dims), pa.array(home), pa.array([c.tobytes() for c in cells], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "dim", "home", "vec"])

    return vectors.mapInArrow(run, "vec_id long, dim int, home long, vec binary")


_BALLS = pa.schema([
    ("uid", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("ball", pa.int64()),
    ("size", pa.int64()), ("radius", pa.float64()), ("least", pa.int64()),
])


class _Ball:
    """A ball that may still grow; its id is that of its first member, its center."""

    def __init__(self, uid: int, vec: bytes, center: np.ndarray) -> None:
        self.uid, self.vec, self.center, self.size, self.radius, self.least = uid, vec, center, 0, 0.0, None

    def add(self, rows: np.ndarray, ids: list) -> None:
        # the slack covers the rounding of arccos near 1
        self.radius = max(self.radius, float(np.arccos(np.clip(rows @ self.center, -1, 1)).max()) + _SLACK / 10)
        self.size += len(ids)
        self.least = min((i for i in (self.least, *ids) if i is not None), default=None)

    def row(self, dim: int) -> tuple:
        return None, None, dim, self.vec, self.uid, self.size, self.radius, self.least


def balls(packed: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Members (uid, vec_id, dim, vec, ball), and a row with size, radius and least id for each ball; a lone vector is both in one row.

    Rows pass in windows of 2,048 in sorted order; the 256 largest balls are carried from window to window, so a dense
    group makes few balls a task, however large it is.
    """
    close = math.cos((math.acos(threshold) - _SLACK) / 2)
    order = [F.col(c) for c in ("dim", "home", "uid")]
    spread = packed.repartitionByRange(partitions(packed.sparkSession), *order).sortWithinPartitions(*order)

    def window(batch: pa.RecordBatch, dim: int, carried: list[_Ball]) -> tuple[list[tuple], list[_Ball]]:
        rows, uids, ids, cells = _rows(batch.column("vec"), dim, kind), *(batch.column(c).to_pylist() for c in ("uid", "vec_id", "vec"))
        owner: list[_Ball | None] = [None] * len(uids)
        opened = list(carried)
        free = np.ones(len(uids), bool)

        def put(ball: _Ball, members: np.ndarray) -> None:
            ball.add(rows[members], [ids[m] for m in members])
            free[members] = False
            for m in members:
                owner[m] = ball

        if carried:
            near = rows @ np.array([b.center for b in carried]).T
            nearest = near.argmax(axis=1)
            fits = near[np.arange(len(rows)), nearest] >= close
            for at in np.unique(nearest[fits]):
                put(carried[at], np.flatnonzero(fits & (nearest == at)))
        near = (rows @ rows.T >= close) & free[:, None] & free[None, :]
        for at in np.flatnonzero(near.sum(axis=1) > 1):
            members = np.flatnonzero(near[at] & free)
            if free[at] and len(members) > 1:
                opened.append(_Ball(uids[at], cells[at], rows[at]))
                put(opened[-1], members)
        out = [
            (uid, vec_id, dim, cell, uid, 1, 0.0, vec_id) if ball is None else (uid, vec_id, dim, cell, ball.uid, None, None, None)
            for uid, vec_id, cell, ball in zip(uids, ids, cells, owner)
        ]
        opened.sort(key=lambda b: -b.size)
        return out + [b.row(dim) for b in opened[CARRIED:]], opened[:CARRIED]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BALLS.types)], schema=_BALLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = [], None
        for batch in batches:
            for dim, own in _by_dim(batch):
                if last is not None and dim != last and carried:
                    yield table([b.row(last) for b in carried])
                    carried = []
                last = dim
                for start in range(0, own.num_rows, WINDOW):
                    rows, carried = window(own.slice(start, WINDOW), dim, carried)
                    yield table(rows)
        if carried:
            yield table([b.row(last) for b in carried])

    return spread.mapInArrow(run, "uid long, vec_id long, dim int, vec binary, ball long, size long, radius double, least long")


def postings(members: DataFrame, kind: str, codes: dict[int, Code]) -> DataFrame:
    """(cap, ball, signs) for every cap of a ball's members; only lone vectors have signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                for start in range(0, own.num_rows, WINDOW):
                    part = own.slice(start, WINDOW)
                    rows = _rows(part.column("vec"), dim, kind)
                    row, cap = codes[dim].decode(rows)
                    ball, lone = part.column("ball").to_numpy(), part.column("size").is_valid().to_numpy(zero_copy_only=False)
                    once = np.unique(np.stack((ball[row], cap)), axis=1, return_index=True)[1] if not lone.all() else np.arange(len(row))
                    row, cap = row[once], cap[once]
                    sign = pa.array(signs(rows)[row], pa.int64(), mask=~lone[row])
                    yield pa.RecordBatch.from_arrays([pa.array(cap), pa.array(ball[row]), sign], names=["cap", "ball", "signs"])

    return members.select("dim", "vec", "ball", "size").mapInArrow(run, "cap long, ball long, signs long")


def _pairs(postings_: DataFrame, threshold: float) -> DataFrame:
    """Balls a < b that share a cap."""
    a = postings_.select("cap", F.col("ball").alias("a"), F.col("signs").alias("signs_a"))
    b = postings_.select("cap", F.col("ball").alias("b"), F.col("signs").alias("signs_b"))
    differing = F.bit_count(F.col("signs_a").bitwiseXOR(F.col("signs_b")))
    return a.join(b, "cap").filter((F.col("a") < F.col("b")) & F.coalesce(differing <= most_signs(threshold), F.lit(True))).select("a", "b").distinct()


def _judged(pairs: DataFrame, found: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(a, b, size_a, size_b, whole) of the pairs that are linked as a whole, or where members have to be compared."""
    angle = math.acos(threshold)
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("ball").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("dim", "vec", "size", "radius")]), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                cosine = np.einsum("nd,nd->n", *(_rows(own.column(f"vec_{s}"), dim, kind) for s in "ab"))
                reach = sum(own.column(f"radius_{s}").to_numpy() for s in "ab")
                apart = np.arccos(np.clip(cosine, -1, 1))
                whole = np.where(reach > 0, apart + reach <= angle - _SLACK, cosine >= threshold)
                keep = whole | ((reach > 0) & (apart - reach <= angle + _SLACK))
                columns = [own.column(c) for c in ("a", "b", "size_a", "size_b")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(whole)], names=["a", "b", "size_a", "size_b", "whole"]).filter(pa.array(keep))

    same = pairs.filter("dim_a = dim_b").withColumnRenamed("dim_a", "dim")
    columns = ("a", "b", "dim", *(f"{c}_{s}" for c in ("vec", "size", "radius") for s in "ab"))
    return same.select(*columns).mapInArrow(run, "a long, b long, size_a long, size_b long, whole boolean")


def _packs(members: DataFrame, kind: str) -> DataFrame:
    """(ball, dim, uids, rows): members by up to 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}
        held = 0

        def pack(key: tuple[int, int]) -> pa.RecordBatch:
            rows = waiting.pop(key)
            cells = (np.array([u for u, _ in rows], np.int64).tobytes(), unit(np.array([np.frombuffer(v, kind) for _, v in rows], np.float64)).tobytes())
            arrays = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]]
            return pa.RecordBatch.from_arrays(arrays, names=["ball", "dim", "uids", "rows"])

        for batch in batches:
            for ball, dim, uid, vec in zip(*[batch.column(c).to_pylist() for c in ("ball", "dim", "uid", "vec")]):
                rows = waiting.setdefault((ball, dim), [])
                rows.append((uid, vec))
                held += 1
                if len(rows) == PACK:
                    held -= PACK
                    yield pack((ball, dim))
            if held > 32 * PACK:
                for key in list(waiting):
                    yield pack(key)
                held = 0
        for key in list(waiting):
            yield pack(key)

    return members.select("ball", "dim", "uid", "vec").mapInArrow(run, "ball long, dim int, uids binary, rows binary")


def _compared(mixed: DataFrame, members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(ball, other, uid, n): the n members of another ball that a vector is linked with, for pairs that need comparing."""
    both = mixed.select("a", "b")
    involved = both.select(F.col("a").alias("ball")).unionAll(both.select("b")).distinct()
    packs = cut(_packs(members.join(involved, "ball", "left_semi"), kind))
    for side in ("a", "b"):
        both = both.join(packs.select(F.col("ball").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("dim", "uids", "rows")]), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("a", "b", "dim_a", "uids_a", "rows_a", "uids_b", "rows_b")
        for batch in batches:
            for a, b, dim, uids_a, rows_a, uids_b, rows_b in zip(*[batch.column(c).to_pylist() for c in names]):
                linked = np.frombuffer(rows_a).reshape(-1, dim) @ np.frombuffer(rows_b).reshape(-1, dim).T >= threshold
                for ball, other, uids, n in ((a, b, uids_a, linked.sum(axis=1)), (b, a, uids_b, linked.sum(axis=0))):
                    some = np.flatnonzero(n)
                    if some.size:
                        columns = (np.full(some.size, ball), np.full(some.size, other), np.frombuffer(uids, np.int64)[some], n[some].astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ball", "other", "uid", "n"])

    return both.mapInArrow(run, "ball long, other long, uid long, n long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, found: float = FOUND
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs found in a common cap whose cosine is ``threshold`` or more."""
    element = vectors.schema[vector].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind = "f4" if single else "f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    packed = cut(_packed(rows.filter(usable(F.col("vector"))), kind).withColumn("uid", F.monotonically_increasing_id()))
    # a vector's length is a property of the table: a few values
    counts = {r["dim"]: r["count"] for r in packed.groupBy("dim").count().collect()}
    codes = {dim: fit_code(dim, count, threshold, found) for dim, count in counts.items()}
    grouped = cut(balls(packed, kind, threshold))
    members, whole_balls = grouped.filter("uid IS NOT NULL"), grouped.filter("size IS NOT NULL")
    pairs = cut(_pairs(postings(members, kind, codes), threshold))
    judged = cut(_judged(pairs, whole_balls, kind, threshold))
    whole, mixed = judged.filter("whole"), judged.filter("NOT whole")
    compared = cut(_compared(mixed, members, kind, threshold))
    edges = whole.select("a", "b").unionAll(compared.filter("ball < other").select("ball", "other").distinct())
    rooted = components(edges)
    rooted = rooted.unionAll(rooted.select("root", "root").distinct())
    named = rooted.join(whole_balls.select(F.col("ball").alias("node"), "least"), "node")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("named")), "root").select(F.col("node").alias("ball"), "named")
    added = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).unionAll(whole.select("b", "size_a"))
    added = added.groupBy("ball").agg(F.sum("n").alias("added"))
    facts = whole_balls.select("ball", "size", "least").join(added, "ball", "left").join(named, "ball", "left")
    facts = cut(facts.select("ball", (F.col("size") - 1 + F.coalesce("added", F.lit(0))).alias("of_ball"), F.coalesce("named", "least").alias("component_id")))
    own = compared.groupBy("uid").agg(F.sum("n").alias("of_own"))
    linked = members.select("uid", "vec_id", "ball").join(facts, "ball").join(own, "uid", "left")
    lone = rows.filter(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = linked.select("vec_id", (F.col("of_ball") + F.coalesce("of_own", F.lit(0))).alias("n_links"), "component_id")
    return linked.unionAll(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
