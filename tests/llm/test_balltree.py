import math
import random

import numpy as np

from plumbline.llm import balltree


def brute(rows, k=10):
    ok = [
        (i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in ok:
        if i % 100 == 0:
            found = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)]
            out += [(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, ids int").repartition(5)
    return sorted(tuple(r) for r in balltree.top_k(df, df.filter("vec_id % 100 = 0"), **options).collect())


def rows():
    draw = random.Random(4)
    out = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(2000)]
    out += [(i, [1.0, 2.0, 0.0, -1.0, 0.5, 0.25]) for i in range(2000, 3000)]
    out += [(i, [draw.choice([0.0, 1.0]) for _ in range(6)]) for i in range(3000, 3400)]
    out += [(3400, None), (3500, [1.0, None, 0, 0, 0, 0]), (3600, [math.nan] * 6), (3700, [math.inf] * 6), (None, [9.0] * 6)]
    out += [(3800, [1.0, 2.0]), (3900, [2.0, 3.0]), (4000, []), (4100, [0.0] * 6)]
    return out


def test_matches_brute_force(spark):
    want = brute(rows())
    assert search(spark, rows()) == want
    assert search(spark, rows(), shard_vectors=300, leaf=7) == want


def test_large_components(spark):
    data = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [3e6, 4e6]), (3, [-1e30, 5.0]), (100, [2e6, 1.0])]
    got = search(spark, data)
    assert [r[2] for r in got if r[0] == 0][-1] == 3 and got == sorted(got)
    assert [(r[2], r[3]) for r in got if r[0] == 100][:1] == [(0, (1 << 63) - 1)]


def test_few_and_none(spark):
    assert search(spark, [(0, [1.0]), (5, [2.0])]) == [(0, 1, 5, 1024 * 2048)]
    assert search(spark, []) == [] and search(spark, [(0, [1.0])]) == []


def test_pruning_leaves_nodes_out():
    """Clustered vectors: far fewer rows are scored than there are."""
    draw = np.random.default_rng(0)
    centers = draw.normal(0, 10_000, (40, 8))
    ints = np.floor(np.repeat(centers, 200, axis=0) + draw.normal(0, 10, (8000, 8))).astype(np.int64)
    tree = balltree.build(np.arange(8000), ints)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, slice):
                seen.append(len(out))
            return out

    tree.rows = tree.rows.view(Counted)
    scores, ids = balltree.best(tree, np.array([-1]), ints[:1], np.array([balltree._NONE]), 10)
    want = sorted(zip((-(ints @ ints[0])).tolist(), range(8000)))[:10]
    assert list(zip((-scores[0]).tolist(), ids[0].tolist())) == want
    assert sum(seen) < 2000
