import math
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import capfilters
from plumbline.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, ball int, dim string"


def brute(rows, threshold=0.9):
    """Links and components over all pairs."""
    ok = [i for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, pairs = Counter(), 0
    for dim in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in own], np.float32).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links.update((own[a], own[b]))
            pairs += 1
            root[max(find(own[a]), find(own[b]))] = min(find(own[a]), find(own[b]))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = [(r[0], links[i], least.get(find(i)), r[0] is not None and r[0] == least[find(i)]) for i, r in enumerate(rows)]
    return sorted(out, key=repr), pairs


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in capfilters.near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def turned(draw, x, cosine):
    y = draw.normal(size=x.shape)
    y -= (x @ y) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_clusters_and_defined_cases(spark):
    """Dense groups around each radius, copies, odd rows: figures of all pairs."""
    draw = np.random.default_rng(5)
    vectors = list(draw.normal(size=(600, 24)))
    for spread in (0.999, 0.99, 0.97):
        center = draw.normal(size=24)
        vectors += [turned(draw, center, spread) * draw.uniform(0.1, 10) for _ in range(200)]
    vectors += [np.ones(24)] * 300 + [np.ones(24) * 3] * 5
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [math.nan] + [1.0] * 23), (5004, [math.inf] * 24), (5005, [None] + [1.0] * 23)]
    rows += [(None, [1.0] * 24), (None, None), (3, [1.0] * 24), (5006, [1.0] * 7), (5007, [2.0] * 7), (5008, [-1.0] * 7), (5009, [4.0]), (5010, [9.0]), (5011, [-1.0])]
    want, _ = brute(rows)
    assert found(spark, rows) == want


def test_mixed_balls(spark):
    """Groups whose balls are linked in part: members are compared one by one."""
    draw = np.random.default_rng(6)
    center = draw.normal(size=16)
    rows = [(i, turned(draw, center, c).tolist()) for i, c in enumerate(draw.uniform(0.9, 1, 900))]
    want, _ = brute(rows)
    got = found(spark, rows)
    assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("dim", [2, 5, 64])
def test_recall_at_the_threshold(spark, dim):
    """Pairs just above the threshold are found, those just below never."""
    draw = np.random.default_rng(dim)
    rows = []
    for i in range(700):
        x = draw.normal(size=dim)
        rows += [(2 * i, x.tolist()), (2 * i + 1, turned(draw, x, 0.9001 if i % 2 else 0.8999).tolist())]
    want, pairs = brute(rows)
    got = found(spark, rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    recall = sum(g[1] for g in got) / (2 * pairs)
    assert recall >= 0.95, recall


def test_few_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(7, [1.0, 2.0])]) == [(7, 0, 7, True)]
    assert found(spark, [(9, [1.0, 2.0]), (8, [1.0, 2.0])]) == [(8, 1, 8, True), (9, 1, 8, False)]


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = LLM_QUERIES["op11_cap_filters"](spark, path).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)[0]
