import random
from collections import defaultdict

from plumbline.llm import mixing
from plumbline.llm.common import table
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def targets(sizes, weights=(5, 2, 1), most=3):
    """By rounds, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else each * weight[s]
        left -= sum(out[s] for s in over)
        open_ -= over or set(open_)
    return out


def check(rows, docs):
    """``rows`` of mix against (doc_id, source, text) of ``docs``."""
    size_of = lambda t: len((t or "").encode().split())
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, source, text in docs:
        sizes[source] += size_of(text)
        largest[source] = max(largest[source], size_of(text))
    want = targets(sizes)
    assert len(rows) == len(docs)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), size_of(t)) for d, _, t in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= largest[source] + 1e-6


def corpus():
    draw = random.Random(3)
    docs = [(i, draw.choice(["a", "a", "a", "B", None, "é"]), "w " * draw.randrange(60)) for i in range(1500)]
    docs += [(1, "a", "x y")] * 5 + [(None, "tiny", "one"), (7, "void", None), (8, "void", ""), (9, "b", "w\x0bw " * 20_000)]
    return docs


def test_mix_meets_targets(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    for parts, bucket_rows, fan_in in ((1, 8192, 64), (7, 30, 3)):
        rows = mixing.mix(df.repartition(parts), bucket_rows=bucket_rows, fan_in=fan_in).collect()
        check(rows, docs)
    again = mixing.mix(df.repartition(3), bucket_rows=30, fan_in=3).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_query(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "source", "text").collect()]
    source = {d: s for d, s, _ in docs}
    rows = LLM_QUERIES["op10_mix_sources"](spark, SF).collect()
    from pyspark.sql import Row
    check([Row(**r.asDict(), source=source[r.doc_id]) for r in rows], docs)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string, size int")).count() == 0


def test_transfer_keeps_words_and_expectation():
    draw = random.Random(5)
    for _ in range(300):
        p, q, s, t = draw.uniform(0.01, 0.99), draw.uniform(0.01, 0.99), draw.randrange(1, 90), draw.randrange(1, 90)
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        rise = down / (up + down)
        ends = [mixing.transfer(p, s, q, t, u) for u in (rise * 0.999, rise + (1 - rise) * 0.001)]
        for a, b in ends:
            assert abs(a * s + b * t - p * s - q * t) < 1e-9 and (a in (0.0, 1.0) or b in (0.0, 1.0))
            assert -1e-12 <= a <= 1 + 1e-12 and -1e-12 <= b <= 1 + 1e-12
        assert abs(rise * ends[0][0] + (1 - rise) * ends[1][0] - p) < 1e-9
