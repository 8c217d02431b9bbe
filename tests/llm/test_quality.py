import zlib

import numpy as np

from plumbline.llm import quality
from plumbline.llm.common import table
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = LLM_QUERIES["op3_quality"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = (np.array([s for s, q in held if q == c]) for c in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (good >= 0.3).mean() > 0.95


def test_gradients_match_differences():
    draw = np.random.default_rng(3)
    bags = [draw.normal(size=(n, quality.N_FEATURES)).astype(np.float32) for n in (1, 3, 2, 5)] * 4
    y = np.array([0, 1, 1, 0] * 4)
    model = quality.fit(bags, y == 1, epochs=2)
    x, counts, weight = np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), np.linspace(1, 2, 16)

    def loss():
        p = model.forward(x, counts)["p"]
        return (weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    for name, g in model.gradients(x, counts, y.astype(float), weight).items():
        kept = model.weights[name]
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in kept.shape)
            ends = []
            for d in (1e-5, -1e-5):
                moved = np.array(kept, np.float64)
                moved[at] += d
                model.weights[name] = moved
                ends.append(loss())
            model.weights[name] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - np.asarray(g)[at]) < 1e-6


def docs(spark):
    rows = [(i, ("ha " * 70 if i % 2 else "some plain words that differ " + " ".join(f"w{(i + 1) * j}" for j in range(80)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "ha " * 80_000), (None, "fine"), (502, "ha " * 80_000)]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, quality string, score double").repartition(3)


def test_edge_texts_and_attention(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    model = quality.train(docs(spark), labels)
    rows = quality.score_texts(docs(spark), model, attention=True).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 and abs(sum(r.attention) - 1) < 1e-6 for r in rows)
    assert all(r.predicted == (r.doc_id % 2 == 0) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert [len(r.attention) for r in rows if r.doc_id == 502] == [1250, 1250]
    assert len({r.score for r in rows if r.doc_id in (500, 501)}) == 1
    again = quality.train(docs(spark).repartition(7), labels)
    assert all((again.weights[k] == model.weights[k]).all() for k in model.weights)


def test_no_labels(spark):
    model = quality.train(docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score_texts(docs(spark), model).collect()} == {0.5}
    assert quality.score_texts(docs(spark).limit(0), model).count() == 0
