import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import toxicity
from plumbline.llm.common import table
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Some toxic labels of these small tables are on texts without any hostile word."""
    labels = table(spark, SF, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = LLM_QUERIES["op2_toxicity"](spark, SF).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = sum(r.toxic and r.label for r in rows)
    assert hit >= 0.8 * sum(r.label for r in rows) and hit >= 0.95 * sum(r.toxic for r in rows)
    severity = {g: np.mean([r.severity for r in rows if r.grade == g]) for g in {r.grade for r in rows}}
    assert sorted(severity.values()) == [severity[g] for g in sorted(severity)]


def test_thresholds_order_grades():
    draw = np.random.default_rng(1)
    documents, toxic = [], []
    for i in range(600):
        bad = i % 3 == 0
        noise = draw.integers(100, 400, 20)
        documents.append(np.concatenate((noise, draw.choice(12, draw.integers(1, 8), replace=False))) if bad else noise)
        toxic.append(bad)
    model = toxicity.fit(documents, np.array(toxic))
    assert (np.diff(model.thresholds) > 0).all()
    few, many = (model.above(np.array([model.weights[:n].sum()])).sum() for n in (1, 10))
    assert model.above(np.zeros(1))[0, 0] < 0.5 < few < many


def docs(spark):
    rows = [(i, "you awful vermin " + "w%d " % i * (i % 5)) for i in range(40)] + [(100 + i, "fine day w%d" % i) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "vermin " * 50_000), (None, "fine"), (502, "vermin " * 50_000)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, toxic string, label int").repartition(3)


def test_edge_texts(spark):
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 180), 9999]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark), labels)
    rows = toxicity.score_texts(docs(spark), model).collect()
    assert len(rows) == 125 and {r.toxic for r in rows if r.doc_id in (500, 501, None)} == {False}
    assert [r.toxic for r in rows if r.doc_id == 502] == [True, True] and all(0 <= r.severity <= 3 for r in rows)
    kept = toxicity.drop_toxic(docs(spark), model)
    assert kept.schema == docs(spark).schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.toxic)
    again = toxicity.train(docs(spark).repartition(7), labels)
    assert (again.weights == model.weights).all() and (again.thresholds == model.thresholds).all()


def test_no_labels(spark):
    model = toxicity.train(docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.toxic for r in toxicity.score_texts(docs(spark), model).collect())
    assert toxicity.score_texts(docs(spark).limit(0), model).count() == 0
