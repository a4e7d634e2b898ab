import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.llm import ordinal_classifier as oc
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def test_features_are_a_set_of_each_text():
    texts = pa.array(["Aa bb aa", "", "bb, AA!", None, "aa " * 50])
    found, places = oc.features(texts, 20)
    each = [set(found[a:b].tolist()) for a, b in zip(places, places[1:], strict=False)]
    assert all(len(s) == b - a for s, a, b in zip(each, places, places[1:], strict=False))
    single, ends = oc.features(texts.slice(2, 1), 20)
    assert set(single[: ends[1]].tolist()) == each[2]
    assert len(each[0] & each[2]) >= 6 and each[1] == each[3]


def test_slope_of_the_likelihood():
    """Thresholds stay in order, and a feature of high grades raises the score."""
    random = np.random.default_rng(1)
    grades = random.integers(0, 3, 3000)
    rows = [np.unique(np.concatenate([[g + 10] if random.random() < 0.9 else [], random.integers(100, 400, 6)])).astype(np.int32) for g in grades]
    places = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = oc.fit(grades, np.concatenate(rows), places, 2, 10)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[10] < model.weights[11] < model.weights[12]
    assert (model.weights[100:400] == 0).mean() > 0.95
    tails = model.tails(np.array([-3.0, 0.0, 3.0]))
    assert (np.diff(tails, axis=0) > 0).all() and (tails[:, 0] > tails[:, 1]).all()


def test_odd_documents(spark):
    docs = edges.frame(spark)
    rated = spark.createDataFrame([(6, 2), (7, 0), (7, 1), (None, 2), (8, None), (999, 1)], "doc_id long, grade int")
    model = oc.train(docs, rated, bits=12)
    scored = oc.score_documents(docs, model, bits=12)
    assert edges.same([r.doc_id for r in scored.collect()], [i for i, *_ in edges.EDGES])
    assert scored.where("top_probability between 0 and 1 and expected_grade between 0 and 2").count() == docs.count()
    untrained = oc.train(docs, rated.limit(0), bits=12)
    assert oc.score_documents(docs, untrained, bits=12).where("top_probability > 0.5").count() == 0
    assert oc.score_documents(docs.limit(0), model, bits=12).count() == 0


def test_slopes_are_those_of_the_likelihood():
    random = np.random.default_rng(2)
    score, bounds, grades = random.normal(size=50), np.array([-0.7, 0.4, 1.1]), random.integers(0, 4, 50)

    def logs(score, bounds):
        edges_ = np.concatenate([[-np.inf], bounds, [np.inf]])
        tail = [1 / (1 + np.exp(-(score - edges_[grades + k]))) for k in (0, 1)]
        return np.log(tail[0] - tail[1])

    by_score, by_bound = oc.likelihood_steps(score, bounds, grades)
    assert np.allclose(by_score, (logs(score + 1e-6, bounds) - logs(score - 1e-6, bounds)) / 2e-6, atol=1e-5)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert np.allclose(by_bound[:, k], (logs(score, bounds + step) - logs(score, bounds - step)) / 2e-6, atol=1e-5)


def test_without_informative_features_the_shares_decide():
    for grades, kept in (([0] * 16 + [2] * 4, False), ([0] * 4 + [1] * 2 + [2] * 14, True)):
        grades = np.array(grades)
        found, places = np.arange(len(grades), dtype=np.int32), np.arange(len(grades) + 1)
        model = oc.fit(grades, found, places, 2, 10)
        chance = model.tails(np.zeros(1))[0, -1]
        assert (chance > 0.5) == kept and abs(chance - (grades == 2).mean()) < 0.05


def test_texts_that_share_an_id_are_learned_once(spark):
    docs = edges.frame(spark, [(1, f"text {i % 7}", "en", "s") for i in range(200)] + [(2, "other", "en", "s")])
    rated = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 2)], "doc_id long, grade int")
    model = oc.train(docs, rated, bits=12)
    assert np.allclose(model.tails(np.zeros(1))[0], [(2 + 1) / (3 + 1.5), (2 + 0.5) / (3 + 1.5)])


@pytest.mark.parametrize("scale,good,poor", [("0.01", 0.95, 0.3), ("0.1", 0.97, 0.1)])
def test_held_out_accuracy(spark, bundled, scale, good, poor):
    """Each fifth of the labels is judged by a model of the others (at the larger scale one fifth only)."""
    folder = f"/root/testdata/sf{scale}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("grade", oc.grade(F.col("quality"), F.col("toxic")))
    judged = []
    for fold in range(5 if scale == "0.01" else 1):
        held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == fold
        model = oc.train(docs, labels.where(~held).select("doc_id", "grade"))
        scored = oc.score_documents(docs, model).join(labels.where(held), "doc_id")
        judged += scored.select("grade", "expected_grade", (F.col("top_probability") > 0.5).alias("selected")).collect()
    share, mean = ([np.mean([r[c] for r in judged if r.grade == g]) for g in range(3)] for c in ("selected", "expected_grade"))
    assert share[2] > good and share[0] < poor and share[1] < 0.6
    assert mean[0] < mean[1] < mean[2]


def test_query(spark, bundled):
    result = QUERIES["op3_quality_classifier"](spark, bundled)
    assert result.count() == spark.read.parquet(f"{bundled}/documents.parquet").count()
