import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import ordinal
from tests.llm.helpers import empty_frame, odd_frame


def brute_features(text):
    words = (text or "").split()
    counts = {}
    for i, w in enumerate(words):
        stripped = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
        again = "yes" if i and words[i - 1] == w else "no"
        for name in (ordinal.bucket("word", stripped), ordinal.bucket("shape", ordinal.shape(w)), ordinal.bucket("repeat", again)):
            counts[name] = counts.get(name, 0) + 1
    return {k: (v / len(words)) ** 0.5 for k, v in counts.items()}


def test_features_against_brute_force(spark):
    texts = [t for _, t in odd_frame(spark)[1]]
    number, value, at = ordinal.features(pa.array(texts, pa.large_string()))
    for text, a, b in zip(texts, at, at[1:]):
        want = brute_features(text)
        assert dict(zip(number[a:b].tolist(), value[a:b].tolist())) == pytest.approx(want)
    assert ordinal.shape("WORD!!!") == "A!" and ordinal.shape("Word12,") == "Aa0," and ordinal.shape("don't") == "a'a" and ordinal.shape("a1" * 20) == "a0" * 20


def test_the_fit_is_a_minimum_of_the_cumulative_loss():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.0] + r.logistic(size=400), [-1.0, 1.5])
    number, offsets = np.tile(np.arange(3), 400), np.arange(0, 1201, 3)
    m = ordinal.Ordinal.fit(number, x.ravel(), offsets, y, steps=2000, ridge=0.0)

    def loss(w, cuts):
        below = 1 / (1 + np.exp(-(np.array([-np.inf, *cuts, np.inf])[None, :] - (x @ w)[:, None])))
        return -np.log(below[np.arange(400), y + 1] - below[np.arange(400), y]).mean()

    best = loss(m.weights[:3], m.thresholds)
    assert m.thresholds[0] < m.thresholds[1]
    assert np.allclose(m.weights[:3], [2, -1, 0], atol=0.4) and np.allclose(m.thresholds, [-1, 1.5], atol=0.4)
    for k in range(3):
        for d in (-0.05, 0.05):
            w = m.weights[:3].astype(float)
            w[k] += d
            assert loss(w, m.thresholds) > best - 1e-4
    tails = m.tails(np.array([-3.0, 0.0, 3.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails, axis=0) > 0).all()


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = ordinal.graded(labels)
    model = ordinal.train(docs, rated.where("doc_id % 4 != 0"))
    rows = ordinal.classify(docs, model).join(rated.where("doc_id % 4 = 0"), "doc_id").toPandas()
    kept = rows.groupby("grade").kept.mean()
    assert kept[2] > 0.98 and kept[1] < 0.05 and kept[0] < 0.25
    assert rows.expected_grade.between(0, 2).all() and rows.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_selection_keeps_columns_and_odd_rows(spark):
    frame, rows = odd_frame(spark)
    labels = spark.createDataFrame([(5, 1, 0), (11, 0, 0), (17, None, 1), (None, 1, 1), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    model = ordinal.train(frame, ordinal.graded(labels))
    found = ordinal.classify(frame, model)
    assert found.count() == len(rows) and found.where("tail is null or kept is null").count() == 0
    kept = ordinal.selected(frame, model)
    assert kept.columns == frame.columns and kept.count() == found.where("kept").count()
    assert {r.grade for r in ordinal.graded(labels).where("doc_id = 4").collect()} == {0}


def test_without_ratings_all_stay(spark):
    frame, rows = odd_frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ordinal.train(frame, ordinal.graded(none))
    assert ordinal.classify(frame, model).where("kept and tail = 1 and expected_grade = 2").count() == len(rows)
    assert ordinal.selected(frame, model).count() == len(rows)
    assert ordinal.classify(empty_frame(spark), model).count() == 0
