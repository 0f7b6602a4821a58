import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dietlens.operators import metrics as M
from dietlens.operators import split as P
from dietlens.operators import vote as V

NEIGHBORS = "query_id LONG, rank INT, severity STRING, similarity DOUBLE"


def test_vote(spark):
    rows = [
        (0, 1, "minor", 0.9), (0, 2, "severe", 0.5), (0, 3, "severe", 0.6),  # severe by weight
        (1, 1, "info", 0.5), (1, 2, "severe", 0.5),  # tie: the nearest wins
        (2, 1, "moderate", 0.0), (2, 2, "info", 0.0),  # all zero
    ]
    got = {r.query_id: r for r in V.neighbor_vote(spark.createDataFrame(rows, NEIGHBORS).repartition(3)).collect()}
    assert [got[i].neighbor_pred for i in range(3)] == ["severe", "info", "moderate"]
    assert got[0].neighbor_confidence == pytest.approx(0.55)
    assert got[0].neighbor_distribution == pytest.approx({"minor": 0.45, "severe": 0.55})
    assert got[1].neighbor_distribution == {"info": 0.5, "severe": 0.5}
    assert got[2].neighbor_confidence == 0 and got[2].neighbor_distribution == {"moderate": 0.0, "info": 0.0}


def test_severity_info(spark):
    votes = spark.createDataFrame(
        [(0, "severe", 0.8, {"severe": 0.8}), (1, "minor", 0.3, {"minor": 0.3})],
        "query_id LONG, neighbor_pred STRING, neighbor_confidence DOUBLE, neighbor_distribution MAP<STRING,DOUBLE>",
    )
    predictions = spark.createDataFrame(
        [(0, "severe", {"severe": 1.0}), (1, "moderate", {"moderate": 0.6})],
        "query_id LONG, classifier_pred STRING, classifier_probs MAP<STRING,DOUBLE>",
    )
    got = {r.query_id: r.severity_info for r in V.severity_info(votes, predictions).collect()}
    assert (got[0].final_severity, got[0].agreement, got[0].confidence_level) == ("severe", True, "high")
    assert (got[1].final_severity, got[1].agreement, got[1].confidence_level) == ("moderate", False, "low")


PAIRS = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "a")] + [("c", "a")] * 2


def _confusion(spark):
    df = spark.createDataFrame(PAIRS, "actual STRING, predicted STRING").withColumn("model", F.lit("m"))
    return M.confusion(df, ["model"])


def test_confusion_and_scores(spark):
    counts = _confusion(spark)
    matrix = M.confusion_matrix(counts, ["a", "b", "c"]).collect()
    assert [tuple(r) for r in matrix] == [("a", 6, 2, 0), ("b", 1, 3, 0), ("c", 2, 0, 0)]
    scores = {r.label: r for r in M.class_scores(counts, ["model"]).collect()}
    assert scores["a"].precision == pytest.approx(6 / 9) and scores["a"].recall == pytest.approx(6 / 8)
    assert (scores["c"].precision, scores["c"].recall, scores["c"].f1, scores["c"].support) == (0, 0, 0, 2)
    f1 = [2 * 6 / (9 + 8), 2 * 3 / (5 + 4), 0]
    summary = M.summary_scores(counts, ["model"]).first()
    assert summary.accuracy == pytest.approx(9 / 14) and summary.macro_f1 == pytest.approx(sum(f1) / 3)
    report = {r.label: r for r in M.classification_report(counts, ["model"]).collect()}
    assert report["accuracy"].f1 == pytest.approx(9 / 14)
    assert report["macro avg"].f1 == pytest.approx(sum(f1) / 3)
    assert report["weighted avg"].f1 == pytest.approx((f1[0] * 8 + f1[1] * 4) / 14)
    assert report["macro avg"].support == 14
    text = M.report_text(counts, M.summary_scores(counts, ["model"])).first().report
    assert text.startswith("Model: m\nAccuracy: 0.6429") and "actual c predicted a: 2" in text


def test_perfect_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "actual STRING, predicted STRING").withColumn("model", F.lit("m"))
    got = M.summary_scores(M.confusion(df, ["model"]), ["model"]).first()
    assert (got.accuracy, got.macro_f1) == (1.0, 1.0)


@pytest.mark.parametrize("rows, best", [
    ([("x", 1, 0.9, 0.5), ("y", 2, 0.1, 0.6)], "y"),
    ([("x", 1, 0.5, 0.6), ("y", 2, 0.7, 0.6)], "y"),
    ([("y", 2, 0.7, 0.6), ("x", 1, 0.7, 0.6)], "x"),
])
def test_best_model(spark, rows, best):
    df = spark.createDataFrame(rows, "model STRING, ordinal INT, accuracy DOUBLE, macro_f1 DOUBLE")
    assert M.best_model(df).first().model == best


def test_class_weights(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "i LONG, l STRING")
    assert {r.l: r.weight for r in P.class_weights(df, "l").collect()} == pytest.approx({"a": 8 / 12, "b": 8 / 4})
    weighted = P.add_class_weight(df, "l", ["i"])
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(8)


@pytest.mark.parametrize("bits", [2, 16])
def test_split_takes_the_smallest_hashes_of_each_class(spark, bits):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 7}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k LONG, l STRING")
    got = P.stratified_split(df, "l", "k", bucket_bits=bits).collect()
    members = defaultdict(list)
    for k, label in rows:
        members[label].append((int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:8], 16), k))
    wanted = {k for m in members.values() for _, k in sorted(m)[:int(0.2 * len(m) + 0.5)]}
    assert {r.k for r in got if r.is_test} == wanted
    assert len(got) == 2000 and Counter(r.l for r in got) == Counter(label for _, label in rows)


def test_tiny_classes(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "k LONG, l STRING")
    assert not any(r.is_test for r in P.stratified_split(df, "l", "k").collect())
    with pytest.raises(ValueError):
        P.check_splittable(df, "l")
