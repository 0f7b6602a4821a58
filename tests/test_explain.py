"""The whole job on a small corpus: prepare, encode, train, answer."""

import dataclasses
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dietlens.constants import CURATED_INJECTABLES, MECHANISM_WORDS, UNKNOWN_ARABIC
from dietlens.operators import encode as E
from dietlens.operators import models as ML
from dietlens.operators import reasoning as R
from dietlens.operators.cluster import add_kmeans, fit_kmeans
from dietlens.operators.extract import sorted_vocabulary
from dietlens.operators.keys import check_alignment
from dietlens.plans import answer as A
from dietlens.plans import catalogue as C
from dietlens.plans import prepare as P
from dietlens.session import materialize
from dietlens.sources.records import flatten_records, write_csv_records
from dietlens.streaming.rows import label_stream

RECORDS = [
    ("Atorvastatin", ["Avoid grapefruit juice. Grapefruit may increase the level of atorvastatin.",
                      "Dangerous with pomelo: muscle damage reported."]),
    ("Warfarin", ["Vitamin K rich foods such as spinach, kale and broccoli may decrease the effect of warfarin.",
                  "Garlic and ginger raise the risk of bleeding; monitor closely."]),
    ("Metformin", ["Take with food to reduce nausea.", "Alcohol may increase the risk of lactic acidosis."]),
    ("Fluoxetine", ["Take without regard to meals.", "No significant effect of dairy products."]),
    ("Heparin", ["Given by subcutaneous injection.", "No significant effect of food."]),
    ("Digoxin", ["Fiber and high-fat meal reduce absorption.", "Licorice is dangerous: potassium loss."]),
    ("Doxycycline", ["Milk, calcium and iron reduce absorption.", "Drink plenty of fluids."]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    raw = spark.createDataFrame(
        [(i, n, "ref", t) for i, (n, t) in enumerate(RECORDS)],
        "entry_id LONG, name STRING, reference STRING, food_interactions ARRAY<STRING>",
    )
    key = ["entry_id", "text_pos"]
    extracted = P.extracted_rows(flatten_records(raw), key)
    rows = materialize(P.labelled_triples(extracted, key), "rows")
    texts = rows.select(F.concat_ws(" ", "drug_name", "food", "interaction_text").alias("document"))
    encoder = E.tfidf_encoder(E.fit_tfidf(texts, "document", 512))
    vectors = materialize(P.vectors_of(rows, encoder), "vectors")
    check_alignment(rows, vectors, "row_id")
    joined = rows.join(vectors, "row_id")
    rows = rows.join(add_kmeans(joined, fit_kmeans(joined, 3)).select("row_id", "cluster_kmeans"), "row_id")
    classifier = ML.fit(joined.withColumn("weight", F.lit(1.0)).withColumn("features", E.features()), ML.logistic(50))
    return A.build_corpus(materialize(rows, "rows"), vectors, encoder, classifier)


def test_prepared_rows(corpus):
    rows = {(r.drug_name, r.food): r for r in corpus.rows.collect()}
    assert rows["Atorvastatin", "pomelo"].severity == "severe"
    assert rows["Warfarin", "garlic"].severity == "moderate"
    assert rows["Warfarin", "kale"].severity == "moderate"
    assert rows["Metformin", "food"].severity == "minor"
    assert rows["Fluoxetine", "dairy"].severity == "info"
    assert rows["Heparin", None].severity == "info"  # no rule, no answer
    ids = sorted(r.row_id for r in corpus.rows.collect())
    assert ids == list(range(len(ids)))
    assert {r.drug_key for r in corpus.injectables.collect()} == set(CURATED_INJECTABLES)
    assert [r.value for r in sorted_vocabulary(corpus.rows, "drug_name").collect()] == sorted(n for n, _ in RECORDS)


def test_encoder_gives_unit_vectors_of_hand_made_tfidf(spark):
    df = spark.createDataFrame([(0, "Tea tea milk"), (1, "tea"), (2, "...")], "i LONG, t STRING")
    encoder = E.tfidf_encoder(E.fit_tfidf(df, "t", 64))
    got = {r.i: np.array(r.v) for r in encoder(df, "t", "v").collect()}
    tea, milk = 2 * math.log(4 / 3), math.log(4 / 2)
    wanted = sorted([tea / math.hypot(tea, milk), milk / math.hypot(tea, milk)])
    assert sorted(got[0][got[0] > 0].tolist()) == pytest.approx(wanted, abs=1e-6)
    assert got[1].max() == pytest.approx(1) and (got[1] > 0).sum() == 1
    assert not got[2].any() and len(got[2]) == 64
    # Other tables and column names encode alike, and keep their columns.
    other = encoder(df.select(F.col("t").alias("x"), F.lit(5).alias("t")), "x", "v").collect()
    assert {r.t for r in other} == {5} and sorted(map(str, (r.v for r in other))) == sorted(str(v.tolist()) for v in [r.v and np.array(r.v) for r in other])


def test_batch_encoder(spark):
    def load():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    df = spark.createDataFrame([("a",), ("abc",)], "t STRING")
    got = sorted(tuple(r.v) for r in E.batch_encoder(load)(df, "t", "v").collect())
    assert got == [(1.0, 1.0), (3.0, 1.0)]


def test_resolve_foods(spark, corpus):
    foods = [(0, "Kale"), (1, None), (2, "  "), (3, " unheard stuff "), (4, "garlic "), (5, "Kale")]
    got = A.resolve_foods(spark.createDataFrame(foods, "query_id LONG, food STRING"), corpus.foods, corpus.encoder)
    got = {r.query_id: (r.resolved_food, round(r.food_similarity_score, 6)) for r in got.collect()}
    assert got == {0: ("kale", 1.0), 1: (None, 0.0), 2: ("", 0.0), 3: (" unheard stuff ", 0.0), 4: ("garlic", 1.0), 5: ("kale", 1.0)}


DEMO = [
    (0, "Atorvastatin", "grapefruit juice", "My pills are atorvastatin, may grapefruit juice go with them?"),
    (1, "Fluoxetine", "aged cheese", "Does fluoxetine go well with an old cheddar?"),
    (2, "Warfarin", "leafy green vegetables", "Warfarin user here, salad and spinach nearly every day."),
    (3, "Metformin", "food", "Why does the label say metformin belongs to a meal?"),
    (4, "Windows 10", "banana", "Will a banana run on Windows 10?"),
    (5, "Nosuchdrug", "banana", "Is it safe to eat?"),
    (6, "Heparin", "rice", "ok?"),
]


@pytest.fixture(scope="module")
def results(spark, corpus):
    queries = spark.createDataFrame(DEMO, "query_id LONG, drug_name STRING, food STRING, interaction_text STRING")
    return materialize(A.explain(queries, corpus, k=2), "results")


def _mechanism(result):
    """Which rule decides the texts of an oral drug, read off the result's own texts."""
    context = " ".join([result.interaction_text, *(n.interaction_text for n in result.neighbors)]).lower()
    for name in ("alcohol", "absorption", "vitamin_k", "cyp3a4", "bleeding"):
        if any(w in context for w in MECHANISM_WORDS[name]):
            return name
    return "other"


def test_explain(results):
    got = {r.query_id: r for r in results.collect()}
    assert len(got) == len(DEMO)
    assert [got[i].relevance_reason for i in range(7)] == ["ok"] * 4 + ["irrelevant_domain", "unknown_drug", "ok"]
    for i in (4, 5):
        r = got[i]
        assert not r.relevant and r.neighbors == [] and r.severity_info is None and r.reasoning_bundle is None
        assert r.resolved_food is None and r.explanation
    for i in (0, 1, 2, 3, 6):
        r = got[i]
        assert r.relevant and [n["rank"] for n in r.neighbors] == [1, 2]
        assert sorted(n.distance for n in r.neighbors) == [n.distance for n in r.neighbors]
        assert all(n.cluster_kmeans in (0, 1, 2) for n in r.neighbors)
        info = r.severity_info
        assert sum(info.neighbor_distribution.values()) == pytest.approx(1)
        assert set(info.classifier_probs) == {"info", "minor", "moderate", "severe"}
        assert r.reasoning_bundle.final_severity == info.final_severity
        assert r.reasoning_bundle.user_entered_food == DEMO[i][2]
        assert r.drug_name in r.explanation and UNKNOWN_ARABIC not in r.explanation
    assert got[0].resolved_food == "grapefruit juice" and got[0].food_similarity_score == pytest.approx(1)
    for i in (0, 1, 2, 3):
        assert got[i].reasoning_bundle.mechanism == R.MECHANISM_TEXT[_mechanism(got[i])][0]
    assert got[6].reasoning_bundle.mechanism == R.MECHANISM_TEXT["injectable_none"][0]
    assert got[0].neighbors[0].drug_name == "Atorvastatin"


def test_an_empty_index_answers_every_query(spark, corpus):
    queries = spark.createDataFrame(DEMO, "query_id LONG, drug_name STRING, food STRING, interaction_text STRING")
    empty = dataclasses.replace(corpus, vectors=corpus.vectors.filter("false"))
    got = {r.query_id: r for r in A.explain(queries, empty).collect()}
    assert len(got) == len(DEMO) and all(r.neighbors == [] and r.explanation for r in got.values())
    assert got[0].severity_info.final_severity is None and got[0].severity_info.classifier_pred and got[0].severity_info.confidence_level == "low"
    assert A.zero_shot_severity(queries, empty).filter("neighbor_pred IS NULL AND size(neighbors) = 0").count() == len(DEMO)
    assert A.compare_predictions(queries, empty).filter("neighbor_pred IS NULL AND classifier_pred IS NOT NULL").count() == len(DEMO)


def test_generated_texts_come_first(spark, corpus):
    queries = spark.createDataFrame(DEMO[:3], "query_id LONG, drug_name STRING, food STRING, interaction_text STRING")
    generated = spark.createDataFrame([(0, " one ", "two"), (1, "  ", "second")], "query_id LONG, first_text STRING, second_text STRING")
    got = {r.query_id: r.explanation for r in A.explain(queries, corpus, 4, generated=generated).collect()}
    assert got[0].startswith(f"one\n\n{R.WARNING}") and got[1].startswith(f"second\n\n{R.WARNING}")
    assert got[2].startswith("الدواء: Warfarin")


def test_prompt_names_both_foods_where_they_differ(results):
    accepted = results.filter("relevant").select("query_id", R.explanation_prompt().alias("p"), "resolved_food", "food")
    for r in accepted.collect():
        assert ("closest known food" in r.p) == (r.resolved_food != r.food)


def test_views(spark, results, tmp_path):
    view = {r.query_id: r for r in R.result_view(results.filter("relevant")).collect()}
    assert set(view[0].neighbors[0].asDict()) == {"drug_name", "food", "severity", "interaction_text", "distance", "similarity"}
    path = str(tmp_path / "explanations")
    write_csv_records(A.explanation_records(results), path)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count() == len(DEMO)


def test_the_view_shows_the_whole_answer(results):
    accepted = results.filter("relevant")
    want = {r.query_id: r for r in accepted.collect()}
    view = {r.query_id: r for r in R.result_view(accepted).collect()}
    rows = {r.query_id: r for r in C._view_row(R.result_view(accepted)).collect()}
    assert set(view) == set(rows) == set(want) == {0, 1, 2, 3, 6}
    for i, r in want.items():
        info = r.severity_info
        for c in ("final_severity", "confidence_level", "neighbor_pred", "classifier_pred"):
            assert view[i][c] == rows[i][c] == info[c]
        assert view[i].explanation == rows[i].explanation == r.explanation
        assert (R.UNSURE_NOTE in rows[i].explanation) == (info.confidence_level in ("low", "medium"))
        assert view[i].neighbor_confidence == info.neighbor_confidence and view[i].classifier_probs == info.classifier_probs
        assert rows[i].classifier_probs == "|".join(f"{k}:{v:.4f}" for k, v in sorted(info.classifier_probs.items()))
        assert [x.split(":")[0] for x in rows[i].neighbor_distribution.split("|")] == sorted(info.neighbor_distribution)
        assert rows[i].n_neighbors == 2
        texts = [hashlib.md5(n.interaction_text.encode()).hexdigest() for n in r.neighbors]
        assert [x.split(":")[:4] for x in rows[i].neighbors.split("|")] == [[n.drug_name, n.food or "", n.severity, t] for n, t in zip(r.neighbors, texts, strict=True)]


def test_zero_shot_and_comparison(spark, corpus):
    queries = spark.createDataFrame(DEMO[:4], "query_id LONG, drug_name STRING, food STRING, interaction_text STRING")
    zero = {r.query_id: r for r in A.zero_shot_severity(queries, corpus, 4).collect()}
    both = {r.query_id: r for r in A.compare_predictions(queries, corpus, 4).collect()}
    alone = {r.query_id: r for r in A.classifier_severity(queries, corpus).collect()}
    for i in range(4):
        assert zero[i].neighbor_pred == both[i].neighbor_pred
        assert both[i].classifier_pred == alone[i].classifier_pred
        assert zero[i].query_text.startswith("Drug: ") and len(zero[i].neighbors) == 4


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("fatal with grapefruit",), ("nothing",)], "interaction_text STRING").write.json(source)
    stream = label_stream(spark.readStream.schema("interaction_text STRING").json(source))
    query = stream.writeStream.format("memory").queryName("labels").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(tuple(r.food_entities), r.rule_label) for r in spark.table("labels").collect()}
    assert got == {(("grapefruit",), "severe"), ((), "unknown")}
