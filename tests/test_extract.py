import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from dietlens.functions.text import extract_terms, lexicon_hits, normalize_text
from dietlens.operators import extract as X
from dietlens.sources.records import lexicon_terms, load_lexicon, split_lines


def test_terms_by_join_equal_terms_by_pattern(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = ["the", "of the", "aile", "et", "mente.", "is it", "the, of", "und", "nicht die", "être"]
    lexicon = spark.createDataFrame([(t,) for t in terms], "term STRING")
    joined = {tuple(r) for r in X.match_terms_by_join(documents, "doc_id", "text", lexicon).collect()}
    direct = {
        tuple(r) for r in documents.select(
            "doc_id", F.explode(lexicon_hits(normalize_text("text"), terms)).alias("term")
        ).collect()
    }
    assert joined == direct and len(joined) > 100


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(st.lists(st.text(alphabet="ab é.-_ 1", max_size=14), min_size=40, max_size=80))
def test_terms_by_join_against_python(spark, texts):
    terms = ["a", "ab", "a b", "é", "a-b", "b.", "1", ". a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i LONG, x STRING")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term STRING")
    got = {tuple(r) for r in X.match_terms_by_join(df, "i", "x", lexicon).collect()}
    wanted = set()
    for i, text in enumerate(texts):
        norm = re.sub(r"\s+", " ", text.lower()).strip()
        wanted |= {(i, t) for t in terms if re.search(r"\b" + re.escape(t) + r"\b", norm)}
    assert got == wanted
    hits = df.select("i", F.explode(lexicon_hits(normalize_text("x"), terms)).alias("t")).collect()
    assert {tuple(r) for r in hits} == wanted


def test_lexicon_file_to_terms_and_table_form(spark, tmp_path):
    path = tmp_path / "extra.txt"
    path.write_text("Figs\nDate palm\n")
    lexicon = load_lexicon(spark, str(path))
    df = spark.createDataFrame(
        [(0, "figs, tea and a date palm such as Medjool or figs"), (1, "nothing"), (2, None)], "k LONG, t STRING"
    )
    small = df.withColumn("food_entities", extract_terms("t", lexicon_terms(lexicon)))
    wanted = [["date palm", "figs", "medjool", "tea"], []]
    assert [r.food_entities for r in small.orderBy("k").collect()][:2] == wanted
    large = X.extract_with_lexicon_table(df, "k", "t", lexicon)
    assert [r.food_entities for r in large.orderBy("k").collect()][:2] == wanted
    given = X.extract_with_answers(large, "t", ["k"], ["k"]).orderBy("k").collect()
    assert given[0].food_entities_str == "date palm; figs; medjool; tea"
    with pytest.raises(ValueError):
        lexicon_terms(lexicon, 10)


def test_flatten(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"]), (1, []), (2, None)], "i INT, foods ARRAY<STRING>")
    got = sorted((r.i, r.food or "") for r in X.flatten_terms(df, "foods").collect())
    assert got == [(0, "a"), (0, "a"), (0, "b"), (1, ""), (2, "")]


def _labels(spark, answers, budget=None):
    texts = ["fatal", "x0", "x1", "monitor", "x2", "x3", "x4"]
    df = spark.createDataFrame(list(enumerate(texts)), "k LONG, t STRING").repartition(3)
    table = spark.createDataFrame(answers, "k LONG, raw_response STRING, status STRING")
    rows = X.label_with_answers(df, "t", ["k"], ["k"], table, budget=budget).orderBy("k").collect()
    return [r.severity for r in rows]


def test_labels_use_answers_within_the_budget(spark):
    answers = [(k, "Severe", "ok") for k in (1, 2, 4, 5, 6)]
    assert _labels(spark, answers, 3) == ["severe", "severe", "severe", "moderate", "severe", "info", "info"]
    assert _labels(spark, answers, 0) == ["severe", "info", "info", "moderate", "info", "info", "info"]


def test_a_failed_answer_does_not_stop_the_others(spark):
    answers = [(1, "minor", "ok"), (2, None, "quota"), (4, "severe", "ok"), (5, "severe", "ok"), (6, "severe", "error")]
    assert _labels(spark, answers) == ["severe", "minor", "info", "moderate", "severe", "severe", "info"]


def test_a_missing_answer_is_info(spark):
    answers = [(2, "minor", "ok"), (4, "severe", "ok")]
    assert _labels(spark, answers) == ["severe", "info", "minor", "moderate", "severe", "info", "info"]


def test_every_answer_is_used_once(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("nothing known").alias("t"))
    answers = df.select("k", F.lit("severe").alias("raw_response"), F.lit("ok").alias("status"))
    twice = answers.unionByName(answers.withColumn("raw_response", F.lit("the same, severe")))
    got = X.label_with_answers(df, "t", ["k"], ["k"], twice)
    assert got.count() == 100 and got.filter("severity = 'severe'").count() == 100


def test_labels_without_answers(spark):
    df = spark.createDataFrame([(0, "x"), (1, "nausea")], "k LONG, t STRING")
    rows = X.label_with_answers(df, "t", ["k"], ["k"]).orderBy("k").collect()
    assert [(r.rule_label, r.severity) for r in rows] == [("unknown", "info"), ("minor", "minor")]


def test_extraction_with_answers(spark):
    rows = [
        (0, "avoid grapefruit"), (1, "take with food"), (2, "nothing"), (3, "nothing"), (4, "meals and food"),
    ]
    df = spark.createDataFrame(rows, "k LONG, t STRING").repartition(3)
    answers = spark.createDataFrame(
        [(0, '["never asked"]', "ok"), (1, 'Sure: ["zinc", "food", "Apple"]', "ok"), (2, "none", "ok"),
         (3, None, "quota"), (4, '["late"]', "ok")],
        "k LONG, raw_response STRING, status STRING",
    )
    got = X.extract_with_answers(df, "t", ["k"], ["k"], answers).orderBy("k").collect()
    assert [r.food_entities for r in got] == [["grapefruit"], ["Apple", "food", "zinc"], [], [], ["food", "late", "meals"]]
    assert got[1].food_entities_str == "Apple; food; zinc"
    capped = X.extract_with_answers(df, "t", ["k"], ["k"], answers, budget=1).orderBy("k").collect()
    assert [r.food_entities for r in capped][:3] == [["grapefruit"], ["Apple", "food", "zinc"], []]


def test_flatten_row_count(spark, sf_dir):
    lines = split_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    found = lines.withColumn("foods", F.filter(F.split("interaction_text", " "), lambda w: w.rlike("^th")))
    expected = found.agg(F.sum(F.greatest(F.lit(1), F.size("foods")))).first()[0]
    assert X.flatten_terms(found, "foods").count() == expected
