"""Relevance, mechanism, explanation and safety notes on hand-written queries."""

from pyspark.sql import functions as F

from dietlens.operators import reasoning as R
from dietlens.operators.relevance import check_relevance, drug_vocabulary, validation_error

QUERY = "query_id LONG, drug_name STRING, food STRING, interaction_text STRING"


def test_relevance(spark):
    vocabulary = drug_vocabulary(spark.createDataFrame([("Warfarin",), ("Carbamazepine",), ("K2",), (None,)], "drug_name STRING"))
    cases = [
        ("W", "kale", "is it safe", "missing_drug_or_food"),
        ("Warfarin", " k ", "is it safe", "missing_drug_or_food"),
        (None, None, None, "missing_drug_or_food"),
        ("Warfarin", "kale", "my Laptop is slow", "irrelevant_domain"),
        ("Carbamazepine", "kale", "is it safe", "irrelevant_domain"),
        ("Warfarin", "carrot", "is it safe", "irrelevant_domain"),
        ("Aspirin", "kale", "is it safe", "unknown_drug"),
        (" WARFARIN ", "kale", "two words", "low_context"),
        ("Warfarin", "kale", None, "low_context"),
        ("k2", "kale", "three little words", "ok"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], QUERY)
    got = check_relevance(df, vocabulary).orderBy("query_id").collect()
    assert [r.relevance_reason for r in got] == [c[3] for c in cases]
    assert [r.relevant for r in got] == [c[3] in ("ok", "low_context") for c in cases]
    assert all((r.relevance_message is None) == r.relevant for r in got)
    whole = check_relevance(df, vocabulary, whole_words=True).orderBy("query_id").collect()
    assert [r.relevance_reason for r in whole][3:6] == ["irrelevant_domain", "ok", "ok"]


def test_validation(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, "d", "  "), (2, "d", "x")], "i INT, drug_name STRING, food STRING")
    got = [r.v for r in df.select("i", validation_error().alias("v")).orderBy("i").collect()]
    assert got == ["choose_drug", "enter_food", None]


NEIGHBOR = "array<struct<rank:int,drug_name:string,food:string,severity:string,interaction_text:string>>"


def test_mechanisms(spark):
    injectables = spark.createDataFrame([("heparin",)], "drug_key STRING")
    cases = [
        # drug, food, query text, neighbour text, type, key of the texts
        ("W", "rice", "plain", "plain", "other", "other"),
        ("W", "rice", "a BLEEDING risk", "x", "bleeding", "bleeding"),
        ("W", "black garlic", "x", "x", "bleeding", "bleeding"),
        ("W", "rice", "x", "CYP3A4", "cyp3a4", "cyp3a4"),
        ("W", "rice", "bleeding and grapefruit", "x", "cyp3a4", "cyp3a4"),
        ("W", "rice", "spinach grapefruit", "x", "vitamin_k", "vitamin_k"),
        ("W", "rice", "x", "absorption", "absorption", "absorption"),
        ("W", "rice", "bleeding", "bioavailability", "bleeding", "absorption"),
        ("W", "rice", "take with", "food", "absorption", "absorption"),
        ("W", "rice", "alcohol bleeding absorption", "vitamin k", "alcohol", "alcohol"),
        ("Heparin", "rice", "alcohol bleeding", "x", "bleeding", "injectable_bleeding"),
        ("Heparin", "rice", "ethanol", "absorption", "alcohol", "injectable_alcohol"),
        ("Heparin", "rice", "grapefruit", "x", "injectable_none", "injectable_none"),
        ("Heparin ", "rice", "x", "x", "other", "other"),
        ("W", None, None, None, "other", "other"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], QUERY + ", n STRING").select(
        "query_id", "drug_name", "food", "interaction_text",
        F.expr("array(named_struct('rank',1,'drug_name','d','food','f','severity','s','interaction_text',n))").cast(NEIGHBOR).alias("neighbors"),
        F.lit("severe").alias("final_severity"),
    )
    got = R.add_mechanism(df, injectables).orderBy("query_id").collect()
    assert [r.type_label for r in got] == [c[4] for c in cases]
    assert [(r.mechanism, r.risk) for r in got] == [R.MECHANISM_TEXT[c[5]] for c in cases]
    assert [r.severity_english == R.INJECTABLE_TEXT for r in got] == [c[4] == "injectable_none" for c in cases]
    assert got[0].severity_english == R.SEVERITY_TEXT["severe"]


def test_texts_by_severity(spark):
    df = spark.createDataFrame([(0, "severe"), (1, "moderate"), (2, "minor"), (3, "info"), (4, "odd")], "i INT, s STRING")
    got = [r.v for r in df.select("i", R.recommendation("s").alias("v")).orderBy("i").collect()]
    assert got == [R.RECOMMENDATION[k] for k in ("severe", "moderate", "minor", "info", "info")]


def test_examples_take_the_first_three(spark):
    rows = [(0, [(i, f"d{i}", None if i == 1 else "f", "minor", "t") for i in range(1, 6)])]
    df = spark.createDataFrame(rows, f"i INT, neighbors {NEIGHBOR}")
    [got] = df.select(R.neighbor_examples().alias("v")).collect()
    assert got.v[0] == "* [minor] d1 with  - t"
    assert len(got.v) == 3 and got.v[2].startswith("* [minor] d3 with f")


def test_safety_notes(spark):
    cases = [(" t ", "info", "high"), (" t ", "severe", "high"), ("t", "minor", "low"), ("t", "moderate", "medium")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, t STRING, s STRING, c STRING")
    got = [r.v for r in df.select("i", R.add_safety_notes("t", "s", "c").alias("v")).orderBy("i").collect()]
    assert got == [
        " t ", f"t\n\n{R.SERIOUS_NOTE}", f"t\n\n{R.UNSURE_NOTE}", f"t\n\n{R.SERIOUS_NOTE}\n{R.UNSURE_NOTE}",
    ]
