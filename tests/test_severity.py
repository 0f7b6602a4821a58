from pyspark.sql import functions as F

from dietlens.functions import severity as S


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, x STRING")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_rules_in_order(spark):
    cases = {
        "LIFE THREATENING reaction": "severe",
        "life-threatening": "severe",
        "Avoid grapefruit; may increase": "severe",
        "may increase levels, take with food": "moderate",
        "increased the levels": "moderate",
        "praised by many": "moderate",
        "Take with food": "minor",
        "nausea": "minor",
        "No significant effect": "info",
        "plain water": "unknown",
        "": "unknown",
    }
    assert values(spark, list(cases), S.classify_severity) == list(cases.values())


def test_answer_labels(spark):
    cases = {" Severe.": "severe", "not moderate but minor": "moderate", "MINOR": "minor", "info": "info", "?": "info"}
    assert values(spark, list(cases), S.label_from_answer) == list(cases.values())
    assert values(spark, [None], S.label_from_answer) == ["info"]


def test_final_label(spark):
    df = spark.createDataFrame(
        [(0, "severe", "minor"), (1, "unknown", "minor"), (2, "unknown", None)], "i INT, r STRING, a STRING"
    )
    got = [r.v for r in df.select("i", S.final_label("r", "a").alias("v")).orderBy("i").collect()]
    assert got == ["severe", "minor", "info"]


def test_rank(spark):
    assert values(spark, ["info", "minor", "moderate", "severe", "odd", None], S.severity_rank) == [0, 1, 2, 3, 0, 0]


def test_markers(spark):
    got = values(spark, ["Severe", "info", "odd", None], S.severity_marker)
    assert got == ["🔴 شديدة", "🔵 معلوماتية فقط", "⚪ غير معروفة", "⚪ غير معروفة"]
    assert values(spark, ["minor", "Severe"], S.severity_arabic) == ["بسيطة", "غير معروفة"]


def test_combination_and_confidence(spark):
    rows = [
        (0, "severe", "severe", 0.70), (1, "severe", "severe", 0.69), (2, "minor", "minor", 0.39),
        (3, "severe", "minor", 0.40), (4, "minor", "severe", 0.39), (5, "odd", "info", 0.5), (6, "info", "odd", 0.1),
    ]
    df = spark.createDataFrame(rows, "i INT, n STRING, c STRING, p DOUBLE")
    got = df.select(
        "i", S.combine_labels("n", "c").alias("f"), S.confidence_level(F.col("n") == F.col("c"), "p").alias("l")
    ).orderBy("i").collect()
    assert [(r.f, r.l) for r in got] == [
        ("severe", "high"), ("severe", "medium"), ("minor", "medium"),
        ("severe", "medium"), ("severe", "low"), ("info", "medium"), ("odd", "low"),
    ]
