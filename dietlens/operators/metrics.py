"""Classifier quality from a table of (actual, predicted) labels.

Everything is derived from the confusion counts, so the predictions are aggregated once, with
partial sums before the shuffle; what follows works on classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, by: list[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(by, actual, predicted, n): counts of the label pairs that occur."""
    return predictions.groupBy(
        *by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, labels: list | None = None) -> DataFrame:
    """One row per actual label, one column per predicted label, 0 where no pair occurs.

    Without `labels` the columns are the predicted labels that occur. A predicted label outside of them is an error.
    """
    if labels is not None:
        known = F.col("predicted").isin(list(labels))
        other = counts.filter(~F.coalesce(known, F.lit(False))).select("predicted").first()
        if other is not None:
            raise ValueError(f"predicted label {other.predicted!r} is not among the labels")
    wide = counts.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
    return wide.na.fill(0).orderBy("actual")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_scores(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support) per label met on either side; 0 where undefined."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")),
    )).alias("s")).select(*by, "s.*")
    totals = sides.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said")
    )
    return totals.select(
        *by, "label",
        _ratio(F.col("tp"), F.col("said")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def summary_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, accuracy, macro_f1)."""
    accuracy = counts.groupBy(*by).agg(
        (F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    macro = class_scores(counts, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    return accuracy.join(macro, list(by))


def classification_report(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per-label scores plus the rows `accuracy`, `macro avg` and `weighted avg`."""
    scores = class_scores(counts, by).withColumn("label", F.col("label").cast("string"))
    names = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")
    macro = scores.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names], support)
    weighted = scores.groupBy(*by).agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], support
    )
    # Recall weighted by support is the accuracy.
    accuracy = weighted.select(*by, *[F.col("recall").alias(c) for c in names], "support")
    report = scores
    for label, rows in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        report = report.unionByName(rows.withColumn("label", F.lit(label)))
    return report


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest macro-F1, then accuracy, then the first listed.

    `metrics` has (model, ordinal, accuracy, macro_f1).
    """
    order = F.struct("macro_f1", "accuracy", -F.col("ordinal"))
    return metrics.agg(
        F.max_by("model", order).alias("model"),
        F.max_by("macro_f1", order).alias("macro_f1"),
        F.max_by("accuracy", order).alias("accuracy"),
    ).filter(F.col("model").isNotNull())


def model_summary(counts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(model, accuracy, macro_f1, best, actual, predicted, n): scores, confusion counts and the chosen model."""
    best = best_model(metrics).select(F.col("model").alias("_best"))
    scores = metrics.select("model", "accuracy", "macro_f1").join(best, F.col("model") == F.col("_best"), "left")
    scores = scores.select("model", "accuracy", "macro_f1", F.col("_best").isNotNull().alias("best"))
    return scores.join(counts, "model").select("model", "accuracy", "macro_f1", "best", "actual", "predicted", "n")


def report_text(counts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(model, report): the text of one report per model. Its length grows with the classes only."""
    def line(*parts) -> Column:
        return F.format_string(*parts)

    report = classification_report(counts, ["model"]).select(
        "model", F.lit(1).alias("part"), F.col("label").alias("name"),
        line("%-14s %9.4f %9.4f %9.4f %9d", "label", "precision", "recall", "f1", "support").alias("line"),
    )
    pairs = counts.select(
        "model", F.lit(2).alias("part"), F.format_string("%s|%s", F.col("actual").cast("string"), F.col("predicted").cast("string")).alias("name"),
        line("actual %s predicted %s: %d", F.col("actual").cast("string"), F.col("predicted").cast("string"), "n").alias("line"),
    )
    head = metrics.select(
        "model", F.lit(0).alias("part"), F.lit("").alias("name"),
        line("Model: %s\nAccuracy: %.4f\nMacro F1: %.4f", "model", "accuracy", "macro_f1").alias("line"),
    )
    lines = head.unionByName(report).unionByName(pairs)
    ordered = F.array_sort(F.collect_list(F.struct("part", "name", "line")))
    return lines.groupBy("model").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report")
    )
