"""Severity from neighbours, and its combination with a classifier's answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dietlens.constants import HIGH_CONFIDENCE, MEDIUM_CONFIDENCE, SEVERITY_ORDER
from dietlens.functions.severity import combine_labels, confidence_level


def label_weights(neighbors: DataFrame, query_id: str = "query_id", label: str = "severity") -> DataFrame:
    """(query, label, weight, first_rank): similarity summed per label."""
    return neighbors.groupBy(query_id, label).agg(
        F.sum("similarity").alias("weight"), F.min("rank").alias("first_rank")
    )


def neighbor_vote(neighbors: DataFrame, query_id: str = "query_id", label: str = "severity") -> DataFrame:
    """(query, neighbor_pred, neighbor_confidence, neighbor_distribution).

    Weights are divided by their total, or by 1 if that is 0. The heaviest label wins, and among
    equals the one met at the smallest rank.
    """
    weights = label_weights(neighbors, query_id, label)
    total = F.sum("weight")
    share = F.col("weight") / F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(1.0))
    votes = weights.groupBy(query_id).agg(
        F.max_by(label, F.struct("weight", -F.col("first_rank"))).alias("neighbor_pred"),
        F.max("weight").alias("weight"),
        total.alias("total"),
        # At most k labels per query.
        F.array_sort(F.collect_list(F.struct("first_rank", F.col(label).alias("label"), "weight"))).alias("labels"),
    )
    divisor = F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(1.0))
    return votes.select(
        query_id,
        "neighbor_pred",
        share.alias("neighbor_confidence"),
        F.map_from_entries(
            F.transform("labels", lambda x: F.struct(x["label"], (x["weight"] / divisor).alias("value")))
        ).alias("neighbor_distribution"),
    )


def severity_info(
    votes: DataFrame,
    predictions: DataFrame,
    query_id: str = "query_id",
    order: Sequence[str] = SEVERITY_ORDER,
    high: float = HIGH_CONFIDENCE,
    medium: float = MEDIUM_CONFIDENCE,
) -> DataFrame:
    """(query, severity_info): the neighbours' vote and the classifier's prediction in one struct.

    A query without neighbours keeps its prediction; its final severity is null and its confidence low.
    """
    both = (
        predictions.select(query_id, "classifier_pred", "classifier_probs").join(votes, query_id, "left")
        .withColumn("agreement", F.col("neighbor_pred") == F.col("classifier_pred"))
        .withColumn("final_severity", F.when(F.col("neighbor_pred").isNotNull(), combine_labels("neighbor_pred", "classifier_pred", order)))
        .withColumn("confidence_level", confidence_level("agreement", "neighbor_confidence", high, medium))
    )
    info = F.struct(
        "final_severity", "agreement", "neighbor_pred", "neighbor_confidence", "neighbor_distribution",
        "classifier_pred", "classifier_probs", "confidence_level",
    )
    return both.select(query_id, info.alias("severity_info"))
