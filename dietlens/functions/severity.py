"""Severity functions: rules, answers, ranks and the words shown for a label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dietlens.constants import (
    HIGH_CONFIDENCE, MEDIUM_CONFIDENCE, SEVERITY_ARABIC, SEVERITY_MARKERS, SEVERITY_ORDER,
    SEVERITY_PATTERNS, UNKNOWN_ARABIC, UNKNOWN_MARKER,
)
from dietlens.functions.text import any_match, as_column, strip_or_empty


def classify_severity(text: Column | str, patterns: Mapping[str, Sequence[str]] = SEVERITY_PATTERNS) -> Column:
    """First level, in the order given, with a pattern found in the lower-cased text; else unknown."""
    lowered = F.lower(as_column(text))
    label = F
    for level, level_patterns in patterns.items():
        label = label.when(any_match(lowered, level_patterns), level)
    return label.otherwise("unknown")


def label_from_answer(answer: Column | str) -> Column:
    """Label named in a free-text answer; info if it names none."""
    answer = F.lower(strip_or_empty(answer))
    label = F.when(F.contains(answer, F.lit("severe")), "severe")
    for level in ("moderate", "minor"):
        label = label.when(F.contains(answer, F.lit(level)), level)
    return label.otherwise("info")


def final_label(rule_label: Column | str, answer_label: Column | str) -> Column:
    """Rule label, else the answer, else info."""
    rule = F.nullif(as_column(rule_label), F.lit("unknown"))
    return F.coalesce(rule, as_column(answer_label), F.lit("info"))


def severity_rank(label: Column | str, order: Sequence[str] = SEVERITY_ORDER) -> Column:
    """Position in the severity order; 0 for a label outside it."""
    levels = F.array(*[F.lit(x) for x in order])
    position = F.array_position(levels, as_column(label)).cast("int")
    return F.greatest(F.coalesce(position, F.lit(0)) - 1, F.lit(0))


def _lookup(label: Column, words: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in words.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(default))


def severity_marker(label: Column | str) -> Column:
    """Display marker; letter case is ignored and null is unknown."""
    return _lookup(F.lower(F.coalesce(as_column(label), F.lit(""))), SEVERITY_MARKERS, UNKNOWN_MARKER)


def severity_arabic(label: Column | str) -> Column:
    return _lookup(F.coalesce(as_column(label), F.lit("")), SEVERITY_ARABIC, UNKNOWN_ARABIC)


def combine_labels(
    neighbor: Column | str, classifier: Column | str, order: Sequence[str] = SEVERITY_ORDER
) -> Column:
    """The neighbours' label if it is strictly more severe, else the classifier's."""
    neighbor, classifier = as_column(neighbor), as_column(classifier)
    return F.when(severity_rank(neighbor, order) > severity_rank(classifier, order), neighbor).otherwise(classifier)


def confidence_level(
    agreement: Column | str,
    confidence: Column | str,
    high: float = HIGH_CONFIDENCE,
    medium: float = MEDIUM_CONFIDENCE,
) -> Column:
    agreement, confidence = as_column(agreement), as_column(confidence)
    return (
        F.when(agreement & (confidence >= high), "high")
        .when(agreement | (confidence >= medium), "medium")
        .otherwise("low")
    )
