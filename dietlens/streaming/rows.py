"""Row-wise operators on a stream of interaction rows.

They keep no state, so no watermark is needed. Ranking neighbours is per query table: call
`plans.answer.explain` inside `foreachBatch`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dietlens.constants import FOOD_LEXICON, SEVERITY_PATTERNS
from dietlens.functions.severity import classify_severity
from dietlens.functions.text import extract_terms


def label_stream(rows: DataFrame, text: str = "interaction_text", lexicon=FOOD_LEXICON, patterns=SEVERITY_PATTERNS) -> DataFrame:
    """Adds `food_entities` and `rule_label` to every arriving row."""
    return rows.withColumn("food_entities", extract_terms(text, lexicon)).withColumn(
        "rule_label", classify_severity(text, patterns)
    )
