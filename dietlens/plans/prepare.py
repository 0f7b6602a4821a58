"""From advice texts to a labelled, keyed and encoded corpus."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dietlens.constants import (
    ENUMERATION_MARKERS, FOOD_LEXICON, GENERIC_TERMS, SEVERITY_PATTERNS,
)
from dietlens.functions.severity import classify_severity
from dietlens.functions.text import embedding_text
from dietlens.operators.encode import EMBEDDING_SIZE, Encoder, places
from dietlens.operators.extract import extract_with_answers, flatten_terms, label_with_answers
from dietlens.operators.keys import add_row_id


def extracted_rows(
    interactions: DataFrame,
    key: Sequence[str],
    answers: DataFrame | None = None,
    lexicon: Iterable[str] = FOOD_LEXICON,
    markers: Iterable[str] = ENUMERATION_MARKERS,
    generic: Iterable[str] = GENERIC_TERMS,
    budget: int | None = None,
) -> DataFrame:
    """Interaction rows with `food_entities` and `food_entities_str`."""
    key = list(key)
    return extract_with_answers(
        interactions, "interaction_text", key, key, answers, lexicon, markers, generic, budget
    )


def labelled_triples(
    extracted: DataFrame,
    key: Sequence[str],
    answers: DataFrame | None = None,
    patterns: Mapping[str, Sequence[str]] = SEVERITY_PATTERNS,
    budget: int | None = None,
) -> DataFrame:
    """(row_id, drug_name, food, interaction_text, severity): one row per term, keyed in source order.

    `answers` is keyed by `key` plus `food_pos`.
    """
    # A text is classified once, before its terms multiply it.
    ruled = extracted.select(
        *key, "drug_name", "interaction_text", "food_entities",
        classify_severity("interaction_text", patterns).alias("rule_label"),
    )
    flat = flatten_terms(ruled, "food_entities").withColumn("food_pos", F.coalesce("food_pos", F.lit(0)))
    order = [*key, "food_pos"]
    labelled = label_with_answers(flat, "interaction_text", order, order, answers, patterns, budget)
    return add_row_id(labelled, order).select("row_id", "drug_name", "food", "interaction_text", "severity")


def with_places(rows: DataFrame, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Labelled triples with `places`, what `hashed_encoder` takes in place of their texts, so that words are hashed once."""
    return rows.withColumn("places", places(embedding_text("drug_name", "food", "interaction_text"), size))


def vectors_of(rows: DataFrame, encoder: Encoder, keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, `keep`, embedding) of labelled triples. If they have `places`, `terms` in place of embeddings: the values that are not zero."""
    if "places" in rows.columns:
        return encoder.terms(rows.select("row_id", *keep, "places"), "places", "terms").drop("places")
    texts = rows.select("row_id", *keep, embedding_text("drug_name", "food", "interaction_text").alias("embedding_text"))
    return encoder(texts, "embedding_text", "embedding").select("row_id", *keep, "embedding")
