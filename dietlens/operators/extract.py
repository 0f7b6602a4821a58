"""Term extraction over tables: large lexicons, flattening, fallback answers, vocabularies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.constants import (
    ENUMERATION_MARKERS, FOOD_LEXICON, GENERIC_TERMS, SEVERITY_PATTERNS,
)
from dietlens.functions.severity import classify_severity, final_label, label_from_answer
from dietlens.functions.text import (
    WORD, as_column, enumeration_items, extract_terms, is_low_information, join_terms, normalize_text, parse_food_list, sorted_distinct,
)
from dietlens.session import lookup_join, materialize


def _segments(text: Column) -> Column:
    """Runs of word characters and the runs between them, in text order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD}+|[^\\p{{L}}\\p{{N}}_]+)"), F.lit(1))


def match_terms_by_join(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, term) for every term of a lexicon table that stands in the text as whole words.

    Word boundaries lie between segments only, so a whole-word match is a run of whole segments.
    Each text yields its distinct runs, of the lengths that terms have, and an equi-join finds the
    terms among them: the work does not grow with texts times terms.
    """
    terms = lexicon.select("term").filter(F.length("term") > 0).distinct()
    lengths = [r.n for r in terms.select(F.size(_segments(F.col("term"))).alias("n")).distinct().collect()]
    if not lengths:
        lengths = [1]
    def runs_of(n: int) -> Column:
        segments = F.col("_segments")
        if n == 1:
            return segments
        starts = F.when(F.size(segments) >= n, F.sequence(F.lit(1), F.size(segments) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(segments, i, n), ""))

    runs = F.array_distinct(F.flatten(F.array(*[runs_of(n) for n in sorted(lengths)])))
    candidates = (
        # The ends of a text are boundaries beside a word character only, so a mark is set before the
        # segments are cut: it stands alone beside a word and joins any other characters.
        df.select(key, _segments(F.concat(F.lit("\x00"), normalize_text(text), F.lit("\x00"))).alias("_segments"))
        .select(key, F.explode(runs).alias("term"))
    )
    return lookup_join(candidates, terms, "term", [key], how="inner").select(key, "term")


def extract_with_lexicon_table(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, markers: Iterable[str] = ENUMERATION_MARKERS
) -> DataFrame:
    """Adds `food_entities` like `extract_terms`, for a lexicon table of any size.

    Only the bare matches are grouped, and a group holds the distinct terms of one text.
    """
    found = match_terms_by_join(df, key, text, lexicon).groupBy(key).agg(F.collect_list("term").alias("_found"))
    known = F.coalesce("_found", F.array().cast("array<string>"))
    items = enumeration_items(normalize_text(text), markers)
    return df.join(found, key, "left").withColumn("food_entities", sorted_distinct(F.concat(known, items))).drop("_found")


def flatten_terms(df: DataFrame, terms: str, food: str = "food") -> DataFrame:
    """One row per listed term; an empty or null list gives one row with a null food."""
    kept = [c for c in df.columns if c != terms]
    return df.select(*kept, F.posexplode_outer(terms).alias("food_pos", food))


def vocabulary(df: DataFrame, column: str, name: str = "value", lower: bool = False) -> DataFrame:
    """Distinct non-null values."""
    value = F.lower(column) if lower else F.col(column)
    return df.filter(F.col(column).isNotNull()).select(value.alias(name)).distinct()


def sorted_vocabulary(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return vocabulary(df, column, name).orderBy(name)


def usable_answers(
    answers: DataFrame,
    key: list[str],
    unresolved: DataFrame | None = None,
    order_by: list[str] | None = None,
    budget: int | None = None,
) -> DataFrame:
    """(key, raw_response) of the answers that count: those with status `ok`, one per key.

    Of several answers to one key the first in sort order counts. With a `budget`, only the first so many `unresolved` rows
    in row order may use an answer; by default all may.
    """
    given = answers.filter((F.col("status") == "ok") & F.col("raw_response").isNotNull())
    given = given.groupBy(*key).agg(F.min("raw_response").alias("raw_response"))
    if budget is None:
        return given
    first = unresolved.select(*dict.fromkeys(key + order_by)).orderBy(*order_by).limit(budget)
    return given.join(first.select(*key), key, "left_semi")


def extract_with_answers(
    df: DataFrame,
    text: str,
    key: list[str],
    order_by: list[str],
    answers: DataFrame | None = None,
    lexicon: Iterable[str] = FOOD_LEXICON,
    markers: Iterable[str] = ENUMERATION_MARKERS,
    generic: Iterable[str] = GENERIC_TERMS,
    budget: int | None = None,
) -> DataFrame:
    """Adds `food_entities` and `food_entities_str`; a `food_entities` column already there is used.

    Rows whose rule-based list says little take their answer's list in as well.
    """
    kept = [c for c in df.columns if c != "food_entities"]
    ruled = df
    if "food_entities" not in df.columns:
        ruled = df.withColumn("food_entities", extract_terms(text, lexicon, markers))
    if answers is not None:
        little = is_low_information("food_entities", generic)
        if budget is not None:
            ruled = materialize(ruled, "extracted")  # read twice from here on, and dear to compute
        usable = usable_answers(answers, key, ruled.filter(little), order_by, budget)
        extra = parse_food_list(F.coalesce("raw_response", F.lit("")))
        taken = F.when(little & F.col("raw_response").isNotNull(), sorted_distinct(F.array_union("food_entities", extra)))
        ruled = (
            ruled.join(usable, key, "left")
            .withColumn("food_entities", F.coalesce(taken, F.col("food_entities")))
            .select(*kept, "food_entities")
        )
    return ruled.withColumn("food_entities_str", join_terms("food_entities"))


def label_with_answers(
    df: DataFrame,
    text: str,
    key: list[str],
    order_by: list[str],
    answers: DataFrame | None = None,
    patterns=SEVERITY_PATTERNS,
    budget: int | None = None,
    label: str = "severity",
) -> DataFrame:
    """Adds the severity: the rule's label, else the answer's, else info.

    A `rule_label` column that is already there is used.
    """
    ruled = df if "rule_label" in df.columns else df.withColumn("rule_label", classify_severity(text, patterns))
    answer = F.lit(None).cast("string")
    if answers is not None:
        usable = usable_answers(answers, key, ruled.filter(as_column("rule_label") == "unknown"), order_by, budget)
        ruled = ruled.join(usable, key, "left")
        answer = F.when(F.col("raw_response").isNotNull(), label_from_answer("raw_response"))
    kept = [c for c in df.columns if c != "rule_label"]
    return ruled.withColumn(label, final_label("rule_label", answer)).select(*kept, "rule_label", label)
