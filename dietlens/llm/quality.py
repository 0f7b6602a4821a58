"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule bounds one ratio of two measures. Every measure is a column expression, every rule a comparison of integers, and the
verdict their conjunction: one pass over the table without a shuffle, a user function or state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.functions.text import let
from dietlens.llm.common import BLANKS, count_chars, words

# Frequent function words of the languages that the rules know. Fixed values.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "that", "is", "was", "it", "for", "on", "with", "as", "are", "be", "this", "by", "at", "from", "or", "an"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "ne", "pas", "ce"],
    "de": ["der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "für", "auf", "dem", "ein", "eine", "nicht", "des", "im", "sich", "auch", "als"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "es", "por", "con", "para", "del", "se", "no", "su", "al", "lo"],
}
SYMBOLS = "#*$%&|<>"
MARKS = "!?"


@dataclass(frozen=True)
class Rule:
    """`low` <= 1000 * measure / per <= `high`; a bound of None is open. A rule over nothing (per = 0) holds."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None


#: The threshold table. Ratios are in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 20_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("marks", "n_marks", "n_words", None, 500),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 400),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_lines", "n_marks", "n_stop_words"]


def _repeated_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found more than once. `tokens` must be bound by `let`.

    Windows are sorted by the upper bits of a hash, with their places in the lower bits: windows found more than once are among
    those with an equal neighbour. Only these are written out, sorted with their places and compared. n log n at any length.
    """
    n = F.size(tokens) - 2
    upper = F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(n)))

    def window(place: Column) -> Column:
        return F.concat_ws(" ", F.get(tokens, place), F.get(tokens, place + 1), F.get(tokens, place + 2))

    def found_twice(hashes: Column, upper: Column) -> Column:
        """Sorted places of the windows found more than once."""
        marked = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(upper).bitwiseOR(i.cast("long"))))

        def near(m: Column, other: Column, x: Column) -> Column:
            return F.get(m, other).bitwiseXOR(x).bitwiseAND(upper) == 0

        def candidates(m: Column) -> Column:
            found = F.filter(m, lambda x, k: near(m, k + 1, x) | ((k > 0) & near(m, k - 1, x)))
            return F.transform(found, lambda x: x.bitwiseAND(F.bitwise_not(upper)).cast("int"))

        def twice(w: Column) -> Column:
            return F.filter(w, lambda x, k: (F.get(w, k + 1)["s"] == x["s"]) | ((k > 0) & (F.get(w, k - 1)["s"] == x["s"])))

        places = let(marked, candidates)
        written = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("s"), i.alias("i"))))
        return F.sort_array(F.transform(let(written, twice), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        each = F.transform(starts, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3))).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))

    def count(h: Column) -> Column:
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0).cast("long")).otherwise(
            let(let(upper, lambda bits: found_twice(h, bits)), covered)
        )

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, count))


def measures(text: Column, stop_words: Sequence[str]) -> Column:
    """A struct of MEASURES. A null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))

    def of(tokens: Column, kept: Column) -> Column:
        values = {
            "n_words": F.size(tokens),
            "word_chars": F.length(text) - count_chars(text, BLANKS),
            "n_symbols": count_chars(text, SYMBOLS),
            "n_dup_lines": F.size(kept) - F.size(F.array_distinct(kept)),
            "n_repeat_words": _repeated_words(tokens),
            "n_lines": F.size(kept),
            "n_marks": count_chars(text, MARKS),
            "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(w).isin(list(stop_words)))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words(text), lambda tokens: let(lines, lambda kept: of(tokens, kept)))


def holds(rule: Rule, m: Column) -> Column:
    ratio = F.lit(1000) * m[rule.measure]
    bounds = [F.lit(True)]
    if rule.low is not None:
        bounds.append(ratio >= F.lit(rule.low) * m[rule.per])
    if rule.high is not None:
        bounds.append(ratio <= F.lit(rule.high) * m[rule.per])
    out = bounds[0]
    for bound in bounds[1:]:
        out = out & bound
    return out


def fails_base(m: Column, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])


def judge(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    rules: Sequence[Rule] = RULES,
    stop_words: dict[str, list[str]] = STOP_WORDS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Per row: the `keep` columns, MEASURES, base_failed, failed (names of the rules that do not hold) and kept.

    Rows are judged one by one, so repeated rows and null ids are judged like any other. A null or empty text, or one without
    a word, has zero measures and fails the base rule. Other columns are not read. An empty table gives an empty table.
    """
    known = sorted({w for group in stop_words.values() for w in group})

    def outcome(m: Column) -> Column:
        base = fails_base(m, min_words, max_repeat_percent)
        failed = F.filter(F.array(*[F.when(~holds(r, m), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        fields = [*[m[c].alias(c) for c in MEASURES], base.alias("base_failed"), failed.alias("failed")]
        return F.struct(*fields, (~base & (F.size(failed) == 0)).alias("kept"))

    # One expression that binds the measures, so that a filter on the result does not compute them for each of its parts.
    return docs.select(*[F.col(c) for c in keep], let(measures(F.col(text), known), outcome).alias("_out")).select(*keep, "_out.*")


def kept_rows(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    stop_words: dict[str, list[str]] = STOP_WORDS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns.

    The measures are bound inside of the condition: as a column they would be computed anew for each of its parts.
    """
    known = sorted({w for group in stop_words.values() for w in group})

    def verdict(m: Column) -> Column:
        out = ~fails_base(m, min_words, max_repeat_percent)
        for rule in rules:
            out = out & holds(rule, m)
        return out

    return docs.filter(let(measures(F.col(text), known), verdict))
