"""Text functions: whitespace, normal form, list items, lexicon terms, answer parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dietlens.constants import ENUMERATION_MARKERS, GENERAL_FOOD, GENERIC_TERMS

# Unicode whitespace as one Java character class, and as the plain characters.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# A word character is a letter, a digit or an underscore in any script.
WORD = r"[\p{L}\p{N}_]"

EXTRACTION_PROMPT = (
    "List every food, drink, herb and supplement named in the note below, leaving out drugs. "
    "Reply with a JSON array of strings only.\n\nNote:\n"
)
LABELLING_PROMPT = (
    "How serious is the food interaction in this note? "
    "Reply with one word out of severe, moderate, minor, info.\n\nNote:\n"
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once.

    A column used many times in one expression is otherwise computed anew in every branch.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace (`trim` alone removes spaces only)."""
    return F.trim(as_column(text), F.lit(SPACE_CHARS))


def strip_or_empty(text: Column | str) -> Column:
    return F.coalesce(strip(text), F.lit(""))


def is_not_blank(text: Column | str) -> Column:
    """False for null, empty and whitespace-only text."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def normalize_text(text: Column | str) -> Column:
    """Lower case, whitespace runs as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(as_column(text)), SPACE + "+", " "))


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    words = F.split(strip_or_empty(text), SPACE + "+")
    return F.size(F.filter(words, lambda w: w != ""))


def contains_any(text: Column | str, tokens: Iterable[str]) -> Column:
    """True if any token is a plain substring; null text has none."""
    text = as_column(text)
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(text, F.lit(token))
    return F.coalesce(found, F.lit(False))


def any_match(text: Column | str, patterns: Iterable[str]) -> Column:
    """Unanchored search for any of the patterns.

    Plain words are searched as substrings, several times faster than an alternation in one pattern.
    """
    text = as_column(text)
    found = F.lit(False)
    for pattern in patterns:
        plain = all(c.isalnum() or c == " " for c in pattern)
        found = found | (F.contains(text, F.lit(pattern)) if plain else text.rlike(pattern))
    return found


def whole_word_pattern(term: str) -> str:
    """Java pattern that finds `term` between two word boundaries of any script."""
    def edge(char: str) -> bool:
        return char.isalnum() or char == "_"

    before = rf"(?<!{WORD})" if edge(term[0]) else rf"(?<={WORD})"
    after = rf"(?!{WORD})" if edge(term[-1]) else rf"(?={WORD})"
    return before + r"\Q" + term + r"\E" + after


def lexicon_hits(normalized: Column | str, lexicon: Iterable[str]) -> Column:
    """Terms of a small lexicon that stand in the normalized text as whole words.

    Each term is tested by itself, so a term inside a longer term is found as well. The cheap
    substring test runs first; the pattern only decides about the word boundaries. For a lexicon of
    thousands of terms use `operators.extract.match_terms_by_join`.
    """
    terms = sorted(set(lexicon))
    if not terms:
        return F.array().cast("array<string>")

    def hits(text: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.contains(text, F.lit(t)) & text.rlike(whole_word_pattern(t)), F.lit(t)) for t in terms
        ]))

    return let(as_column(normalized), hits)


def enumeration_items(normalized: Column | str, markers: Iterable[str] = ENUMERATION_MARKERS) -> Column:
    """Items listed after a marker, up to the next `.`, `;` or `:`.

    Markers are regular expressions and need no word boundary before them. Items shorter than three
    characters are dropped.
    """
    pattern = "(?:" + "|".join(markers) + ")" + SPACE + r"+([^.;:]+)"
    segments = F.regexp_extract_all(as_column(normalized), F.lit(pattern), F.lit(1))
    parts = F.flatten(F.transform(segments, lambda s: F.split(s, ",| and | or ")))
    items = F.transform(parts, lambda p: F.trim(p, F.lit(" .;:")))
    return F.filter(items, lambda i: F.length(i) >= 3)


def sorted_distinct(items: Column | str) -> Column:
    """Distinct items in code-point order."""
    return F.array_sort(F.array_distinct(as_column(items)))


def extract_terms(
    text: Column | str, lexicon: Iterable[str], markers: Iterable[str] = ENUMERATION_MARKERS
) -> Column:
    """Lexicon terms and listed items of a raw text, sorted and distinct."""
    return let(normalize_text(text), lambda normalized: sorted_distinct(
        F.concat(lexicon_hits(normalized, lexicon), enumeration_items(normalized, markers))
    ))


def join_terms(items: Column | str) -> Column:
    return F.array_join(as_column(items), "; ")


def is_low_information(foods: Column | str, generic: Iterable[str] = GENERIC_TERMS) -> Column:
    """True for a null or empty list and for a list of generic terms only."""
    foods = F.coalesce(as_column(foods), F.array().cast("array<string>"))
    lowered = F.transform(foods, F.lower)
    return F.size(F.array_except(lowered, F.array(*[F.lit(g) for g in generic]))) == 0


def _python_number(number: Column) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16, else an exponent."""
    size = F.abs(number)
    as_decimal = F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(as_decimal.endswith("."), F.concat(as_decimal, F.lit("0"))).otherwise(as_decimal)
    java = number.cast("string")
    exponent = F.regexp_extract(java, r"E-?(\d+)$", 1)
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", ""),
        F.when(F.contains(java, F.lit("E-")), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent),
    )
    java_is_plain = (size >= 1e-3) & (size < 1e7) | (size == 0)
    python_is_plain = (size >= 1e-4) & (size < 1e16)
    return F.when(java_is_plain, java).when(python_is_plain, plain).otherwise(scientific)


def parse_food_list(raw: Column | str) -> Column:
    """Strings and numbers of the JSON list in a free-text answer, as trimmed text.

    The list runs from the first `[` to the last `]`. Nested lists, objects and nulls are dropped;
    broken JSON and a missing list give an empty array. Booleans count as numbers and come out as
    `True` and `False`.
    """
    snippet = F.regexp_extract(as_column(raw), r"(?s)\[.*\]", 0)
    # Wrapping the list in an object makes text after the first closed list a syntax error.
    parsed = F.try_parse_json(F.concat(F.lit('{"v":'), snippet, F.lit("}")))
    items = F.try_variant_get(parsed, "$.v", "array<variant>")

    def to_text(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        text = F.try_variant_get(item, "$", "string")
        number = F.try_variant_get(item, "$", "double")
        return (
            F.when(kind == "STRING", strip(text))
            .when(kind == "BOOLEAN", F.initcap(text))
            # Integers are BIGINT or, from 19 digits on, decimals; a shorter decimal was written as 1.0.
            .when(kind.rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$"), text)
            .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), _python_number(number))
        )

    texts = F.array_compact(F.transform(items, to_text))
    return F.coalesce(texts, F.array().cast("array<string>"))


def embedding_text(drug: Column | str, food: Column | str, text: Column | str) -> Column:
    """The one text form that is encoded; a null food is general food."""
    food_text = F.coalesce(strip(food), F.lit(GENERAL_FOOD))
    return F.concat(
        F.lit("Drug: "), strip_or_empty(drug),
        F.lit(". Food: "), food_text,
        F.lit(". Interaction: "), strip_or_empty(text),
    )


def extraction_prompt(text: Column | str) -> Column:
    """Prompt column for offline inference on rows whose rule-based list says little."""
    return F.concat(F.lit(EXTRACTION_PROMPT), F.coalesce(as_column(text), F.lit("")))


def labelling_prompt(text: Column | str) -> Column:
    """Prompt column for offline inference on rows that no severity rule matches."""
    return F.concat(F.lit(LABELLING_PROMPT), F.coalesce(as_column(text), F.lit("")))
