"""Text functions on hand-written cases; expected values worked out by reading the rules."""

import pytest
from pyspark.sql import functions as F

from dietlens.constants import FOOD_LEXICON
from dietlens.functions import text as T


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, x STRING")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_strip_takes_every_unicode_space(spark):
    cases = ["  a b \t", " x ", "\x1c\x85y　", "", None, "\n"]
    assert values(spark, cases, T.strip) == ["a b", "x", "y", "", None, ""]
    assert values(spark, cases, T.is_not_blank) == [True, True, True, False, False, False]


def test_normalize_text(spark):
    cases = ["  Take  WITH\n\tFood ", "ÉTÉ x", ""]
    assert values(spark, cases, T.normalize_text) == ["take with food", "été x", ""]


def test_word_count(spark):
    assert values(spark, ["a b  c", " one two ", "", None, "x"], T.word_count) == [3, 2, 0, 0, 1]


def test_lexicon_needs_whole_words_and_keeps_contained_terms(spark):
    cases = [
        "avoid grapefruit juice and tea",
        "steak and meatballs; teatime",
        "st. john's wort, vitamin k-rich foods",
        "green_tea or x-tea-y",
        "éteaé",
    ]
    got = values(spark, cases, lambda c: T.sorted_distinct(T.lexicon_hits(c, FOOD_LEXICON)))
    assert got == [
        ["grapefruit", "grapefruit juice", "tea"],
        [],
        ["foods", "st. john's wort", "vitamin k", "vitamin k-rich foods"],
        ["tea"],
        [],
    ]


def test_term_with_punctuation_edges_needs_a_word_character_outside(spark):
    # The boundary after a final dot holds only before a word character.
    assert values(spark, ["abc.d", "abc. d"], lambda c: T.lexicon_hits(c, ["abc."])) == [["abc."], []]


def test_enumerations(spark):
    cases = [
        "foods such as kale, spinach, and broccoli. then more",
        "including st. john's wort",
        "includes tea or milk and eggs; examples include ab, abc",
        "nosuch as figs",
        "such as: figs",
        "nothing here",
    ]
    # ", and " splits twice: at the comma and at " and ", with an empty item between.
    assert values(spark, cases, T.enumeration_items) == [
        ["kale", "spinach", "broccoli"],
        [],
        ["tea", "milk", "eggs", "abc"],
        ["figs"],
        [],
        [],
    ]


def test_extract_terms_sorted_distinct(spark):
    got = values(spark, ["Dairy such as Milk, cheese or MILK"], lambda c: T.extract_terms(c, FOOD_LEXICON))
    assert got == [["cheese", "dairy", "milk"]]


def test_low_information(spark):
    df = spark.createDataFrame(
        [(0, []), (1, None), (2, ["food", "MEALS"]), (3, ["food", "kale"]), (4, ["Alcoholic Beverages"])],
        "i INT, x ARRAY<STRING>",
    )
    got = [r.v for r in df.select("i", T.is_low_information("x").alias("v")).orderBy("i").collect()]
    assert got == [True, True, True, False, True]


@pytest.mark.parametrize("raw, expected", [
    ('["tea", " milk "]', ["tea", "milk"]),
    ('Here you go:\n["tea",\n "figs"]\nDone', ["tea", "figs"]),
    ('["tea", ', []),
    ('no list', []),
    ('', []),
    (None, []),
    ('[1, 2.5, 1.0, 1e3, -3, true, false, null, {"a": 1}, ["x"], "{\\"a\\":1}"]',
     ["1", "2.5", "1.0", "1000.0", "-3", "True", "False", '{"a":1}']),
    ('[12345678.5, 0.0005, 1e16, 1.5e-7, 123456789012345678901]',
     ["12345678.5", "0.0005", "1e+16", "1.5e-07", "123456789012345678901"]),
    ('[100.0, 120, 0.0, -0.5, 10000000.0]', ["100.0", "120", "0.0", "-0.5", "10000000.0"]),
    ('[]', []),
    ('["a"] and ["b"]', []),
    ('x [1] y', ["1"]),
])
def test_parse_food_list(spark, raw, expected):
    assert values(spark, [raw], T.parse_food_list) == [expected]


def test_embedding_text(spark):
    df = spark.createDataFrame([(" Warfarin ", None, " a "), ("W", " kale ", None)], "d STRING, f STRING, t STRING")
    got = sorted(r.v for r in df.select(T.embedding_text("d", "f", "t").alias("v")).collect())
    assert got == ["Drug: W. Food: kale. Interaction: ", "Drug: Warfarin. Food: general food. Interaction: a"]


def test_contains_any_is_a_substring_test(spark):
    assert values(spark, ["carrot", "cat", None], lambda c: T.contains_any(c, ["car", "pc"])) == [True, False, False]


def test_lexicon_constants():
    assert len(FOOD_LEXICON) == len(set(FOOD_LEXICON)) == 68


def test_prompts_carry_the_text(spark):
    for prompt in (T.extraction_prompt, T.labelling_prompt):
        assert values(spark, ["the note"], prompt)[0].endswith("the note")
