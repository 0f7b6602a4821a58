"""Which queries are worth answering, and the message for those that are not."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.constants import IRRELEVANT_WORDS
from dietlens.functions.text import contains_any, is_not_blank, strip_or_empty, whole_word_pattern, word_count
from dietlens.operators.extract import vocabulary
from dietlens.session import lookup_join

# Own wording, Arabic: what to say for each reason of rejection.
MESSAGES = {
    "missing_drug_or_food": "ينقص السؤالَ اسمُ الدواء أو اسم الطعام. اكتب الاسمين كاملين من فضلك.",
    "irrelevant_domain": "هذا السؤال خارج موضوع تداخل الأدوية مع الطعام والأعشاب.",
    "unknown_drug": "لا نجد هذا الدواء في بياناتنا. راجع كتابة الاسم كما في العبوة: ",
}
REJECTION_NOTE = "⚠️ لا يغني هذا الجواب عن رأي الطبيب أو الصيدلي."


def drug_vocabulary(rows: DataFrame, drug: str = "drug_name") -> DataFrame:
    """Distinct lower-cased drug names as `drug_key`."""
    return vocabulary(rows, drug, "drug_key", lower=True)


def flag_known(df: DataFrame, key: Column, known: DataFrame, flag: str, row_key: list[str]) -> DataFrame:
    """Adds `flag`: whether `key` is in the one-column table `known` (`drug_key`)."""
    listed = known.select("drug_key", F.lit(True).alias(flag))
    joined = lookup_join(df.withColumn("drug_key", key), listed, "drug_key", row_key)
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("drug_key")


def contains_word(text: Column, words: Iterable[str], whole_words: bool = False) -> Column:
    if not whole_words:
        return contains_any(text, words)
    return text.rlike("|".join(whole_word_pattern(w) for w in words))


def check_relevance(
    queries: DataFrame,
    vocabulary: DataFrame,
    query_id: str = "query_id",
    irrelevant_words: Iterable[str] = IRRELEVANT_WORDS,
    whole_words: bool = False,
) -> DataFrame:
    """Adds `relevant`, `relevance_reason` and `relevance_message`.

    Tests in order: a name shorter than two characters, an off-topic word in any part, a drug outside
    the vocabulary. A question of fewer than three words is `low_context` but relevant. Off-topic
    words match inside longer words too, unless `whole_words`.
    """
    drug, food, text = (strip_or_empty(c) for c in ("drug_name", "food", "interaction_text"))
    words = list(irrelevant_words)
    off_topic = F.lit(False)
    for part in (text, food, drug):
        off_topic = off_topic | contains_word(F.lower(part), words, whole_words)
    reason = (
        F.when((F.length(F.lower(drug)) < 2) | (F.length(F.lower(food)) < 2), "missing_drug_or_food")
        .when(off_topic, "irrelevant_domain")
        .when(~F.col("_known"), "unknown_drug")
        .when(word_count("interaction_text") < 3, "low_context")
        .otherwise("ok")
    )
    flagged = flag_known(queries, F.lower(drug), vocabulary, "_known", [query_id])
    message = (
        F.when(F.col("relevance_reason") == "unknown_drug", F.concat(F.lit(MESSAGES["unknown_drug"]), drug))
        .when(F.col("relevance_reason") == "irrelevant_domain", MESSAGES["irrelevant_domain"])
        .when(F.col("relevance_reason") == "missing_drug_or_food", MESSAGES["missing_drug_or_food"])
    )
    return (
        flagged.withColumn("relevance_reason", reason)
        .withColumn("relevant", F.col("relevance_reason").isin("ok", "low_context"))
        .withColumn("relevance_message", message)
        .select(*queries.columns, "relevant", "relevance_reason", "relevance_message")
    )


def validation_error(drug: str = "drug_name", food: str = "food") -> Column:
    """What a form must ask for before a query is sent: a chosen drug, then a food; null if complete."""
    return F.when(F.col(drug).isNull(), "choose_drug").when(~is_not_blank(food), "enter_food")
