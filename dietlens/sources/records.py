"""Record readers and writers: nested drug records, JSON records, CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dietlens.constants import FOOD_LEXICON
from dietlens.functions.text import is_not_blank, strip, strip_or_empty
from dietlens.session import spread

RAW_SCHEMA = "name STRING, reference STRING, food_interactions ARRAY<STRING>"


def flatten_records(records: DataFrame) -> DataFrame:
    """One row per non-blank advice text of nested `RAW_SCHEMA` records, all parts stripped.

    A missing or null name or reference becomes ''. `text_pos` is the place in the record's list;
    other columns of `records`, such as a key, are kept.
    """
    carried = [c for c in records.columns if c not in ("name", "reference", "food_interactions")]
    # The outer form spares the filter on the whole list that Spark puts before an inner one; the
    # rows it adds have no text.
    exploded = records.select(
        *carried, "name", "reference", F.posexplode_outer("food_interactions").alias("text_pos", "_text")
    )
    return exploded.filter(is_not_blank("_text")).select(
        *carried,
        "text_pos",
        strip_or_empty("name").alias("drug_name"),
        strip("_text").alias("interaction_text"),
        strip_or_empty("reference").alias("reference"),
    )


def load_drug_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Interaction rows of a JSON file of drug records, keyed by (entry_id, text_pos).

    A JSON array in one file is read by one task and its records are spread after that. For large
    inputs use JSON Lines and `multi_line=False`, which splits.
    """
    raw = spark.read.schema(RAW_SCHEMA).option("multiLine", multi_line).json(path)
    return flatten_records(spread(raw.withColumn("entry_id", F.monotonically_increasing_id())))


def split_lines(documents: DataFrame, key: str, drug: str, text: str) -> DataFrame:
    """Interaction rows of a table of documents: one per non-blank line of `text`."""
    records = documents.select(
        key,
        F.col(drug).alias("name"),
        F.lit("").alias("reference"),
        F.split(F.col(text), "\n").alias("food_interactions"),
    )
    return flatten_records(records)


def read_json_records(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON records; `multi_line` for an array of objects in one file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """JSON Lines in UTF-8; null fields are written."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_csv_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header; an empty field is null, a quoted empty field is an empty string."""
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", True).option("escape", '"')
        # An own mark for empty fields keeps them apart from quoted empty strings.
        .option("nullValue", "\x00").option("emptyValue", "")
        .csv(path)
    )


def write_csv_records(df: DataFrame, path: str) -> None:
    """CSV with header and no index. Array columns must be joined to text before."""
    (
        df.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def load_lexicon(spark: SparkSession, path: str | None = None, terms: list[str] = FOOD_LEXICON) -> DataFrame:
    """Distinct lower-cased terms: the built-in ones and one per line of an optional file.

    A path that does not exist leaves the built-in terms.
    """
    lexicon = spark.createDataFrame([(t,) for t in terms], "term STRING").select(F.lower("term").alias("term"))
    if path is not None:
        try:
            extra = spark.read.text(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            extra = extra.filter(is_not_blank("value")).select(F.lower(strip("value")).alias("term"))
            lexicon = lexicon.unionByName(extra)
    return lexicon.distinct()


def lexicon_terms(lexicon: DataFrame, most: int = 2000) -> list[str]:
    """The terms of a small lexicon, for `extract_terms`; a larger one goes to `extract_with_lexicon_table`."""
    terms = [r.term for r in lexicon.select("term").limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"more than {most} terms: use extract_with_lexicon_table")
    return sorted(terms)
