"""Vector store, run metadata, per-model reports and saved explanations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str, key: str = "row_id", vector: str = "embedding") -> None:
    """Keyed vectors as Parquet, apart from the text columns."""
    vectors.select(F.col(key).alias("row_id"), F.col(vector).cast("array<float>").alias("embedding")).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id LONG, embedding ARRAY<FLOAT>").parquet(path)


def vector_metadata(vectors: DataFrame, vector: str = "embedding", **facts: str) -> DataFrame:
    """One row of run metadata: row count, dimension and the facts given by the caller."""
    return vectors.agg(
        F.count("*").alias("num_rows"),
        F.max(F.size(vector)).alias("embedding_dim"),
        *[F.lit(value).alias(name) for name, value in facts.items()],
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    """One JSON object."""
    metadata.coalesce(1).write.json(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The metadata row, or None if it was never written."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_summary(summary: DataFrame, path: str) -> None:
    """A model or clustering summary as JSON lines."""
    summary.write.json(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """One text per key as Parquet, for any number of texts."""
    df.select(F.col(key).alias("key"), F.col(text).alias("text")).write.parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, text)"""
    return spark.read.parquet(path)


def write_text_per_name(df: DataFrame, path: str, name: str, text: str) -> None:
    """UTF-8 text files, one folder per `name`.

    For reports and handfuls of explanations. Millions of explanations belong in one Parquet table.
    """
    df.select(F.col(name), F.col(text).alias("value")).write.partitionBy(name).option("lineSep", "\n").text(path)
