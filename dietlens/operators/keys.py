"""Row keys, checks that two tables hold the same keys, and codes for categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dietlens.session import lookup_join, materialize

_IN_PARTITION = (1 << 33) - 1


def add_row_id(df: DataFrame, order_by: list[str], name: str = "row_id") -> DataFrame:
    """Contiguous 0..N-1 in the order of `order_by`, which must identify a row.

    Range partitioning sorts the rows in parallel and splits on the whole tuple, so a hot first
    column is split too. The sorted rows are written once, because range bounds come from a sample
    and may fall elsewhere when recomputed; then each partition's offset, the rows before it, is
    broadcast. That table has one row per partition.
    """
    if name in df.columns:
        return df
    placed = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    )
    stored = materialize(placed, "row-id")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .select(*df.columns, name)
    )


def unaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, as (key, missing_in). One shuffle of the bare keys."""
    sides = (
        left.select(key, F.lit(True).alias("_left"))
        .join(right.select(key, F.lit(True).alias("_right")), key, "full_outer")
    )
    return sides.filter(F.col("_left").isNull() | F.col("_right").isNull()).select(
        key, F.when(F.col("_left").isNull(), "left").otherwise("right").alias("missing_in")
    )


def check_alignment(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise if a row lacks its vector or a vector its row."""
    bad = unaligned(left, right, key).first()
    if bad is not None:
        raise ValueError(f"{key} {bad[key]} is missing on the {bad['missing_in']} side")


def unknown_ids(ids: DataFrame, corpus: DataFrame, key: str = "row_id") -> DataFrame:
    """Requested ids that the corpus does not hold."""
    return ids.join(corpus.select(key), key, "left_anti")


def check_ids(ids: DataFrame, corpus: DataFrame, key: str = "row_id") -> None:
    bad = unknown_ids(ids, corpus, key).first()
    if bad is not None:
        raise ValueError(f"{key} {bad[key]} is out of range")


def category_codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Distinct labels with dense codes 0..K-1 in sorted order; null has no code."""
    distinct = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return add_row_id(distinct, [label], code)


def add_category_code(df: DataFrame, label: str, row_key: list[str], code: str = "code") -> DataFrame:
    """The label's code on every row; -1 where the label is null."""
    coded = lookup_join(df, category_codes(df, label, code), label, row_key)
    return coded.withColumn(code, F.coalesce(F.col(code), F.lit(-1)))
