"""Class weights and a stratified train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dietlens.constants import SEED, TEST_FRACTION
from dietlens.session import lookup_join

_HASH_BITS = 32


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # The window runs over one row per class.
    every = Window.partitionBy()
    rows, classes = F.sum("n").over(every), F.count("*").over(every)
    return counts.select(label, "n", (rows / (classes * F.col("n"))).alias("weight"))


def add_class_weight(df: DataFrame, label: str, row_key: list[str], weight: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(weight))
    return lookup_join(df, weights, label, row_key, how="inner")


def split_hash(key: str, seed: int = SEED) -> Column:
    """32 bits of MD5 over key and seed: the same in every engine."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, _HASH_BITS // 4), 16, 10).cast("long")


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    fraction: float = TEST_FRACTION,
    seed: int = SEED,
    bucket_bits: int = 16,
) -> DataFrame:
    """Adds `is_test`: in each class the round(fraction * n) rows of smallest (hash, key).

    Sorting a class would put it into one task. Instead rows are counted per hash bucket, the bucket
    in which each class reaches its quota is found from the counts, and only that bucket's rows are
    ranked for the exact border. The rows themselves are compared to the border, not shuffled.
    """
    hashed = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), split_hash(key, seed).alias("_h"))
    bucket = F.shiftright(F.col("_h"), _HASH_BITS - bucket_bits)
    counts = hashed.groupBy("_label", bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_label")
    quota = F.floor(F.col("_total") * fraction + 0.5).cast("long")
    borders = (
        counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_quota", quota)
        .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select("_label", "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    in_border = (
        hashed.withColumn("_bucket", bucket)
        .join(F.broadcast(borders), ["_label", "_bucket"])
        .withColumn("_place", F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_key")))
    )
    last = (
        in_border.filter(F.col("_place") == F.col("_need"))
        .select(F.col("_label").alias(label), F.col("_h").alias("_last_h"), F.col("_key").alias("_last_key"))
    )
    marked = lookup_join(df.withColumn("_h", split_hash(key, seed)), last, label, [key])
    inside = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col(key) <= F.col("_last_key")))
    return marked.withColumn("is_test", F.coalesce(inside, F.lit(False))).select(*df.columns, "is_test")


def check_splittable(df: DataFrame, label: str) -> None:
    """Raise if a class has a single member."""
    lone = df.groupBy(label).count().filter(F.col("count") < 2).first()
    if lone is not None:
        raise ValueError(f"class {lone[label]!r} has one member only")
