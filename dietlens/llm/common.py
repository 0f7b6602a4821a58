"""Helpers of the operators: words, tables, row identities, joins that bear hot keys, fresh column names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dietlens.session import materialize

# The characters that separate words: [\x20\x09-\x0D]. Fixed value of the contracts.
BLANKS = " \t\n\x0b\f\r"
# Share of all rows from which a key counts as hot. At most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 0.001
HOT_LEAST = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(label: str) -> str:
    """A column name that no input has."""
    return f"_{label}_{uuid.uuid4().hex[:8]}"


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among `chars`; null for null."""
    listed = "".join("\\" + c if c in "\\^-[]&|" else c for c in chars)
    return F.regexp_count(text, F.lit(f"[{listed}]"))


def words(text: Column) -> Column:
    """The maximal runs of other characters than BLANKS, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def identified(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with two more columns that identify each row, and their names.

    Rows of Parquet files are identified by file and place in the file, at no cost. Any other frame is
    written to the shared folder first, so that lost executors cannot change the identities.
    """
    at, place = fresh("file"), fresh("row")
    try:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(at), meta["row_index"].alias(place)), [at, place]
    except AnalysisException:
        return identified(materialize(df, "rows"))


def hot_limit(n_rows: int) -> int:
    return max(HOT_LEAST, int(n_rows * HOT_SHARE))


def join_counted(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], count: str, n_rows: int, narrow: Column | None = None
) -> DataFrame:
    """Inner join of `rows` with `lookup`, which holds each key once and in `count` how many of the rows have it.

    Keys with more than `hot_limit(n_rows)` rows are at most 1 / HOT_SHARE by arithmetic, so these are broadcast and
    their rows are not shuffled. The rest is joined by shuffle, where no key holds more than that limit.
    Rows of `lookup` that fail `narrow` are never broadcast; hot ones among them are left to AQE's split of skewed joins.
    Keys must not be null. Both inputs are read twice: pass written tables.
    """
    on = list(on)
    limit = hot_limit(n_rows)
    is_hot = (F.col(count) > limit) & (F.lit(True) if narrow is None else narrow)
    hot, cold = lookup.filter(is_hot), lookup.filter(~is_hot)
    return rows.join(F.broadcast(hot), on).unionByName(
        rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    )


def null_last(value: Column) -> Column:
    """A struct that orders as `value` with null behind all others."""
    return F.struct(value.isNull().alias("none"), value.alias("value"))
