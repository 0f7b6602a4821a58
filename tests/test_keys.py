import pytest
from pyspark.sql import functions as F

from dietlens.operators import keys
from dietlens.session import lookup_join


def test_row_id_is_contiguous_and_in_order(spark):
    # A third of the rows share one first key.
    rows = [(i % 3 and i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a LONG, b LONG").repartition(7)
    got = keys.add_row_id(df, ["a", "b"]).orderBy("a", "b").collect()
    assert [r.row_id for r in got] == list(range(3000))


def test_row_id_is_kept_if_there(spark):
    df = spark.createDataFrame([(5,), (9,)], "row_id LONG")
    assert {r.row_id for r in keys.add_row_id(df, ["row_id"]).collect()} == {5, 9}


def test_alignment(spark):
    left, right = spark.range(0, 5).toDF("row_id"), spark.range(1, 6).toDF("row_id")
    got = {tuple(r) for r in keys.unaligned(left, right, "row_id").collect()}
    assert got == {(0, "right"), (5, "left")}
    with pytest.raises(ValueError):
        keys.check_alignment(left, right, "row_id")
    keys.check_alignment(left, left, "row_id")


def test_unknown_ids(spark):
    corpus = spark.range(5).toDF("row_id")
    ids = spark.createDataFrame([(-1,), (4,), (5,)], "row_id LONG")
    assert {r.row_id for r in keys.unknown_ids(ids, corpus).collect()} == {-1, 5}
    with pytest.raises(ValueError):
        keys.check_ids(ids, corpus)


def test_category_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b"), (4, "c")], "i INT, l STRING")
    got = {r.i: r.code for r in keys.add_category_code(df, "l", ["i"]).collect()}
    assert got == {0: 1, 1: -1, 2: 0, 3: 1, 4: 2}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_beyond_the_broadcast_bound(spark, how):
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = {tuple(r) for r in lookup_join(left, right, "k", ["id"], how).select("id", "k", "v").collect()}
    large = {tuple(r) for r in lookup_join(left, right, "k", ["id"], how, max_rows=10).select("id", "k", "v").collect()}
    assert small == large and len(large) == (1000 if how == "left" else len(small))
