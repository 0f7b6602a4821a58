import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from dietlens.functions import vectors as V
from dietlens.operators import knn
from dietlens.operators.sparse import sparse
from dietlens.session import materialize


def brute(qs, rows, k):
    """(query id, rank, row id, distance) by plain numpy."""
    out = set()
    ids = np.array([r[0] for r in rows])
    matrix = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    norms = np.linalg.norm(matrix, axis=1)
    for qid, q in qs:
        q = np.array(q, dtype=np.float32).astype(float)
        sims = matrix @ q / np.where(norms == 0, 1, norms) / (np.linalg.norm(q) or 1)
        dist = np.round(1 - sims, 9)
        for rank, j in enumerate(np.lexsort((ids, dist))[:k], start=1):
            out.add((qid, rank, int(ids[j]), round(float(dist[j]), 6) + 0.0))
    return out


def found(df):
    return {(r.query_id, r["rank"], r.row_id, round(r.distance, 6) + 0.0) for r in df.collect()}


def tables(spark, rows, qs, parts=5):
    corpus = spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "row_id LONG, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in qs], "query_id LONG, embedding ARRAY<FLOAT>")
    return corpus.repartition(parts), queries


@pytest.mark.parametrize("blocked", [False, True])
def test_against_brute_force_with_a_third_of_copies(spark, blocked):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8)) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(100)]
    rows += [(300, np.zeros(8)), (301, -np.array(rows[3][1]))]
    qs = [(i, rows[i][1]) for i in range(40)] + [(99, np.zeros(8))]
    corpus, queries = tables(spark, rows, qs)
    options = {"broadcast_bytes": 8, "slice_bytes": 1600} if blocked else {}
    assert found(knn.nearest(queries, corpus, 10, **options)) == brute(qs, rows, 10)


def test_more_queries_than_corpus_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4)) for i in range(40)] + [(40 + i, [1, 0, 0, 0]) for i in range(20)]
    qs = [(i, rng.normal(size=4)) for i in range(200)] + [(900, [1, 0, 0, 0])]
    corpus, queries = tables(spark, rows, qs)
    got = knn.nearest(queries, corpus, 7, broadcast_bytes=8 * 4 * 60)
    assert found(got) == brute(qs, rows, 7)
    assert "Exchange" not in got.select("query_id")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_many_batches_in_one_partition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4)) for i in range(300)] + [(300 + i, [1, 0, 0, 0]) for i in range(200)]
    order = rng.permutation(len(rows))
    qs = [(i, rng.normal(size=4)) for i in range(20)] + [(50, [1, 0, 0, 0]), (51, [0, 0, 0, 0])]
    corpus, queries = tables(spark, [rows[i] for i in order], qs, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert found(knn.nearest(queries, corpus, 7)) == brute(qs, rows, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("blocked", [False, True])
def test_k_above_the_corpus(spark, blocked):
    rows = [(0, [1, 0]), (1, [0, 1]), (2, [-1, 0])]
    corpus, queries = tables(spark, rows, [(5, [1, 0]), (6, [0, 2])], 2)
    options = {"broadcast_bytes": 8, "slice_bytes": 32} if blocked else {}
    got = {(r.query_id, r["rank"]): (r.row_id, r.distance, r.similarity) for r in knn.nearest(queries, corpus, 9, **options).collect()}
    assert got == {
        (5, 1): (0, 0.0, 1.0), (5, 2): (1, 1.0, 0.0), (5, 3): (2, 2.0, 0.0),
        (6, 1): (1, 0.0, 1.0), (6, 2): (0, 1.0, 0.0), (6, 3): (2, 1.0, 0.0),
    }


def test_string_ids_and_ties_in_sort_order(spark):
    corpus = spark.createDataFrame([("tea", [1.0, 0.0]), ("milk", [1.0, 0.0]), ("figs", [0.0, 1.0])], "f STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "q STRING, embedding ARRAY<FLOAT>")
    for options in ({}, {"broadcast_bytes": 8, "slice_bytes": 8}):
        got = {(r.q, r.f) for r in knn.nearest(queries, corpus, 1, query_id="q", row_id="f", **options).collect()}
        assert got == {("x", "milk"), ("y", "figs")}


def test_no_queries_and_no_corpus(spark):
    corpus, queries = tables(spark, [(0, [1.0])], [(0, [1.0])])
    assert knn.nearest(queries.filter("false"), corpus, 3).count() == 0
    assert knn.nearest(queries, corpus.filter("false"), 3).count() == 0


def test_hot_neighbours_are_joined_in_parts(spark):
    pairs = [(q, 1, 0 if q % 3 == 0 else q) for q in range(900)]
    neighbors = spark.createDataFrame(pairs, "query_id LONG, rank INT, row_id LONG")
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("text"))
    for hot in (10, 100_000):
        got = sorted(tuple(r) for r in knn.attach_rows(neighbors, rows, hot=hot).select("query_id", "rank", "row_id", "text").collect())
        assert got == [(q, k, r, f"t{r}") for q, k, r in pairs]


def test_expression_form_agrees(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")
    ids = emb.select("row_id").filter("row_id in (0, 3, 77)")
    got = knn.nearest_by_row_id(ids, emb, 5)
    again = (
        got.join(emb.withColumnRenamed("embedding", "c"), "row_id")
        .join(emb.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
        .select("rank", "query_id", "row_id", "distance", V.cosine_distance("q", "c").alias("again")).collect()
    )
    assert len(again) == 15
    assert all(abs(r.distance - r.again) < 1e-9 for r in again)
    assert all(r.row_id == r.query_id and r.distance == 0 for r in again if r["rank"] == 1)
    with pytest.raises(ValueError):
        knn.nearest_by_row_id(spark.createDataFrame([(10**6,)], "row_id LONG"), emb, 5)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = df.select(V.l2_normalize("a").alias("n"), V.cosine_distance("a", "b").alias("d")).collect()
    assert [r.n for r in got] == [[0.6, 0.8], [0.0, 0.0]] and [r.d for r in got] == [1.0, 1.0]
    sims = spark.createDataFrame([(0, 0.25), (1, 1.5), (2, -0.1)], "i INT, d DOUBLE")
    got = [r.s for r in sims.select("i", V.similarity_from_distance("d").alias("s")).orderBy("i").collect()]
    assert got == [0.75, 0.0, 1.0]


def test_plans_have_no_cross_join(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")
    queries = emb.withColumnRenamed("row_id", "query_id")
    for options in ({}, {"broadcast_bytes": 8, "slice_bytes": 1 << 14}):
        plan = knn.nearest(queries, emb, 3, **options)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        if not options:
            assert "WindowGroupLimit" in plan


def test_scans_do_not_grow_with_the_queries(spark):
    """However many queries there are, the plan reads either side once."""
    rng = np.random.default_rng(1)
    corpus = materialize(tables(spark, [(i, rng.normal(size=4)) for i in range(300)], [(0, [1.0] * 4)])[0])
    for n in (20, 900):
        qs = [(i, rng.normal(size=4)) for i in range(n)]
        queries = materialize(tables(spark, [(0, [1.0] * 4)], qs)[1])
        out = knn._id_fields(queries, corpus, "query_id", "row_id")
        sliced = knn._sliced_top(
            queries.select("query_id", F.col("embedding").alias("_q")), corpus.select("row_id", F.col("embedding").alias("_c")), 4, 3, 1024, out
        )
        assert sliced._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2
        assert sliced.count() == n * 3 * (-(-300 * 16 // 1024))


def test_partial_rows_do_not_grow_with_the_corpus_partitions(spark, monkeypatch):
    monkeypatch.setattr(knn, "SCANS_PER_CORE", 1)
    corpus = spark.range(4000, numPartitions=400).select(F.col("id").alias("row_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    queries = corpus.filter("row_id < 3").withColumnRenamed("row_id", "query_id")
    out = knn._broadcast_top(queries.selectExpr("query_id", "cast(embedding as array<float>) e").toArrow(), corpus, 2, knn._id_fields(queries, corpus, "query_id", "row_id"))
    assert out.count() <= 3 * 2 * spark.sparkContext.defaultParallelism


def test_partial_rows_do_not_grow_with_the_slices(spark):
    """More slices than cores share tasks: the queries are sent to each task once."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4)) for i in range(500)] + [(500 + i, [1, 0, 0, 0]) for i in range(20)]
    qs = [(i, rng.normal(size=4)) for i in range(30)] + [(50, [1, 0, 0, 0])]
    corpus, queries = tables(spark, rows, qs)
    assert found(knn.nearest(queries, corpus, 4, broadcast_bytes=8, slice_bytes=64)) == brute(qs, rows, 4)
    out = knn._id_fields(queries, corpus, "query_id", "row_id")
    sliced = knn._sliced_top(queries.withColumnRenamed("embedding", "_q"), corpus.withColumnRenamed("embedding", "_c"), 4, 2, 64, out)
    assert sliced.count() <= len(qs) * 2 * spark.sparkContext.defaultParallelism


def test_a_scan_holds_little_beside_its_best_rows():
    """What a task holds grows by k rows a query, not by all that the first block proposes."""
    class Corpus:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v), defaultParallelism=1))
        coalesce = lambda self, n: self
        mapInArrow = lambda self, scan, schema: scan

    rng = np.random.default_rng(3)
    n, k, width = 60_000, 10, 8
    queries = pa.table({"query_id": np.arange(n), "q": pa.array(list(rng.normal(size=(n, width)).astype(np.float32)))})
    blocks = [pa.record_batch([np.arange(300) + 300 * i, pa.array(list(rng.normal(size=(300, width)).astype(np.float32)))], names=["row_id", "c"]) for i in range(3)]
    scan = knn._broadcast_top(queries, Corpus(), k, StructType([StructField(c, LongType()) for c in ("query_id", "row_id")] + [StructField("distance", DoubleType())]))
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in scan(iter(blocks)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n * k
    assert peak < n * k * 16 + (40 << 20)


def test_null_vector_is_reported(spark):
    corpus, _ = tables(spark, [(0, [1.0, 0.0])], [(0, [1.0, 0.0])])
    queries = spark.createDataFrame([(0, None), (1, [1.0, 0.0])], "query_id LONG, embedding ARRAY<FLOAT>").coalesce(1)
    with pytest.raises(Exception, match="null vector"):
        knn.nearest(queries, corpus, 1).collect()


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 1 << 12}, {"broadcast_bytes": 256}, {"broadcast_bytes": 16 * 40 * 8}])
def test_vectors_of_few_values(spark, options, monkeypatch):
    """Queries without their zeros, in one pass, in several, past slices, or past a broadcast corpus; the corpus with and without zeros."""
    rng = np.random.default_rng(4)
    sliced = []
    real = knn._sliced_top
    monkeypatch.setattr(knn, "_sliced_top", lambda *args: sliced.append(1) or real(*args))
    few = [rng.normal(size=40) * (rng.random(40) < 0.1) for _ in range(160)]
    rows = [(i, v) for i, v in enumerate(few)] + [(160 + i, few[3]) for i in range(30)] + [(190, np.zeros(40))]
    qs = [(i, few[i] + (np.arange(40) == 5)) for i in range(100)] + [(200, np.zeros(40))]
    corpus, queries = tables(spark, rows, qs)
    want = brute(qs, rows, 6)
    slim = corpus.select("row_id", sparse("embedding").alias("embedding"))
    assert found(knn.nearest(queries, corpus, 6, **options)) == found(knn.nearest(queries, slim, 6, **options)) == want
    assert len(sliced) == (2 if options.get("broadcast_bytes") == 256 else 0)


def test_many_queries_of_few_values_are_not_sent_to_slices(spark):
    """What is shuffled before the scan grew with queries times slices; now neither side is."""
    rows = [(i, np.eye(32)[i % 32] * (i + 1)) for i in range(200)]
    corpus, queries = tables(spark, rows, [(i, np.eye(32)[i % 32]) for i in range(150)])
    got = knn.nearest(materialize(queries), materialize(corpus), 3, broadcast_bytes=1 << 12, slice_bytes=1 << 10)
    plan = got.select("query_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[-1]
    assert got.count() == 150 * 3


def test_null_terms_are_reported(spark):
    corpus = spark.createDataFrame([(0, [(0, 1.0)]), (1, None)], "row_id LONG, embedding ARRAY<STRUCT<term: INT, weight: FLOAT>>")
    _, queries = tables(spark, [(0, [1.0, 0.0])], [(0, [1.0, 0.0])])
    with pytest.raises(Exception, match="null vector"):
        knn.nearest(queries, corpus, 1).collect()
