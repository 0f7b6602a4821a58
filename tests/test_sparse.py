import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dietlens.operators import cluster, encode, knn
from dietlens.operators.sparse import Postings, nearest_sparse, sparse
from dietlens.session import materialize, release


def vectors(spark, rows, name):
    table = spark.createDataFrame([(k, list(map(float, v))) for k, v in rows], f"{name} string, embedding array<float>")
    return materialize(table.withColumn("terms", sparse("embedding")))


def drawn(rng, n, width, prefix):
    out = []
    for k in range(n):
        v = np.zeros(width)
        for _ in range(rng.randrange(0, 4)):
            v[rng.randrange(width)] = rng.choice([0.5, 1, 1, 2, 3.7])
        out.append((f"{prefix}{rng.randrange(10**6)}-{k}", v))
    return out


@pytest.mark.parametrize("slice_rows", [1 << 18, 40])
def test_equals_the_full_scan(spark, slice_rows):
    rng = random.Random(3)
    corpus = vectors(spark, drawn(rng, 700, 30, "c"), "row_id")
    queries = vectors(spark, drawn(rng, 300, 30, "q"), "query_id")
    got = nearest_sparse(queries, corpus, 30, slice_rows=slice_rows).select("query_id", "row_id", F.round("distance", 11).alias("d"))
    want = knn.nearest(queries, corpus, 1).select("query_id", "row_id", F.round("distance", 11).alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_equal_vectors_and_unknown_terms(spark):
    corpus = vectors(spark, [("b", [1, 0, 0]), ("a", [2, 0, 0]), ("c", [0, 1, 0]), ("d", [0, 0, 0])], "row_id")
    queries = vectors(spark, [("x", [5, 0, 0]), ("y", [0, 0, 1]), ("z", [0, 0, 0]), ("w", [0, 0.5, 0.5])], "query_id")
    got = {r.query_id: (r.row_id, round(r.distance, 6)) for r in nearest_sparse(queries, corpus, 3).collect()}
    assert got == {"x": ("a", 0.0), "y": ("a", 1.0), "z": ("a", 1.0), "w": ("c", round(1 - 0.5**0.5, 6))}
    assert nearest_sparse(queries, corpus.filter("false"), 3).isEmpty() and nearest_sparse(queries.filter("false"), corpus, 3).isEmpty()


def test_bounds_leave_most_blocks_unread():
    rng = np.random.default_rng(1)
    n = 20_000
    terms = np.sort(rng.integers(0, 50, (n, 3)), axis=1)
    terms[:, 1] += 50
    terms[:, 2] += 100
    weights = rng.uniform(0.1, 1, (n, 3))
    index = Postings(np.arange(0, 3 * n + 1, 3), terms.ravel(), weights.ravel())
    for k in range(0, 50):
        distance, row = index.nearest(terms[k], weights[k], 150)
        assert distance == 0 and row == k
    assert index.read < 0.2 * 50 * n * 3 / 50


def test_negative_weights_are_refused():
    with pytest.raises(ValueError, match="negative"):
        Postings(np.array([0, 1]), np.array([0]), np.array([-1.0]))


def texts(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["tea", "milk", "all", "Figs", "über", "x1"], k=rng.randrange(1, 7)))) for k in range(1500)]
    table = materialize(spark.createDataFrame([*rows, (1500, None), (1501, "")], "row_id long, text string").coalesce(1))
    return table, encode.hashed_encoder(encode.fit_hashed(table, "text", 96))


def test_terms_of_the_encoder_are_the_values_of_its_vectors(spark):
    """More rows than are weighed at once, a null and an empty text."""
    table, encoder = texts(spark)
    dense = encoder(table, "text", "embedding").select("row_id", sparse("embedding").alias("terms"))
    want = {r.row_id: [tuple(t) for t in r.terms] for r in dense.collect()}
    got = {r.row_id: [tuple(t) for t in r.terms] for r in encoder.terms(table, "text", "terms").collect()}
    assert got == want and got[1500] == got[1501] == [] and len(got) == 1502


def test_features_of_few_values_are_sparse(spark):
    table, encoder = texts(spark)
    vectors = materialize(encode.add_features(encoder(table, "text", "embedding")))
    row = vectors.filter("row_id = 0").first()
    assert row.features.toArray().tolist() == [float(x) for x in row.embedding] and len(row.features.values) < 7
    found = [cluster.add_kmeans(vectors, cluster.fit_kmeans(vectors, 3, vector=v), v) for v in ("embedding", "features")]
    one, other = ({r.row_id: r.cluster_kmeans for r in f.select("row_id", "cluster_kmeans").collect()} for f in found)
    assert one == other


def test_words_are_hashed_once(spark):
    """Places stand for texts, in the weights, the terms and the vectors; they are what SQL's MD5 gives."""
    table, encoder = texts(spark)
    table = table.withColumn("text", F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("ÀÉ-ß_İx ٣ "), "text")).otherwise(F.col("text")))
    placed = materialize(table.withColumn("places", encode.places("text", 96)))
    words = F.expr(r"regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}]+)', 1)")
    by_sql = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 96).cast("int"))
    assert placed.filter(~by_sql.eqNullSafe(F.col("places"))).count() == 0
    assert encode.fit_hashed(placed, "places", 96) == encode.fit_hashed(table, "text", 96)
    for column in ("embedding", "terms"):
        make = encoder if column == "embedding" else encoder.terms
        one = {r.row_id: r[column] for r in make(table, "text", column).collect()}
        other = {r.row_id: r[column] for r in make(placed, "places", column).collect()}
        assert one == other and len(one) == 1502


def test_features_of_terms(spark):
    table, encoder = texts(spark)
    dense = encode.add_features(encoder(table, "text", "embedding")).select("row_id", "features")
    slim = encoder.terms(table, "text", "terms").withColumn("features", encode.sparse_features("terms", 96)).select("row_id", "features")
    one, other = ({r.row_id: r.features.toArray().tolist() for r in f.collect()} for f in (dense, materialize(slim)))
    assert one == other and len(one) == 1502
    full = encoder.terms(table, "text", "terms").select("row_id", encode.full_vector("terms", 96).alias("embedding"))
    want = {r.row_id: r.embedding for r in encoder(table, "text", "embedding").collect()}
    assert {r.row_id: r.embedding for r in full.collect()} == want


def test_released_tables_are_gone(spark):
    kept, written = materialize(spark.range(3)), materialize(spark.range(4))
    release(written.join(spark.range(2), "id"))
    assert kept.count() == 3
    with pytest.raises(Exception):
        materialize(written)
