import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dietlens.operators import cluster as C
from dietlens.operators import models as ML
from dietlens.plans import catalogue
from dietlens.session import new_path


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    blobs = [(0.0, 0.0, 40), (10.0, 10.0, 40), (20.0, 0.0, 10)]
    points = [(x, y, f"b{i}") for i, (cx, cy, n) in enumerate(blobs) for x, y in rng.normal((cx, cy), 0.2, (n, 2)).tolist()]
    points += [(50.0 + 9 * i, -40.0, "stray") for i in range(6)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i LONG, x DOUBLE, y DOUBLE, b STRING").repartition(4)
    got = C.add_density_clusters(df, "x", "y", eps=1.5, min_points=4).collect()
    labels = {b: Counter(r.cluster_hdbscan for r in got if r.b == b) for b in ("b0", "b1", "b2", "stray")}
    assert labels == {"b0": {0: 40}, "b1": {1: 40}, "b2": {-1: 10}, "stray": {-1: 6}}
    assert {r.cluster_hdbscan for r in C.without_density_clusters(df).collect()} == {-1}


def test_density_clusters_follow_a_long_winding_band(spark):
    # 60 touching squares in a row, then a gap, then 20 more; one square holds a third of the points.
    points = [(k + 0.5, 0.5) for k in range(60) for _ in range(3)] + [(k + 0.5, 0.5) for k in range(63, 83) for _ in range(3)]
    points += [(5.5, 0.5)] * 120 + [(60.5, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i LONG, x DOUBLE, y DOUBLE")
    got = C.add_density_clusters(df, "x", "y", eps=2 ** 0.5, min_points=3).collect()
    sizes = Counter(r.cluster_hdbscan for r in got)
    assert sizes == {0: 301, 1: 60}


def plain_density(points, eps, min_points, min_size):
    """Labels by all distances; a float label per point."""
    xy = np.array(points, dtype=float)
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    near = d <= eps * eps
    core = near.sum(axis=1) >= min_points
    parent = list(range(len(xy)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in zip(*np.nonzero(near & core[:, None] & core[None, :])):
        parent[find(i)] = find(j)
    owner = [None] * len(xy)
    for i in range(len(xy)):
        if core[i]:
            owner[i] = find(i)
        else:
            to = [j for j in np.flatnonzero(near[i]) if core[j]]
            if to:
                owner[i] = find(min(to, key=lambda j: (d[i, j], *xy[j])))
    sizes = Counter(o for o in owner if o is not None)
    first = {}
    for i in np.flatnonzero(core):
        first[find(i)] = min(first.get(find(i), (np.inf,)), tuple(xy[i]))
    order = {r: k for k, r in enumerate(sorted((r for r in sizes if sizes[r] >= min_size), key=first.get))}
    return [order.get(o, -1) for o in owner]


@pytest.mark.parametrize(("seed", "eps", "min_points"), [(1, 0.3, 4), (2, 0.11, 3), (3, 0.6, 12)])
def test_density_equals_plain_distances(spark, seed, eps, min_points):
    rng = np.random.default_rng(seed)
    points = [*rng.uniform(0, 4, (250, 2)).tolist(), *rng.normal((2, 2), 0.15, (120, 2)).tolist(), *rng.normal((9, 2), 0.02, (60, 2)).tolist()]
    points += [points[300]] * 5 + [[k * eps * 0.5 + 20, 1.0] for k in range(30)] + [[k * eps * 0.5 + 20, 1.0 + eps] for k in range(12)]
    for shift in (0.0, 0.377 * eps):
        moved = [(x + shift, y - shift) for x, y in points]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(moved)], "i LONG, x DOUBLE, y DOUBLE").repartition(3)
        got = {r.i: r.cluster_hdbscan for r in C.add_density_clusters(df, "x", "y", eps, min_points, 6).collect()}
        assert [got[i] for i in range(len(points))] == plain_density(moved, eps, min_points, 6)
        if shift:
            assert got == before
        before = got


def test_density_without_a_place(spark):
    rows = [(1, None, 1.0), (2, 1.0, None), (3, float("nan"), 1.0), *[(k, 1.0, 1.0) for k in range(4, 9)]]
    df = spark.createDataFrame(rows, "i LONG, x DOUBLE, y DOUBLE")
    got = {r.i: r.cluster_hdbscan for r in C.add_density_clusters(df, "x", "y", 0.5, 3, 3).collect()}
    assert got == {1: -1, 2: -1, 3: -1, **{k: 0 for k in range(4, 9)}}
    assert C.add_density_clusters(df.filter("false"), "x", "y", 0.5, 3, 3).isEmpty()



def test_connected_components(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(300), rng.randrange(300)) for _ in range(200)}
    parent = list(range(300))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    both = [(a, b) for a, b in edges] + [(b, a) for a, b in edges]
    got = C.connected_components(spark.range(300).toDF("node"), spark.createDataFrame(both, "src LONG, dst LONG"))
    assert {r.node: r.root for r in got.collect()} == {n: find(n) for n in range(300)}


def test_plot_bins_and_summary(spark):
    df = spark.createDataFrame([(0.1, 0.2, "b", 1), (0.4, 0.1, "b", 1), (-0.1, 0.2, "a", 2), (0.3, 0.3, None, 2)], "x DOUBLE, y DOUBLE, l STRING, c INT")
    got = {(r.x_bin, r.y_bin, r.l, r.code, r.n) for r in C.plot_bins(df, "x", "y", "l", 0.5, []).collect()}
    assert got == {(0, 0, "b", 1, 2), (-1, 0, "a", 0, 1), (0, 0, None, -1, 1)}
    assert [tuple(r) for r in C.cluster_sizes(df, "c").collect()] == [(1, 2), (2, 2)]
    summary = C.clustering_summary(df, ["c"], kmeans_n_clusters=2)
    assert {tuple(r) for r in summary.collect()} == {("c", "1", 2, 2), ("c", "2", 2, 2)}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    names = ["info", "minor", "severe"]
    rows = []
    for i in range(180):
        center = np.eye(4)[i % 3] * 4
        rows.append((i, names[i % 3], (center + rng.normal(0, 0.3, 4)).tolist()))
    return spark.createDataFrame(rows, "row_id LONG, severity STRING, embedding ARRAY<FLOAT>")


def test_kmeans_and_projection(blobs):
    clustered = C.add_kmeans(blobs, C.fit_kmeans(blobs, 3))
    pairs = clustered.groupBy("severity", "cluster_kmeans").count().collect()
    assert len(pairs) == 3 and all(r["count"] == 60 for r in pairs)
    flat = C.add_projection(clustered, C.fit_projection(blobs))
    spread = flat.agg(F.variance("proj_x"), F.variance("proj_y")).first()
    assert spread[0] >= spread[1] > 1


def test_train_compare_select_save(spark, blobs):
    prepared = ML.prepare_training(blobs)
    assert prepared.filter("is_test").count() == 36
    estimators = {"logreg": ML.logistic(50), "random_forest": ML.forest(10), "mlp": ML.network(4, 3, (8,), 50)}
    fitted, counts, metrics = ML.train_and_compare(prepared, estimators)
    scores = {r.model: r for r in metrics.collect()}
    assert set(scores) == set(estimators) and all(r.macro_f1 > 0.95 for r in scores.values())
    assert counts.agg(F.sum("n")).first()[0] == 3 * 36
    name, model = ML.select_best(fitted, metrics)
    path = new_path(spark, "model")
    ML.save_model(model, path)
    queries = blobs.select(F.col("row_id").alias("query_id"), "embedding")
    got = ML.classify(ML.load_model(path), queries).join(blobs.withColumnRenamed("row_id", "query_id"), "query_id").collect()
    assert sum(r.classifier_pred == r.severity for r in got) > 170
    for r in got:
        assert set(r.classifier_probs) == {"info", "minor", "severe"}
        assert sum(r.classifier_probs.values()) == pytest.approx(1)
        assert r.classifier_probs[r.classifier_pred] == max(r.classifier_probs.values())


def test_boosted(blobs):
    prepared = ML.prepare_training(blobs)
    fitted, _, metrics = ML.train_and_compare(prepared, {"boosted": ML.boosted(2)})
    assert metrics.first().macro_f1 > 0.9
    queries = blobs.select(F.col("row_id").alias("query_id"), "embedding")
    assert ML.classify(fitted["boosted"], queries).filter(F.col("classifier_probs").isNotNull()).count() == 0


def test_nothing_trained(blobs):
    with pytest.raises(ValueError):
        ML.train_and_compare(ML.prepare_training(blobs), {})


def test_registered_queries_encode_at_full_width(spark, sf_dir):
    assert {r.dim for r in catalogue.encode_text(spark, sf_dir).select("dim").distinct().collect()} == {768}
    built = catalogue.corpus(spark, sf_dir)
    assert {r.dim for r in built.vectors.select(F.size("embedding").alias("dim")).distinct().collect()} == {768}
    assert catalogue.retrieve(spark, sf_dir).select("query_id").distinct().count() == catalogue._asked(spark, sf_dir).count()
