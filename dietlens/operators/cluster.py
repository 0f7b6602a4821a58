"""K-means, 2-D projection, density clusters, and the counts behind the plots."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dietlens.constants import SEED
from dietlens.functions.vectors import dot
from dietlens.operators.encode import features
from dietlens.operators.keys import add_category_code, add_row_id
from dietlens.session import BROADCAST_ROWS, materialize, small_or_none

NOISE = -1


def _as_features(df: DataFrame, vector: str):
    """The MLlib vector of a column that holds one, or an array."""
    return F.col(vector) if isinstance(df.schema[vector].dataType, VectorUDT) else features(vector)


def fit_kmeans(df: DataFrame, k: int = 10, seed: int = SEED, vector: str = "embedding") -> KMeansModel:
    """`vector` is an array column or one of MLlib vectors."""
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster_kmeans")
    return model.fit(df.select(_as_features(df, vector).alias("_features")))


def add_kmeans(df: DataFrame, model: KMeansModel, vector: str = "embedding") -> DataFrame:
    """Adds `cluster_kmeans`, from the full vectors. The ids are arbitrary."""
    return model.transform(df.withColumn("_features", _as_features(df, vector))).drop("_features")


def fit_projection(df: DataFrame, vector: str = "embedding") -> PCAModel:
    return PCA(k=2, inputCol="_features", outputCol="_plane").fit(df.select(features(vector).alias("_features")))


def add_projection(df: DataFrame, model: PCAModel, vector: str = "embedding") -> DataFrame:
    """Adds `proj_x`, `proj_y`: the first two principal components. Their signs are arbitrary."""
    plane = vector_to_array("_plane")
    return (
        model.transform(df.withColumn("_features", features(vector)))
        .withColumn("proj_x", plane[0]).withColumn("proj_y", plane[1])
        .drop("_features", "_plane")
    )


def add_plane(df: DataFrame, axes: tuple[Sequence[float], Sequence[float]], vector: str = "embedding") -> DataFrame:
    """Adds `proj_x`, `proj_y`: the coordinates of each vector along two given axes."""
    along = [dot(vector, F.lit([float(a) for a in axis])) for axis in axes]
    return df.withColumns({"proj_x": along[0], "proj_y": along[1]})


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n")).orderBy("cluster")


def clustering_summary(df: DataFrame, clusters: list[str], **facts) -> DataFrame:
    """(name, id, size and the facts): one row per cluster of each cluster column, with the parameters given."""
    counts = [
        df.groupBy(F.col(name).cast("string").alias("id")).agg(F.count("*").alias("size")).select(F.lit(name).alias("name"), "id", "size")
        for name in clusters
    ]
    return reduce(DataFrame.unionByName, counts).withColumns({name: F.lit(value) for name, value in facts.items()})


def plot_bins(df: DataFrame, x: str, y: str, label: str, width: float, row_key: list[str]) -> DataFrame:
    """(x_bin, y_bin, label, code, n): a scatter plot coloured by label, as counts per square."""
    counts = df.groupBy(
        F.floor(F.col(x) / width).alias("x_bin"), F.floor(F.col(y) / width).alias("y_bin"), F.col(label)
    ).agg(F.count("*").alias("n"))
    return add_category_code(counts, label, ["x_bin", "y_bin"])


def _cells(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / side)).withColumn("_cy", F.floor(F.col(y) / side))


def _moved(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every row once per offset, with the cell so far in (_ox, _oy) and the one at the offset in (_cx, _cy)."""
    steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in offsets])
    return (
        cells.withColumn("_s", F.explode(steps)).withColumnsRenamed({"_cx": "_ox", "_cy": "_oy"})
        .withColumn("_cx", F.col("_ox") + F.col("_s.dx")).withColumn("_cy", F.col("_oy") + F.col("_s.dy")).drop("_s")
    )


def connected_components(nodes: DataFrame, edges: DataFrame, salts: int = 16) -> DataFrame:
    """(node, root): the smallest node of each component.

    `nodes` has `node`; `edges` has (src, dst) in both directions with few edges per node. Each
    round takes the smallest root among a node's neighbours and then the root's own root, which
    halves the remaining way, and writes the result so that no plan grows with the rounds. Many
    nodes share a root, so that second join is salted.
    """
    roots = materialize(nodes.select("node", F.col("node").alias("root")), "components")
    edges = materialize(edges.select("src", "dst"), "edges")
    while True:
        heard = (
            edges.join(roots, edges.dst == roots.node).groupBy("src").agg(F.min("root").alias("_heard"))
            .withColumnRenamed("src", "node")
        )
        nearer = roots.join(heard, "node", "left").select(
            "node", F.col("root").alias("_old"), F.least("root", "_heard").alias("_root"),
            F.pmod(F.xxhash64("node"), F.lit(salts)).alias("_salt"),
        )
        jump = nearer.select(F.col("node").alias("_root"), F.col("_root").alias("_next")).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
        )
        moved = nearer.join(jump, ["_root", "_salt"]).select("node", "_old", F.col("_next").alias("root"))
        stored = materialize(moved, "components")
        changed = stored.filter(F.col("root") != F.col("_old")).limit(1).count()
        roots = stored.select("node", "root")
        if not changed:
            return roots


# Squares that hold points within a diagonal of a square's points: a corner two steps off both ways is too far.
_NEAR = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) < 4]
# Cuts of a square's side per round of `_links`, and the round from which on single points are compared.
_CUTS, _ROUNDS = 4, 6


def _within(points: DataFrame, asked: DataFrame, eps: float) -> DataFrame:
    """Points (x, y and all columns) beside each asked point (px, py) within `eps`, with `d`, the squared distance.

    `asked` has few points per square (_cx, _cy), so the points of a square meet one short list, however many they are.
    """
    lists = _moved(asked, _NEAR).groupBy("_cx", "_cy").agg(F.collect_list(F.struct("px", "py")).alias("_asked"))
    met = _lookup_cells(points, materialize(lists, "asked-points"), how="inner").withColumn("_p", F.explode("_asked")).drop("_asked")
    dx, dy = F.col("x") - F.col("_p.px"), F.col("y") - F.col("_p.py")
    return met.select("*", "_p.px", "_p.py", (dx * dx + dy * dy).alias("d")).drop("_p").filter(F.col("d") <= eps * eps)


def _boxes(core: DataFrame, keys: list[str]) -> DataFrame:
    return core.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _compared(pairs: DataFrame, eps: float) -> DataFrame:
    """`pairs` of boxes a, b that may hold points within `eps`, with `sure`: all of their points are."""
    def apart(low: str, high: str):
        return F.greatest(F.lit(0.0), F.col(f"a.{low}") - F.col(f"b.{high}"), F.col(f"b.{low}") - F.col(f"a.{high}"))

    def across(low: str, high: str):
        return F.greatest(F.col(f"a.{high}") - F.col(f"b.{low}"), F.col(f"b.{high}") - F.col(f"a.{low}"))

    least = apart("x0", "x1") * apart("x0", "x1") + apart("y0", "y1") * apart("y0", "y1")
    most = across("x0", "x1") * across("x0", "x1") + across("y0", "y1") * across("y0", "y1")
    return pairs.filter(least <= eps * eps).withColumn("sure", most <= eps * eps)


def _links(core: DataFrame, side: float, eps: float) -> DataFrame:
    """(src, dst), both ways: squares of which a core point each lie within `eps`.

    Boxes around the points of two squares say yes, no or perhaps. Where they say perhaps the squares are cut into parts with
    boxes of their own, round after round, until the boxes are single points. Points are never paired within a square.
    """
    cell, box = ["_cx", "_cy"], ["x0", "x1", "y0", "y1"]
    boxes = materialize(_boxes(core, cell), "boxes")
    half = [(dx, dy) for dx, dy in _NEAR if (dx, dy) > (0, 0)]
    others = boxes.select(*cell, F.struct(*box).alias("b"))
    pairs = _moved(boxes.select(*cell, F.struct(*box).alias("a")), half).join(others, cell)
    found = _compared(pairs.withColumnsRenamed({"_cx": "_dx", "_cy": "_dy"}), eps)
    ends = ["_ox", "_oy", "_dx", "_dy"]
    zero = [F.lit(0).cast("long").alias(c) for c in ("ax", "ay", "bx", "by")]
    found = materialize(found.select(*ends, *zero, "sure"), "pairs")
    sure = found.filter("sure").select(*ends)
    open_pairs = found.filter("NOT sure")
    for level in range(1, _ROUNDS + 1):
        if open_pairs.isEmpty():
            break

        def part(axis: str, origin: str, at: int):
            return F.floor((F.col(axis) / side - F.col(origin)) * F.lit(float(_CUTS**at))).cast("long")

        above = [part("x", "_cx", level - 1).alias("ux"), part("y", "_cy", level - 1).alias("uy")]
        own = ["x", "y"] if level == _ROUNDS else [part("x", "_cx", level).alias("sx"), part("y", "_cy", level).alias("sy")]
        parts = _boxes(core.select("*", *above, *([] if level == _ROUNDS else own)), [*cell, "ux", "uy", *(own if level == _ROUNDS else ["sx", "sy"])])
        parts = parts if level < _ROUNDS else parts.select("*", F.lit(0).cast("long").alias("sx"), F.lit(0).cast("long").alias("sy"))
        parts = materialize(parts.select(*cell, "ux", "uy", "sx", "sy", F.struct(*box).alias("box")), "parts")
        left = parts.toDF("_ox", "_oy", "ax", "ay", "sax", "say", "a")
        right = parts.toDF("_dx", "_dy", "bx", "by", "sbx", "sby", "b")
        pairs = open_pairs.drop("sure").join(left, ["_ox", "_oy", "ax", "ay"]).join(right, ["_dx", "_dy", "bx", "by"])
        found = _compared(pairs, eps).select(*ends, *[F.col(f"s{c}").alias(c) for c in ("ax", "ay", "bx", "by")], "sure")
        found = materialize(found, "pairs")
        new = found.filter("sure").select(*ends).distinct()
        sure = sure.unionByName(new)
        open_pairs = found.filter("NOT sure").join(new, ends, "left_anti")
    one, two = F.struct(F.col("_ox").alias("_cx"), F.col("_oy").alias("_cy")), F.struct(F.col("_dx").alias("_cx"), F.col("_dy").alias("_cy"))
    sure = materialize(sure.distinct(), "links")
    return sure.select(one.alias("src"), two.alias("dst")).unionByName(sure.select(two.alias("src"), one.alias("dst")))


def add_density_clusters(
    df: DataFrame,
    x: str,
    y: str,
    eps: float,
    min_points: int,
    min_size: int = 30,
    cluster: str = "cluster_hdbscan",
) -> DataFrame:
    """Adds density clusters of the plane, numbered from 0 by their smallest core point, and -1 for noise.

    A point with `min_points` points within `eps`, itself included, is core. Core points within `eps` of each other are of one
    cluster, and any other point within `eps` of a core point is of the nearest one's (the smallest by x, y among equals).
    Clusters of fewer than `min_size` points become noise; so do points without a place.

    The plane is cut into squares with diagonal `eps`. All points of a square that holds `min_points` are core at once. Only those of
    emptier squares are compared, with what is around them; squares are linked by boxes around their core points (`_links`).
    """
    side = eps / math.sqrt(2.0)
    celled = _cells(df, x, y, side)
    placed = celled.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "_cx", "_cy")
    placed = placed.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    points = materialize(placed.groupBy("x", "y", "_cx", "_cy").agg(F.count("*").alias("_n")), "points")
    cells = points.groupBy("_cx", "_cy").agg((F.sum("_n") >= min_points).alias("_full"))
    points = materialize(_lookup_cells(points, materialize(cells, "cells")), "points")
    few = points.filter("NOT _full")
    asked = few.select("_cx", "_cy", F.col("x").alias("px"), F.col("y").alias("py"))
    counted = _within(points, asked, eps).groupBy("px", "py").agg(F.sum("_n").alias("_near")).filter(F.col("_near") >= min_points)
    crowded = materialize(counted.select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(True).alias("_core")), "crowded")
    few = materialize(few.join(crowded, ["x", "y"], "left").withColumn("_core", F.coalesce("_core", F.lit(False))), "few")

    kept = ["x", "y", "_cx", "_cy", "_n"]
    core = materialize(points.filter("_full").select(*kept).unionByName(few.filter("_core").select(*kept)), "core")
    node = F.struct("_cx", "_cy").alias("node")
    nodes = core.select(node).distinct()
    roots = materialize(connected_components(nodes, _links(core, side, eps)).select("node._cx", "node._cy", "root"), "roots")
    border = _within(core.select("x", "y", "_cx", "_cy"), few.filter("NOT _core").select("_cx", "_cy", F.col("x").alias("px"), F.col("y").alias("py")), eps)
    border = border.groupBy("px", "py").agg(F.min(F.struct("d", "x", "y", "_cx", "_cy")).alias("_to")).select("px", "py", "_to._cx", "_to._cy")
    border = materialize(border.join(roots, ["_cx", "_cy"]).select(F.col("px").alias("x"), F.col("py").alias("y"), "root"), "border")

    of_cells = core.groupBy("_cx", "_cy").agg(F.sum("_n").alias("_size"), F.min(F.struct("x", "y")).alias("_first")).join(roots, ["_cx", "_cy"])
    joined = few.join(border, ["x", "y"]).groupBy("root").agg(F.sum("_n").alias("_size"))
    sizes = of_cells.groupBy("root").agg(F.sum("_size").alias("_size"), F.min("_first").alias("_first"))
    sizes = sizes.unionByName(joined.withColumn("_first", F.lit(None).cast(sizes.schema["_first"].dataType)))
    sizes = sizes.groupBy("root").agg(F.sum("_size").alias("_size"), F.min("_first").alias("_first")).filter(F.col("_size") >= min_size)
    numbered = add_row_id(sizes.select("root", "_first.x", "_first.y"), ["x", "y"], cluster).select("root", F.col(cluster).cast("int").alias(cluster))
    numbered = materialize(numbered, "numbered")

    # Core points go by their square, the others by their place, of which no square has many.
    by_cell = roots.join(numbered, "root").select("_cx", "_cy", F.col(cluster).alias("_by_cell"))
    alone = few.filter("NOT _core").select("x", "y").join(border, ["x", "y"], "left").join(numbered, "root", "left")
    alone = alone.select(F.col("x").alias("_cx"), F.col("y").alias("_cy"), F.lit(True).alias("_alone"), F.col(cluster).alias("_by_place"))
    found = _lookup_cells(celled, materialize(by_cell, "by-cell"))
    found = found.withColumnsRenamed({"_cx": "_kx", "_cy": "_ky"}).withColumns({"_cx": F.col(x).cast("double"), "_cy": F.col(y).cast("double")})
    found = _lookup_cells(found, materialize(alone, "alone"))
    label = F.when(F.col("_alone"), F.col("_by_place")).otherwise(F.col("_by_cell"))
    return found.withColumn(cluster, F.coalesce(label, F.lit(NOISE))).drop("_cx", "_cy", "_kx", "_ky", "_by_cell", "_by_place", "_alone")


def _lookup_cells(points: DataFrame, cells: DataFrame, how: str = "left", salts: int = 32) -> DataFrame:
    """Join points to their square: broadcast if there are few squares, else spread hot squares by salt."""
    small = small_or_none(cells, BROADCAST_ROWS)
    if small is not None:
        return points.join(F.broadcast(small), ["_cx", "_cy"], how)
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    spread = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, ["_cx", "_cy", "_salt"], how).drop("_salt")


def without_density_clusters(df: DataFrame, cluster: str = "cluster_hdbscan") -> DataFrame:
    """The same column when density clustering is off."""
    return df.withColumn(cluster, F.lit(NOISE))
