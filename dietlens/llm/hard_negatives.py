"""Hard-negative mining with LEMP-style coordinate pruning.

Vectors are dealt into slices by a hash of the row. A task sorts a slice into buckets of one label and similar length, and for each
bucket every coordinate of the unit vectors into a list. An anchor needs, at the lowest score of interest and the bucket's greatest
length, some least cosine; then each coordinate of a vector lies within an angle around the anchor's own. The value ranges of the
anchor's heaviest coordinates are cut out of the sorted lists, the candidate sets intersected, and what is left is verified by
exact integer inner products. Buckets whose length cannot reach the score are left out whole.

Anchors meet each slice once: all anchors are sent to every slice behind its vectors, and leave it with their best rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dietlens.llm.common import identified
from dietlens.session import materialize

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's lies between.
LOW, HIGH = 50, 95
SCALE = 256
SLICE_ROWS = 1 << 16
BUCKET_ROWS = 4096
FOCUS = 6
#: A list that keeps more of a bucket than this does not pay.
PRUNES = 0.5
_FAR = 1 << 62


def prepared(vectors: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(at, place, id, label, vec, anchor) of the rows that take part, components scaled to integers; written."""
    df, row = identified(vectors)
    names = [F.col(row[0]).alias("at"), F.col(row[1]).alias("place"), F.col(f"`{id_col}`").cast("long").alias("id")]
    slim = df.select(*names, label.cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    taking = slim.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    return materialize(taking.withColumn("vec", F.transform("vec", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))), "vectors")


@dataclass
class Rows:
    """Rows of a slice or bucket. `vec` is exact in doubles or else of 64-bit integers."""

    at: np.ndarray
    place: np.ndarray
    none: np.ndarray  # whether the id is null
    id: np.ndarray
    vec: np.ndarray

    def take(self, chosen: np.ndarray) -> Rows:
        return Rows(self.at[chosen], self.place[chosen], self.none[chosen], self.id[chosen], self.vec[chosen])


class Bucket:
    """Rows of one label and similar length, with the sorted list of each coordinate of their unit vectors."""

    def __init__(self, rows: Rows, lengths: np.ndarray):
        self.rows = rows
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        self.unit = np.divide(rows.vec, lengths[:, None], out=np.zeros(rows.vec.shape), where=lengths[:, None] > 0)
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0).T.copy()

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows that may score `least` or more with the anchor; None for all, an empty array for none."""
        if not length or not self.shortest:
            return None if least <= 0 else np.arange(len(self.unit)) if length and self.longest else np.empty(0, np.int64)
        cosine = least / (length * (self.longest if least > 0 else self.shortest))
        if cosine > 1 + 1e-9:
            return np.empty(0, np.int64)
        if cosine <= -1:
            return None
        unit = anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(unit[focus], -1, 1))
        angle = np.arccos(min(cosine, 1.0)) + 1e-7
        low, high = np.cos(np.minimum(own + angle, np.pi)) - 1e-9, np.cos(np.maximum(own - angle, 0.0)) + 1e-9
        ranges = [(np.searchsorted(self.lists[f], a, "left"), np.searchsorted(self.lists[f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
        sizes = [b - a for a, b in ranges]
        first = int(np.argmin(sizes))
        if sizes[first] > PRUNES * len(self.unit):
            return None
        found = self.order[slice(*ranges[first]), focus[first]]
        for k, f in enumerate(focus):
            if k != first and sizes[k] <= PRUNES * len(self.unit):
                values = self.unit[found, f]
                found = found[(values >= low[k]) & (values <= high[k])]
        return found


def _buckets(rows: Rows, labels: np.ndarray) -> dict[int, list[Bucket]]:
    """The buckets of each label, the longest vectors first."""
    lengths = np.sqrt((rows.vec.astype(np.float64) ** 2).sum(axis=1))
    out: dict[int, list[Bucket]] = {}
    for label in np.unique(labels).tolist():
        chosen = np.flatnonzero(labels == label)
        chosen = chosen[np.argsort(-lengths[chosen], kind="stable")]
        parts = (chosen[at : at + BUCKET_ROWS] for at in range(0, len(chosen), BUCKET_ROWS))
        out[label] = [Bucket(rows.take(part), lengths[part]) for part in parts]
    return out


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The first k of (score, none, id, at, place): higher scores first, then smaller ids, null last."""
    score, none, name, at, place = found
    order = np.lexsort((place, at, name, none, -score))[:k]
    return tuple(v[order] for v in found)


_NOTHING = (np.empty(0, np.int64), np.empty(0, bool), *[np.empty(0, np.int64)] * 3)


def search(buckets: list[Bucket], anchor: np.ndarray, key: tuple[int, int], ranges: list[tuple[int, int]], k: int) -> list[tuple]:
    """The best k rows other than `key` for each range of scores."""
    best = [_NOTHING] * len(ranges)
    floors = [low for low, _ in ranges]
    length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
    for bucket in buckets:
        found = bucket.candidates(anchor, length, min(floors))
        rows = bucket.rows if found is None else bucket.rows.take(found)
        if not len(rows.at):
            continue
        scores = (rows.vec @ anchor).astype(np.int64)
        others = (rows.at != key[0]) | (rows.place != key[1])
        for j, (_, high) in enumerate(ranges):
            take = np.flatnonzero((scores >= floors[j]) & (scores <= high) & others)
            if not len(take):
                continue
            new = (scores[take], rows.none[take], rows.id[take], rows.at[take], rows.place[take])
            best[j] = _best(tuple(np.concatenate(pair) for pair in zip(best[j], new, strict=True)), k)
            if len(best[j][0]) == k:
                floors[j] = int(best[j][0][-1])
    return best


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` components, padded by zeros; doubles where inner products of these are exact, else integers."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(matrix: np.ndarray) -> np.ndarray:
    least_bound = np.abs(matrix).max(initial=0)
    return matrix.astype(np.float64) if float(least_bound) ** 2 * max(1, matrix.shape[1]) < 2.0**50 else matrix


def _meet(width: int, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, buckets = None, [], None

        def gathered() -> dict[int, list[Bucket]]:
            if not waiting:
                return {}
            at, place, none, name, label, vec = (np.concatenate(v) for v in zip(*waiting, strict=True))
            return _buckets(Rows(at, place, none, name, _exact(vec)), label)

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            parts = columns["part"].to_numpy()
            asks = columns["asks"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])]) if len(parts) else []
            out = []
            for start, end in zip(edges, [*edges[1:], len(parts)], strict=True):
                if parts[start] != part:
                    part, waiting, buckets = parts[start], [], None
                own = {n: c.slice(start, end - start) for n, c in columns.items()}
                at, place = own["at"].to_numpy(), own["place"].to_numpy()
                label, vec = own["label"].to_numpy(), _matrix(own["vec"], width)
                if not asks[start]:
                    name = own["id"].fill_null(0).to_numpy()
                    waiting.append((at, place, own["id"].is_null().to_numpy(zero_copy_only=False), name, label, vec))
                    continue
                if buckets is None:
                    buckets, waiting = gathered(), []
                exact = _exact(vec)
                for i, ranges in enumerate(own["ranges"].to_pylist()):
                    wanted = [b for lab, bs in buckets.items() if (lab == label[i]) == same for b in bs]
                    spans = [(r["low"], r["high"]) for r in ranges]
                    key = (int(at[i]), int(place[i]))
                    for j, rows in enumerate(search(wanted, exact[i], key, spans, k)):
                        out += [(*key, j, *row) for row in zip(*(v.tolist() for v in rows), strict=True)]
            yield _found(out)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    names = ["a_at", "a_place", "j", "score", "none", "id", "at", "place"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _nearest(rows: DataFrame, anchors: DataFrame, width: int, n_rows: int, k: int, same: bool) -> DataFrame:
    """(a_at, a_place, j, rank, score, id, at, place): the first k rows of the anchor's label, or of other labels, in its range j."""
    spark = rows.sparkSession
    slices = max(spark.sparkContext.defaultParallelism, -(-n_rows // SLICE_ROWS))
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("ranges")
    dealt = rows.select(F.pmod(F.xxhash64("at", "place"), F.lit(slices)).cast("int").alias("part"), F.lit(False).alias("asks"), "*", none)
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"), F.lit(True).alias("asks"), *rows.columns, "ranges")
    met = dealt.unionByName(asked).repartition(slices, "part").sortWithinPartitions("part", "asks")
    found = met.mapInArrow(
        _meet(width, k, same), "a_at long, a_place long, j int, score long, none boolean, id long, at long, place long"
    )
    order = Window.partitionBy("a_at", "a_place", "j").orderBy(F.desc("score"), "none", "id", "at", "place")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.withColumn("id", F.when(~F.col("none"), F.col("id"))).drop("none")


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest negatives of each anchor's positives.

    Components become floor(SCALE * x); scores are integer inner products, higher ones first, then smaller ids (null last). The
    positives of an anchor, a row for which `anchor` is true, are its first other rows of the same `label`; the negatives of a
    positive are the first rows of other labels with `low` * positive score <= 100 * score <= `high` * positive score. Rows with a
    null label or vector, or a null or non-finite component, take no part. Repeated rows are rows of their own. Shorter vectors
    count as padded by zeros. Ids must be integers; scores must fit 64 bits. An empty table gives an empty table. Other columns
    are not read, whatever their names.
    """
    rows = prepared(vectors, anchor, label, id_col, vector_col)
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    anchors, rows = rows.filter("anchor").drop("anchor"), rows.drop("anchor")
    every = F.array(F.struct(F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high")))
    found = _nearest(rows, anchors.withColumn("ranges", every), width or 0, n_rows, positives, True)
    found = materialize(found.filter("score >= 0"), "positives")
    # Of a negative score no percentage is above the lower one, so such positives have no negatives.
    bounds = F.struct(
        F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"),
        "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    asked = found.groupBy("a_at", "a_place").agg(F.array_sort(F.collect_list(bounds)).alias("found"))
    asked = asked.withColumnRenamed("a_at", "at").withColumnRenamed("a_place", "place")
    asked = materialize(anchors.join(asked, ["at", "place"]), "asked")
    ranges = F.transform("found", lambda f: F.struct(f["low"].alias("low"), f["high"].alias("high"))).alias("ranges")
    mined = _nearest(rows, asked.select(*rows.columns, ranges), width or 0, n_rows, negatives, False)
    own = asked.select(F.col("at").alias("a_at"), F.col("place").alias("a_place"), F.col("id").alias("anchor_id"), "found")
    positive = F.element_at("found", F.col("j") + 1)
    return mined.join(own, ["a_at", "a_place"]).select(
        "anchor_id", positive["positive_id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        positive["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
