"""Nearest sparse vector by an inverted index with bounds.

Equal vectors are one. The searched vectors are dealt into slices; a task turns a slice into postings, per term the vectors that hold
it in blocks of falling weight, and all asked vectors pass it. A unit vector whose weight at a term is w has at most the cosine
q * w + sqrt(1 - q^2) * sqrt(1 - w^2) with one whose weight there is q; over a block that is greatest where w is closest to q. Blocks
are read by falling bound until the best cosine found exceeds it; what is read is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from dietlens.session import lookup_join, materialize

SLICE_ROWS = 1 << 18
BLOCK = 64
_PLACES = 12
# Above the rounding of bounds and of distances.
_SLACK = 1e-9


class Postings:
    """Inverted index of unit vectors: `starts` and `terms`, `weights` of each, in one order of names."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        if (weights < 0).any():
            raise ValueError("a weight is negative")
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        norms = np.sqrt(np.bincount(rows, weights * weights, len(starts) - 1))
        self.starts, self.terms = starts, terms
        self.weights = np.divide(weights, norms[rows], out=np.zeros(len(weights)), where=norms[rows] > 0)
        order = np.lexsort((rows, -self.weights, terms))
        self.rows = rows[order]
        known, first = np.unique(terms[order], return_index=True)
        self.lists = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))
        self.sorted = self.weights[order]
        self.read = 0  # vectors compared so far

    def nearest(self, terms: np.ndarray, weights: np.ndarray, width: int) -> tuple[float, int]:
        """(distance, row) of the nearest vector, the first among equals; row 0 at distance 1 if none shares a term."""
        norm = np.sqrt((weights * weights).sum())
        asked = np.zeros(width)
        if norm > 0:
            asked[terms] = weights / norm
        best = (1.0, 0)
        blocks = []
        for term in terms.tolist():
            own = asked[term]
            begin, end = self.lists.get(term, (0, 0))
            at = np.arange(begin, end, BLOCK)
            if own > 0 and len(at):
                high, low = self.sorted[at], self.sorted[np.minimum(at + BLOCK, end) - 1]
                closest = np.clip(own, low, high)
                bound = own * closest + np.sqrt(max(0.0, 1 - own * own)) * np.sqrt(np.maximum(0.0, 1 - closest * closest))
                blocks.append((bound, at, np.full(len(at), end)))
        if not blocks:
            return best
        bound, at, end = (np.concatenate(v) for v in zip(*blocks, strict=True))
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < 1 - best[0] - _SLACK:
                break
            rows = self.rows[at[k] : min(at[k] + BLOCK, end[k])]
            self.read += len(rows)
            sizes = self.starts[rows + 1] - self.starts[rows]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
            cosines = np.add.reduceat(asked[self.terms[places]] * self.weights[places], ends - sizes)
            distances = np.round(1.0 - cosines, _PLACES) + 0.0
            first = distances.min()
            best = min(best, (float(first), int(rows[distances == first].min())))
        return best


def sparse(vector: str):
    """Array of (term, weight) of the values of an array column that are not zero."""
    pairs = F.transform(F.col(vector), lambda x, i: F.struct(i.cast("int").alias("term"), x.cast("float").alias("weight")))
    return F.filter(pairs, lambda p: p["weight"] != 0)


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = column.flatten()
    starts = (column.offsets.to_numpy() - column.offsets[0].as_py()).astype(np.int64)
    return starts, flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.float64)


def nearest_sparse(
    queries: DataFrame,
    corpus: DataFrame,
    width: int,
    query_id: str = "query_id",
    row_id: str = "row_id",
    terms: str = "terms",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(query_id, row_id, distance): the nearest corpus row of every query by cosine distance, the smallest id among equals.

    `terms` holds arrays of (term, weight) of sparse vectors with terms below `width` and weights from 0 on. Exact: distances and ties are
    as in `knn.nearest` with k = 1. A query that shares no term with any row gets the smallest id, at distance 1.
    """
    kinds = queries.groupBy(terms).agg(F.lit(1).alias("_one")).withColumn("_query", F.monotonically_increasing_id())  # kept by writing
    kinds = materialize(kinds.drop("_one"), "asked-vectors")
    rows = materialize(corpus.groupBy(terms).agg(F.min(row_id).alias(row_id)), "searched-vectors")
    n_rows = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(cores, -(-n_rows // 1024)), -(-n_rows // slice_rows))
    row_type = rows.schema[row_id].dataType
    dealt = rows.select(
        F.pmod(F.xxhash64(row_id), F.lit(slices)).cast("int").alias("_slice"), F.lit(False).alias("_asks"), F.lit(None).cast("long").alias("_query"), row_id, terms
    ).unionByName(kinds.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), F.lit(True).alias("_asks"), "_query", F.lit(None).cast(row_type).alias(row_id), terms
    ))
    arrow_type = to_arrow_type(row_type)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, parts, index = None, [], [], None
        for batch in batches:
            place, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (asks[1:] != asks[:-1]), True]) if len(place) else [0]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if place[start] != own:
                    own, names, parts, index = place[start], [], [], None
                part = batch.slice(start, end - start)
                starts, found, weights = _arrays(part.column(4))
                if not asks[start]:
                    names += part.column(3).to_pylist()
                    parts.append((np.diff(starts), found, weights))
                    continue
                if index is None and names:
                    sizes, all_terms, all_weights = (np.concatenate(v) for v in zip(*parts, strict=True))
                    index, parts = Postings(np.r_[0, np.cumsum(sizes)], all_terms, all_weights), []
                if index is not None:
                    best = [index.nearest(found[a:b], weights[a:b], width) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(2), pa.array([names[r] for _, r in best], arrow_type), pa.array([d for d, _ in best])],
                        names=["_query", row_id, "distance"],
                    )

    schema = StructType([StructField("_query", LongType()), StructField(row_id, row_type), StructField("distance", DoubleType())])
    met = dealt.repartition(slices, "_slice").sortWithinPartitions("_slice", "_asks", row_id).mapInArrow(meet, schema)
    best = met.groupBy("_query").agg(F.min(F.struct("distance", row_id)).alias("_best"))
    found = materialize(kinds.join(best, "_query").select(terms, "_best.*"), "nearest-vectors")
    return lookup_join(queries.select(query_id, terms), found, terms, [query_id], "inner").select(query_id, row_id, "distance")
