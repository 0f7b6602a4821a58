"""Exact nearest neighbours by cosine distance.

Ranking is by distance rounded to 12 places, then by id, so equal vectors rank by id whatever block
they are in. Only the top k of each block of the corpus leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from dietlens.functions.vectors import similarity_from_distance
from dietlens.operators.keys import check_ids
from dietlens.operators.sparse import sparse
from dietlens.session import BROADCAST_BYTES, small_or_none

BLOCK_ROWS = 8192
# Corpus vectors that one task holds, in single precision.
SLICE_BYTES = 32 << 20
# Scan tasks per core: each returns k rows for every broadcast query.
SCANS_PER_CORE = 4
# Scans of the corpus, each past another part of the queries.
MOST_PASSES = 8
_PLACES = 12
_TIE = 10.0 ** -_PLACES
_UNIT_ROWS = 1024  # rows held in double precision at once
_CELLS = 1 << 21  # similarities held at once


def _single_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column as a matrix in its own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector")
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.empty((0, 0))
    dim = len(flat) // n
    if not np.all(np.diff(column.offsets.to_numpy()) == dim):
        raise ValueError("vectors differ in length")
    return flat.reshape(n, dim)


def _sparse_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, terms, weights) of a column of arrays of (term, weight)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten()
    starts = column.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _full_rows(vectors: np.ndarray | tuple, width: int, start: int, stop: int) -> np.ndarray:
    """Rows `start` to before `stop` of a matrix, or of sparse rows."""
    if not isinstance(vectors, tuple):
        return vectors[start:stop]
    starts, terms, weights = vectors
    own = starts[start:stop + 1]
    rows = np.zeros((len(own) - 1, width), np.float32)
    rows[np.repeat(np.arange(len(own) - 1), np.diff(own)), terms[own[0]:own[-1]]] = weights[own[0]:own[-1]]
    return rows


def _rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays of values, or of (term, weight), as a matrix."""
    if pa.types.is_struct(column.type.value_type):
        return _full_rows(_sparse_rows(column), width, 0, len(column))
    return _single_rows(column)


def _is_sparse(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType.elementType, StructType)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; zero rows stay zero."""
    matrix = matrix.astype(np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _keep_best(qrow: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """The k first rows of each query in (distance, id) order."""
    order = np.argsort(ids, kind="stable")
    order = order[np.lexsort((dist[order], qrow[order]))]
    qrow, ids, dist = qrow[order], ids[order], dist[order]
    starts = np.searchsorted(qrow, qrow, side="left")
    keep = np.arange(len(qrow)) - starts < k
    return qrow[keep], ids[keep], dist[keep]


def _first_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Marks k cells of each row: the largest, and among ties the leftmost."""
    width = sims.shape[1]
    if width <= k:
        return np.ones(sims.shape, dtype=bool)
    kth = np.partition(sims, width - k, axis=1)[:, width - k, None]
    above = sims > kth + _TIE
    tied = ~above & (sims >= kth - _TIE)
    need = k - above.sum(axis=1, keepdims=True)
    return above | (tied & (np.cumsum(tied, axis=1) <= need))


class _Block:
    """Rows of the corpus in id order, so that ties at the border go to the smallest ids, with their unit rows in single precision."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
        self.ids, self.rows = ids, rows
        self.fast = np.empty(rows.shape, np.float32)
        for start in range(0, len(rows), _UNIT_ROWS):
            self.fast[start:start + _UNIT_ROWS] = _unit(self.rows[start:start + _UNIT_ROWS])
        # Bounds the error of single precision on unit vectors.
        self.slack = np.float32((rows.shape[1] + 16) * 2.0 ** -23)


def _block_top(queries: np.ndarray, block: _Block, k: int, bound: np.ndarray | None = None):
    """Top k of one corpus block for every query row, as (query row, id, distance).

    `bound` holds the k-th similarity found so far for each query; what lies below it is left out.
    """
    ids, slack = block.ids, block.slack
    step = max(1, min(_UNIT_ROWS, _CELLS // max(1, len(ids))))
    parts = []
    for start in range(0, len(queries), step):
        chunk = _unit(queries[start:start + step])
        # Single precision finds the candidates.
        sims = chunk.astype(np.float32) @ block.fast.T
        least = np.full((len(chunk), 1), -np.inf, np.float32) if bound is None else bound[start:start + step, None].astype(np.float32) - slack
        open_ = np.flatnonzero(np.isneginf(least[:, 0]))
        if len(open_) and len(ids) > k:
            least[open_] = np.partition(sims[open_], len(ids) - k, axis=1)[:, len(ids) - k, None] - 2 * slack
        take = sims >= least
        many = np.count_nonzero(take, axis=1) > 4 * k
        if many.any():
            take[many] = _first_k(chunk[many] @ _unit(block.rows).T, k)
        q, c = np.divmod(np.flatnonzero(take), max(1, len(ids)))
        # The row-wise sum gives equal vectors the same distance in every block.
        exact = [(chunk[q[i:i + _UNIT_ROWS]] * _unit(block.rows[c[i:i + _UNIT_ROWS]])).sum(axis=1) for i in range(0, len(q), _UNIT_ROWS)]
        parts.append((q + start, ids[c], np.round(1.0 - np.concatenate([np.empty(0), *exact]), _PLACES) + 0.0))
    return tuple(np.concatenate(columns) for columns in zip(*parts))


class _Best:
    """The k first rows of `n` queries in (distance, id) order over blocks that come one after another.

    Holds k rows a query, and works on so many queries at once that what a block adds stays small.
    """

    def __init__(self, n: int, k: int):
        self.k, self.counts = k, np.zeros(n, np.int64)
        self.dist, self.ids = np.full((n, k), np.inf), None

    def add(self, first: int, queries: np.ndarray, block: _Block) -> None:
        """`queries` are the vectors of the queries from place `first` on."""
        ids = block.ids
        if self.ids is None:
            self.ids = np.empty(self.dist.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        counts, dist, kept = (x[first:first + len(queries)] for x in (self.counts, self.dist, self.ids))
        bound = np.where(counts == self.k, 1.0 - dist[:, -1], -np.inf)
        qrow, found, far = _block_top(queries, block, self.k, bound)
        met = np.flatnonzero(np.bincount(qrow, minlength=len(queries)))
        held = np.arange(self.k) < counts[met, None]
        qrow, found, far = _keep_best(
            np.concatenate([np.repeat(met, counts[met]), qrow]), np.concatenate([kept[met][held], found]), np.concatenate([dist[met][held], far]), self.k
        )
        place = np.arange(len(qrow)) - np.searchsorted(qrow, qrow, side="left")
        kept[qrow, place], dist[qrow, place] = found, far
        counts[met] = np.bincount(qrow, minlength=len(queries))[met]

    def rows(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, id, distance) of the queries from `first` to before `last`."""
        held = np.arange(self.k) < self.counts[first:last, None]
        return np.repeat(np.arange(first, last), self.counts[first:last]), self.ids[first:last][held], self.dist[first:last][held]


def _id_fields(queries: DataFrame, corpus: DataFrame, query_id: str, row_id: str) -> StructType:
    return StructType([
        StructField(query_id, queries.schema[query_id].dataType),
        StructField(row_id, corpus.schema[row_id].dataType),
        StructField("distance", DoubleType()),
    ])


def _broadcast_top(queries: pa.Table, corpus: DataFrame, k: int, out: StructType, width: int = 0) -> DataFrame:
    """Stream the corpus partitions past the broadcast queries. `width` is needed where vectors are arrays of (term, weight)."""
    query_type = queries.column(0).type
    vectors = _sparse_rows(queries.column(1)) if pa.types.is_struct(queries.column(1).type.value_type) else _single_rows(queries.column(1))
    shared = corpus.sparkSession.sparkContext.broadcast((_ids(queries.column(0)), vectors))
    names = out.names
    row_type = to_arrow_type(out[names[1]].dataType)
    # Each task returns k rows a query: few large tasks, without a shuffle, whatever the corpus is split into.
    tasks = (SCANS_PER_CORE if queries.num_rows <= BLOCK_ROWS else 2) * corpus.sparkSession.sparkContext.defaultParallelism

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        best, starts = _Best(len(query_ids), k), range(0, len(query_ids), BLOCK_ROWS)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = _Block(_ids(batch.column(0)), _rows_of(batch.column(1), width))
            for start in starts:
                best.add(start, _full_rows(vectors, width, start, start + BLOCK_ROWS), block)
        for start in starts if best.ids is not None else ():
            qrow, ids, dist = best.rows(start, min(start + BLOCK_ROWS, len(query_ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[qrow], query_type), pa.array(ids, row_type), pa.array(dist)], names=names
            )

    return corpus.coalesce(tasks).mapInArrow(scan, out)


def _sparse_passes(queries: DataFrame, corpus: DataFrame, width: int, k: int, broadcast_bytes: int, out: StructType) -> DataFrame | None:
    """The scan of `_broadcast_top` for queries of few values other than zero, in as few passes as let each be broadcast; None for others.

    None, too, where more than MOST_PASSES were needed, and where vectors are null or differ in length.
    """
    query_id = out.names[0]
    held = F.size(F.filter("_q", lambda x: x != 0))
    found = queries.agg(F.count("*").alias("n"), F.min(F.coalesce(F.size("_q"), F.lit(-1))).alias("least"), F.sum(held).alias("held")).first()
    passes = -(-(16 * found["n"] + 8 * (found["held"] or 0)) // broadcast_bytes)
    if found["least"] != width or 4 * found["held"] > width * found["n"] or passes > MOST_PASSES:
        return None
    slim = queries.select(query_id, sparse("_q").alias("_q"))
    parts = [slim.filter(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p) for p in range(passes)] if passes > 1 else [slim]
    tables = [part.toArrow() for part in parts]
    return reduce(DataFrame.unionByName, [_broadcast_top(t, corpus, k, out, width) for t in tables if t.num_rows])


def _streamed_top(queries: DataFrame, corpus: pa.Table, width: int, k: int, out: StructType) -> DataFrame:
    """Stream the queries past a broadcast corpus; each query is finished, and ranked, where it is."""
    shared = queries.sparkSession.sparkContext.broadcast((_ids(corpus.column(0)), _rows_of(corpus.column(1), width)))
    ranked = StructType([*out.fields, StructField("rank", IntegerType())])
    names = ranked.names
    query_type = to_arrow_type(out[names[0]].dataType)
    row_type = corpus.column(0).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_ids, rows = shared.value
        block = _Block(row_ids, rows)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            qrow, ids, dist = _keep_best(*_block_top(_single_rows(batch.column(1)), block, k), k)
            rank = np.arange(len(qrow)) - np.searchsorted(qrow, qrow, side="left") + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch.column(0))[qrow], query_type), pa.array(ids, row_type), pa.array(dist),
                 pa.array(rank, pa.int32())],
                names=names,
            )

    return queries.mapInArrow(scan, ranked)


def _ranked(found: DataFrame, query_id: str, row_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy("distance", row_id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _sliced_top(queries: DataFrame, corpus: DataFrame, width: int, k: int, slice_bytes: int, out: StructType) -> DataFrame:
    """One scan of both sides for any number of queries.

    The corpus is dealt by hash into slices of about `slice_bytes`, and the slices into tasks: as many as there are cores, or more if
    a task would hold above SLICE_BYTES. All queries are sent to every task, behind its rows. A task streams them past its slices, one
    after another, so each query leaves a task with k rows: neither what is sent nor what is found grows with the number of slices.
    """
    query_id, row_id, _ = out.names
    if _is_sparse(corpus, "_c"):
        queries = queries.select(query_id, sparse("_q").alias("_q"))
    n_rows = corpus.count()
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(cores, -(-n_rows // BLOCK_ROWS)), -(-n_rows * 4 * width // slice_bytes))
    tasks = min(slices, max(cores, -(-n_rows * 4 * width // SLICE_BYTES)))
    empty = {c: F.lit(None).cast(out[c].dataType).alias(c) for c in (query_id, row_id)}
    own = F.pmod(F.xxhash64(row_id), F.lit(slices)).cast("int")
    rows = corpus.select((own % tasks).alias("_task"), own.alias("_slice"), empty[query_id], row_id, F.col("_c").alias("_v"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"), F.lit(slices).alias("_slice"), query_id, empty[row_id], F.col("_q").alias("_v")
    )
    query_type, row_type = (to_arrow_type(out[c].dataType) for c in (query_id, row_id))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}
        for batch in batches:
            place, part_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part_of[1:] != part_of[:-1]), True]) if len(place) else [0]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if place[start] != task:
                    task, held = place[start], {}
                part = batch.slice(start, end - start)
                found = _rows_of(part.column(4), width)
                if part_of[start] < slices:
                    held.setdefault(part_of[start], []).append((_ids(part.column(3)), found))
                    continue
                for name, parts in held.items():
                    if not isinstance(parts, _Block):
                        held[name] = _Block(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                best = _Best(len(found), k)
                for block in held.values():
                    best.add(0, found, block)
                if held:
                    qrow, ids, dist = best.rows(0, len(found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_ids(part.column(2))[qrow], query_type), pa.array(ids, row_type), pa.array(dist)], names=out.names
                    )

    dealt = rows.unionByName(asked).repartitionById(tasks, "_task").sortWithinPartitions("_task", "_slice")
    return dealt.mapInArrow(meet, out)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    row_id: str = "row_id",
    row_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(query_id, rank, row_id, distance, similarity): the k nearest corpus rows of every query.

    Vectors of the corpus may be arrays of (term, weight) in place of all values. Exact brute force; fewer than k rows come back if the corpus is smaller. Both ids must be unique
    and sortable. Whichever side is within `broadcast_bytes` is broadcast, the queries if both are, and
    the other side is not shuffled. If neither is, queries of few values other than zero are broadcast without their zeros, in up to
    MOST_PASSES passes over the corpus; for others the corpus is shuffled once into slices of about `slice_bytes`, the queries are sent to
    every task that holds some, and both sides are scanned once.
    """
    queries = queries.select(F.col(query_id), F.col(query_vector).cast("array<float>").alias("_q"))
    corpus = corpus.select(F.col(row_id), (F.col(row_vector) if _is_sparse(corpus, row_vector) else F.col(row_vector).cast("array<float>")).alias("_c"))
    out = _id_fields(queries, corpus, query_id, row_id)

    width = queries.agg(F.max(F.size("_q"))).first()[0] or 1  # null vectors count as -1
    most = max(1, broadcast_bytes // (8 * max(1, width)))
    similarity = similarity_from_distance("distance").alias("similarity")
    columns = [query_id, "rank", row_id, "distance", similarity]
    head = queries.limit(most + 1).toArrow()
    if head.num_rows == 0:
        best = queries.sparkSession.createDataFrame([], out)
    elif head.num_rows <= most:
        best = _broadcast_top(head, corpus, k, out, width)
    else:
        rows = corpus.limit(most + 1).toArrow()
        if 0 < rows.num_rows <= most:
            return _streamed_top(queries, rows, width, k, out).select(*columns)
        best = _sparse_passes(queries, corpus, width, k, broadcast_bytes, out)
        if best is None:
            best = _sliced_top(queries, corpus, width, k, slice_bytes, out)
    return _ranked(best, query_id, row_id, k).select(*columns)


def attach_rows(neighbors: DataFrame, rows: DataFrame, row_id: str = "row_id", hot: int = 100_000) -> DataFrame:
    """The corpus columns of every neighbour. `neighbors` is read more than once: pass a written table.

    A row may be the neighbour of very many queries, as when they are copies. Rows met more than `hot` times, and by more
    than a thousandth of all, are joined in several parts; by arithmetic there are at most a thousand of them.
    """
    total = neighbors.count()
    limit = max(hot, total // 1000)
    met = neighbors.groupBy(row_id).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    parts = small_or_none(met.select(row_id, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    if parts.isEmpty():
        return neighbors.join(rows, row_id)
    left = neighbors.join(F.broadcast(parts), row_id, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(*neighbors.columns), F.col("_parts")).cast("int"), F.lit(0))
    )
    right = rows.join(F.broadcast(parts), row_id, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [row_id, "_part"]).drop("_part")


def nearest_by_row_id(ids: DataFrame, corpus: DataFrame, k: int = 5, row_id: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Neighbours of stored rows, the row itself included; raises on an id the corpus lacks."""
    check_ids(ids, corpus, row_id)
    queries = corpus.join(ids.select(row_id), row_id, "left_semi").select(F.col(row_id).alias("query_id"), vector)
    return nearest(queries, corpus, k, query_vector=vector, row_id=row_id, row_vector=vector)


def neighbor_lists(neighbors: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query with its neighbours as an array of structs in rank order."""
    fields = ["rank"] + [c for c in neighbors.columns if c not in (query_id, "rank")]
    return neighbors.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("neighbors"))
