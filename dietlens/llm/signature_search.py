"""Ranked lexical search by bit-sliced Bloom signatures.

The index holds a Bloom signature of each document: its terms, and its terms of at least 2, 3, 5 and 9 occurrences as keys of
their own. Documents with signatures of one width are stored in blocks, bit by bit: a slice is the bitmap of the documents that
have the bit. The slices of a term's bits, and-ed, are the documents that may hold it, and never lack one that does. Weights of
an item's terms summed over these bitmaps, each level with the most it can be worth at the document's length, bound its score.

Documents of the highest bounds are scored exactly first. No document whose bound is below the last of an item's best scores so
found can be among its best; all others are scored exactly from their texts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dietlens.llm.common import identified
from dietlens.session import BROADCAST_ROWS, materialize

BEST = 10
#: Occurrences from which on a term is a key of the level.
LEVELS = (1, 2, 3, 5, 9)
HASHES = 4
#: Bits a key, at least; widths are powers of two.
BITS_PER_KEY, LEAST_WIDTH = 12, 256
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 20
#: Terms of the items that are met by one scan; more items go in blocks.
BLOCK_TERMS = 500_000
ROWS = 256
SEED = 7

# What a term's share of a score is made of: occurrences * UNIT div (STEP * occurrences + 8 * m). Fixed values of the contract.
UNIT, STEP = 1_000_000_000, 1000

# Letters and digits of ASCII, A-Z lower-cased, and all bytes of other characters stay; the rest separates terms.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERMS).split()


def _keys(found: dict[bytes, int]) -> np.ndarray:
    """The keys of a document: a hash of each term for each level that its occurrences reach."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in found), np.uint64, len(found))
    counts = np.fromiter(found.values(), np.int64, len(found))
    return np.concatenate([_leveled(hashes[counts >= least], k) for k, least in enumerate(LEVELS)])


def _leveled(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes * np.uint64(2 * level + 1) + np.uint64(level)


def _places(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits of each key, one row per hash."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([(keys + step * np.uint64(k)) % np.uint64(width) for k in range(HASHES)]).astype(np.int64)


def _width(n_keys: int) -> int:
    return max(LEAST_WIDTH, 1 << (BITS_PER_KEY * n_keys - 1).bit_length())


def _block_docs(width: int) -> int:
    return max(8, min(BLOCK_DOCS, 8 * BLOCK_BYTES // width))


_INDEX = "width int, n_docs long, n_terms long, at array<long>, place array<long>, sizes array<long>, slices binary"


def _block(width: int, rows: list[tuple]) -> pa.RecordBatch:
    at, place, sizes, keys = zip(*rows, strict=True)
    bits = np.zeros((width, -(-len(rows) // 8) * 8), np.uint8)
    for k, own in enumerate(keys):
        bits[_places(own, width).ravel(), k] = 1
    values = [width, len(rows), sum(sizes), list(at), list(place), list(sizes), np.packbits(bits, axis=1, bitorder="little").tobytes()]
    longs = pa.list_(pa.int64())
    types = [pa.int32(), pa.int64(), pa.int64(), longs, longs, longs, pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["width", "n_docs", "n_terms", "at", "place", "sizes", "slices"]
    )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        at, place = (batch.column(k).to_pylist() for k in (0, 1))
        for start in range(0, batch.num_rows, ROWS):
            for i, text in enumerate(batch.column(2).slice(start, ROWS).to_pylist(), start):
                found = terms(text)
                if not found:
                    continue
                keys = _keys(Counter(found))
                width = _width(len(keys))
                rows = waiting[width]
                rows.append((at[i], place[i], len(found), keys))
                if len(rows) == _block_docs(width):
                    yield _block(width, rows)
                    waiting[width] = []
    for width, rows in waiting.items():
        if rows:
            yield _block(width, rows)


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures of the documents (at, place, id, text) that hold a term, written."""
    return materialize(docs.select("at", "place", "text").mapInArrow(_signed, _INDEX), "signatures")


@dataclass
class Items:
    """A block of items: their terms as numbers into `vocabulary`, how often each, and the terms' weights."""

    vocabulary: list[bytes]
    wanted: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, texts: dict[int, bytes]) -> Items:
        numbers: dict[bytes, int] = {}
        wanted = {}
        for item, text in texts.items():
            found = Counter(terms(text))
            if found:
                at = np.array([numbers.setdefault(t, len(numbers)) for t in found], np.int64)
                wanted[item] = (at, np.array(list(found.values()), np.int64))
        return cls(list(numbers), wanted)

    def weigh(self, holding: np.ndarray, n_docs: int, n_terms: int) -> Items:
        """Sets the weights from the number of documents that hold each term."""
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding]
        return Items(self.vocabulary, self.wanted, np.array(weights, np.int64), n_docs, n_terms)

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents with so many terms."""
        return 25 + (75 * sizes * self.n_docs) // self.n_terms

    def score(self, item: int, found: dict[bytes, int], size: int) -> int:
        """The exact score of a document with the term counts `found`."""
        m = int(self.lengths(np.int64(size)))
        total = 0
        for number, times in zip(*(v.tolist() for v in self.wanted[item]), strict=True):
            tf = found.get(self.vocabulary[number], 0)
            total += times * int(self.weights[number]) * ((UNIT * tf) // (STEP * tf + 8 * m))
        return total


def holding(docs: DataFrame, items: Items) -> np.ndarray:
    """How many documents hold each term of the vocabulary: counted in the tasks, added up in one pass over the texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({t: k for k, t in enumerate(items.vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        known, counts = numbers.keys(), np.zeros(len(numbers), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(start, ROWS).to_pylist():
                    at = [numbers[t] for t in known & set(terms(text))]
                    counts[at] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.vocabulary), np.int64)
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out


def bounds(items: Items, keys: np.ndarray, width: int, sizes: np.ndarray, slices: np.ndarray) -> dict[int, np.ndarray]:
    """Upper bounds of the scores of a block's documents, for each item. `keys` are the hashes of the vocabulary."""
    n = len(sizes)
    m = items.lengths(sizes).astype(np.float64)
    most = [UNIT * tf / (STEP * tf + 8 * m) for tf in (b - 1 for b in LEVELS[1:])] + [np.full(n, UNIT / STEP)]
    held = np.arange(len(keys))  # terms that some document may hold at this level
    out = {item: np.zeros(n) for item in items.wanted}
    maps = None
    for level in range(len(LEVELS)):
        places = _places(_leveled(keys[held], level), width)
        found = np.bitwise_and.reduce(slices[places], axis=0)
        if maps is not None:
            found &= maps
        some = found.any(axis=1)
        held, maps = held[some], found[some]
        if not len(held):
            break
        bits = np.unpackbits(maps, axis=1, bitorder="little", count=n).astype(np.float64)
        number = np.full(len(keys), -1)
        number[held] = np.arange(len(held))
        worth = most[level] - (most[level - 1] if level else 0.0)
        for item, (at, times) in items.wanted.items():
            rows = number[at]
            here = rows >= 0
            if here.any():
                out[item] += (times[here] * items.weights[at[here]]) @ bits[rows[here]] * worth
    # Above the rounding of doubles; the exact score rounds down.
    return {item: np.ceil(bound * (1 + 1e-12)) for item, bound in out.items()}


def _scan(index: DataFrame, items: Items, least: dict[int, int] | None) -> DataFrame:
    """(item, at, place) of the documents of the highest bounds per task, or, given `least`, of all whose bounds reach it."""
    shared = index.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = shared.value
        keys = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in own.vocabulary), np.uint64, len(own.vocabulary))
        empty = (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        best = dict.fromkeys(own.wanted, empty)
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column(0)[i].as_py()
                at, place, sizes = (batch.column(k)[i].values.to_numpy() for k in (1, 2, 3))
                slices = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(width, -1)
                for item, bound in bounds(own, keys, width, sizes, slices).items():
                    if floor is not None:
                        take = np.flatnonzero((bound > 0) & (bound >= floor.get(item, 0)))
                        if len(take):
                            yield _found(item, bound[take], at[take], place[take])
                        continue
                    merged = [np.concatenate(pair) for pair in zip(best[item], (bound, at, place), strict=True)]
                    keep = np.argsort(-merged[0], kind="stable")[:BEST]
                    best[item] = tuple(v[keep] for v in merged)
        if floor is None:
            for item, (bound, at, place) in best.items():
                some = bound > 0
                yield _found(item, bound[some], at[some], place[some])

    columns = index.select("width", "at", "place", "sizes", "slices")
    return columns.mapInArrow(run, "item long, bound double, at long, place long")


def _found(item: int, bound: np.ndarray, at: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(at), item, np.int64)), pa.array(bound), pa.array(at), pa.array(place)]
    return pa.RecordBatch.from_arrays(columns, names=["item", "bound", "at", "place"])


def _rescored(candidates: DataFrame, docs: DataFrame, items: Items) -> DataFrame:
    """(item, score, at, place, id) of the best candidates of each task, scored from their whole texts. `candidates` is written."""
    asked = candidates.groupBy("at", "place").agg(F.collect_list("item").alias("asked"))
    asked = materialize(asked, "asked")
    if asked.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(asked.select("at", "place")), ["at", "place"], "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for i in range(batch.num_rows):
                at, place, name, text, wanted = (batch.column(k)[i].as_py() for k in range(5))
                found = terms(text)
                counts = Counter(found)
                for item in wanted:
                    score = own.score(item, counts, len(found))
                    if score > 0:
                        best[item].append((-score, name is None, 0 if name is None else name, at, place))
                        if len(best[item]) > 4 * BEST:
                            best[item] = sorted(best[item])[:BEST]
        out = [(item, -r[0], r[3], r[4], None if r[1] else r[2]) for item, rows in best.items() for r in sorted(rows)[:BEST]]
        types = [pa.int64()] * 4 + [to_arrow_type(kind)]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "at", "place", "id"])

    kind = docs.schema["id"].dataType
    texts = docs.join(asked, ["at", "place"]).select("at", "place", "id", "text", "asked")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("item", "score", "at", "place")]).add("id", kind)
    return texts.mapInArrow(run, schema)


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "at", "place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


def search(items: DataFrame, docs: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`item_col`, rank, `id_col`, score): the best BEST documents of each item, exactly.

    Equal scores go by id, null behind all others, then by place; repeated rows are documents of their own, and an item that stands
    twice in the table is answered twice. A null, empty or blank text has no terms: such a document is never found and counts for
    nothing, such an item has no rows; nor has an item none of whose terms occur, or any item on an empty table. Texts of any length
    are read whole; long ones have wide signatures, in blocks of fewer documents. Other columns are not read.

    Items go in blocks with at most about BLOCK_TERMS terms, each met by one count of its terms over the texts and two scans of the
    signatures.
    """
    spark = docs.sparkSession
    docs = _slim(docs, id_col, text_col)
    asked = _slim(items, item_col, text_col)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.lit(1.0) * F.sum(F.length("text")) / (2 * BLOCK_TERMS))).cast("int")
    blocks = asked.agg(n_blocks).first()[0] or 1
    asked = asked.withColumn("item", F.monotonically_increasing_id())  # kept by writing
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "items")
    index = build_index(docs)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ("item", "score", "at", "place")]).add(
        "id", docs.schema["id"].dataType).add("rank", "integer"))
    for block in range(blocks if n_docs else 0):
        rows = asked.filter(F.col("block") == block).select("item", "text").toArrow()
        own = Items.of(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))
        if not own.wanted:
            continue
        own = own.weigh(holding(docs, own), n_docs, n_terms)
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "at", "place")
        first = _scan(index, own, None).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= BEST)
        first = materialize(_rescored(materialize(first, "first"), docs, own), "first-scored")
        last = _ranked(first).filter(F.col("rank") == BEST).select("item", "score").toArrow()
        least = dict(zip(last.column(0).to_pylist(), last.column(1).to_pylist(), strict=True))
        open_docs = materialize(_scan(index, own, least), "candidates")
        found = found.unionByName(materialize(_ranked(_rescored(open_docs, docs, own)), "found"))
    named = asked.select("item", F.col("id").alias(item_col))
    return found.join(named, "item").select(item_col, "rank", F.col("id").alias(id_col), "score")


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, place, id, text): the identity of the row, its id and its text in UTF-8, empty for null."""
    df, row = identified(df)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")
    return df.select(F.col(row[0]).alias("at"), F.col(row[1]).alias("place"), F.col(f"`{id_col}`").alias("id"), text)
