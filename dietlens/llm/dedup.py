"""Exact dedup by content-defined chunk recipes.

Each text without BLANKS is cut where a rolling hash of the last WINDOW bytes has its top bits zero, so equal passages are cut
alike wherever they stand. Distinct chunks meet once, by hash, and are compared byte for byte there; hashes that stand for
several chunks get an identifier for each of them. Texts are equal when their ordered identifier lists are: whole texts are
never shuffled, compared or sorted, and a passage that many texts share is moved once per task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dietlens.llm.common import BLANKS, fresh, identified, join_counted, null_last, quoted
from dietlens.session import materialize

WINDOW = 32
CUT_BITS = 10  # a cut every 2^10 bytes behind the least length, in the mean
LEAST, MOST = 256, 8192
SEGMENT = 1 << 20
ROWS = 256
# Longest list of a hot group that is broadcast; see `dedupe`.
BROADCAST_CHUNKS = 1_000

_BLANKS = BLANKS.encode()
# One number per byte value: the top half of a multiplicative hash.
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _candidates(data: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end. The hash at i is the sum of gear(byte i-k) << k for k below WINDOW."""
    found = []
    for start in range(0, len(data), SEGMENT):
        head = max(0, start - WINDOW)
        h = _GEAR[data[head : start + SEGMENT]]
        step = 1
        while step < WINDOW:
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + head + 1
        found.append(at[at > start])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of `data`, the last one its length. Lengths are from LEAST to MOST, but for the last."""
    n, ends, at = len(data), [], 0
    # LEAST is more than WINDOW, so a cut never depends on what stands before its chunk.
    places = _candidates(np.frombuffer(data, np.uint8)).tolist() if n > LEAST else []
    while n - at > LEAST:
        k = bisect_left(places, at + LEAST)
        at = min(places[k] if k < len(places) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _chunks(data: bytes, bits: int) -> Iterator[tuple[int, bytes]]:
    at = 0
    for end in chunk_ends(data):
        chunk = data[at:end]
        h = xxhash.xxh64_intdigest(chunk) >> (64 - bits)
        yield (h - (1 << 64) if h >> 63 else h), chunk
        at = end


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    values = batch.column(batch.schema.get_field_index(column))
    for start in range(0, len(values), ROWS):
        for value in values.slice(start, ROWS).to_pylist():
            yield value.translate(None, _BLANKS)


def _recipes(docs: DataFrame, data: str, keep: Sequence[str], bits: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, recipes = [], []
            for text in _texts(batch, data):
                digests.append(hashlib.sha256(text).hexdigest())
                recipes.append([h for h, _ in _chunks(text, bits)])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(digests, pa.string()), pa.array(recipes, pa.list_(pa.int64()))],
                names=[*keep, "text_sha256", "recipe"],
            )

    schema = T.StructType([docs.schema[c] for c in keep])
    schema = schema.add("text_sha256", "string").add("recipe", T.ArrayType(T.LongType()))
    return docs.select(*keep, data).mapInArrow(cut, schema)


def _stored_chunks(docs: DataFrame, data: str, bits: int) -> DataFrame:
    """(chunk hash, bytes), each once per batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {pair for text in _texts(batch, data) for pair in _chunks(text, bits)}
            hashes, chunks = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(chunks, pa.binary())], names=["hash", "chunk"])

    return docs.select(data).mapInArrow(cut, "hash long, chunk binary")


def _placed_chunks(docs: DataFrame, data: str, row: Sequence[str], bits: int) -> DataFrame:
    """(row identity, place, chunk hash, bytes) of every chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in row]
            out = [(i, k, h, c) for i, text in enumerate(_texts(batch, data)) for k, (h, c) in enumerate(_chunks(text, bits))]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([col[x[0]] for x in out], pa.int64()) for col in ids],
                    *[pa.array([x[j] for x in out], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()))],
                ],
                names=[*row, "place", "hash", "chunk"],
            )

    types = ", ".join(f"`{c}` long" for c in row)
    return docs.select(*row, data).mapInArrow(cut, f"{types}, place long, hash long, chunk binary")


def _verified(docs: DataFrame, recipes: DataFrame, data: str, row: Sequence[str], bits: int) -> DataFrame:
    """`recipes` with `variants`: for each chunk whose hash stands for several chunks its place and which of them it is.

    Chunk hashes and variants together identify the bytes. With 64 bits such hashes appear from about 10^9 chunks on.
    """
    stored = _stored_chunks(docs, data, bits)
    shared = materialize(stored.groupBy("hash").agg(F.countDistinct("chunk").alias("n")).filter("n > 1").select("hash"), "shared-hashes")
    none = F.array().cast("array<struct<place:bigint,variant:bigint>>")
    if shared.isEmpty():
        return recipes.withColumn("variants", none)
    kinds = stored.join(shared, "hash", "left_semi").distinct()
    number = F.row_number().over(_by_chunk()).cast("long").alias("variant")
    kinds = materialize(kinds.select("hash", "chunk", number), "chunk-variants")
    placed = _placed_chunks(docs, data, row, bits).join(kinds, ["hash", "chunk"])
    variants = placed.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("place", "variant"))).alias("variants"))
    return materialize(
        recipes.join(variants, list(row), "left").withColumn("variants", F.coalesce("variants", none)), "verified-recipes"
    )


def _by_chunk():
    from pyspark.sql import Window

    return Window.partitionBy("hash").orderBy("chunk")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), hash_bits: int = 64) -> DataFrame:
    """Per row: `id_col`, the `keep` columns, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without BLANKS. The row with the most code points in the whole text stays, then the one
    with the smallest id (null behind all others), then the first of repeated rows, of which only one stays. Null counts as
    empty; all empty texts are one group. An empty table gives an empty table. Texts of any length are cut whole. Other columns are
    not read, whatever their names; `keep` must not name what is returned.

    Groups with many rows are joined by a broadcast of their keys, at most 1,000 of at most BROADCAST_CHUNKS identifiers each.
    `hash_bits` below 64 makes different chunks share hashes; results stay the same.
    """
    data, size = fresh("data"), fresh("size")
    docs, row = identified(docs)
    carried = list(dict.fromkeys([id_col, *keep, *row]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(*carried, text.cast("binary").alias(data), F.length(text).cast("long").alias(size))
    recipes = materialize(_recipes(slim, data, [*carried, size], hash_bits), "recipes")
    recipes = _verified(slim, recipes, data, row, hash_bits)
    order: Column = F.struct((-F.col(size)).alias("size"), null_last(F.col(id_col)).alias("id"), *row)
    same = ["text_sha256", "recipe", "variants"]
    groups = recipes.groupBy(*same).agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    groups = materialize(groups.withColumn("short", F.size("recipe") <= BROADCAST_CHUNKS), "groups")
    out = join_counted(recipes, groups, same, "group_size", recipes.count(), F.col("short"))
    stays = F.lit(True)
    for name in row:
        stays = stays & (F.col(name) == F.col("best")[name])
    return out.select(id_col, *keep, F.col("best")["id"]["value"].alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see `dedupe`."""
    whole, row = identified(docs)
    stay = dedupe(whole, id_col, text_col, row).filter("kept").select(*row)
    return whole.join(stay, row, "left_semi").select(*[quoted(c) for c in docs.columns])
