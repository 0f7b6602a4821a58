"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are met in tables: the 64 bits are cut into blocks, and two fingerprints within the radius agree in at least
blocks - radius of them, so they share the key of one choice of so many blocks. The fingerprints of a key are stored as
vertical bit planes. A plane shifted by d lanes and xor-ed compares every lane with the one d further on; carry-save counters
add the planes up, and words of 64 lanes whose distances all exceed the radius are abandoned. Groups that are too large for a
task are cut into parts that meet pair by pair. Only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dietlens.llm.common import fresh, identified, join_counted, null_last, quoted
from dietlens.llm.components import components
from dietlens.session import BROADCAST_ROWS, materialize

SHINGLE, RADIUS = 4, 4
SEED = 42
#: Blocks of the fingerprint. BLOCKS - radius of them make a key: 15 tables with keys of 21 bits. From MANY fingerprints on
#: these keys would be crowded by chance; then there are MANY_BLOCKS: 70 tables with keys of 32 bits.
BLOCKS, MANY_BLOCKS, MANY = 6, 8, 1 << 30
#: Most fingerprints of one group; larger ones meet in parts of half as many.
GROUP = 2048
LANES = 1 << 18
SEGMENT = 1 << 16
ROWS = 256
WORD = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, unsigned; zero for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    spans = list(zip([0, *ends], (e - 1 for e in ends[min(shingle, len(tokens)) - 1 :]), strict=False))
    counts = np.zeros(WORD, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, len(spans), SEGMENT):
        part = spans[start : start + SEGMENT]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The `keep` columns and `fingerprint`, a long with the 64 bits. A null text counts as empty."""
    data = fresh("data")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(data))
            bits = [fingerprint(t, shingle) for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            values = pa.array(np.array(bits, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*keep, "fingerprint"])

    slim = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(data))
    return slim.mapInArrow(hashed, T.StructType([slim.schema[c] for c in keep]).add("fingerprint", "long"))


class Planes:
    """Bit planes of a run of lanes: row b holds bit b of every lane, 64 lanes to a word."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        words = -(-self.n // WORD)
        bits = np.zeros((words * WORD, WORD), np.uint8)
        bits[: self.n] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.rows = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)

    def pairs(self, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
        """Lanes i whose distance to lane i + d is within the radius, out of those that `valid` marks."""
        lanes = np.zeros(self.rows.shape[1] * WORD, np.uint8)
        lanes[: len(valid)] = valid
        alive = np.packbits(lanes, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        alive = alive[at]
        whole, rest = divmod(d, WORD)
        n = self.rows.shape[1]
        ones, twos, fours, over = (np.zeros(len(at), np.uint64) for _ in range(4))
        for first in range(0, WORD, 8):
            if not len(at):
                return at
            near = self.rows[first : first + 8]
            far = near[:, np.minimum(at + whole, n - 1)] >> np.uint64(rest)
            if rest:
                far |= np.where(at + whole + 1 < n, near[:, np.minimum(at + whole + 1, n - 1)], 0) << np.uint64(WORD - rest)
            x = near[:, at] ^ far
            for k in range(0, 8, 2):  # a full adder of two planes, then the carries upward
                half = ones ^ x[k]
                carry = (ones & x[k]) | (half & x[k + 1])
                ones = half ^ x[k + 1]
                fourth = twos & carry
                twos ^= carry
                over |= fours & fourth
                fours ^= fourth
            alive &= ~_above(ones, twos, fours, over, radius)
            left = np.flatnonzero(alive)
            if 2 * len(left) < len(at):
                at, alive, ones, twos, fours, over = (v[left] for v in (at, alive, ones, twos, fours, over))
        found = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        return at[found // WORD] * WORD + found % WORD


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, which is below 8."""
    out, equal = over.copy(), ~over
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal &= plane
        else:
            out |= equal & plane
            equal &= ~plane
    return out


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`parent`, where every lane points to the least lane known to be linked with it, after the links a - b."""
    while True:
        pa_, pb_ = parent[a], parent[b]
        differ = pa_ != pb_
        if not differ.any():
            return parent
        a, b, pa_, pb_ = a[differ], b[differ], pa_[differ], pb_[differ]
        np.minimum.at(parent, np.maximum(pa_, pb_), np.minimum(pa_, pb_))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def linked(group: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints (uint64) within the radius in each group; `group` is sorted."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    # Groups by size, so that those with lanes d apart are the tail.
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 1]
    sizes, starts = sizes[by_size], starts[by_size]
    if not len(sizes):
        return values[:0], values[:0]
    offsets = np.cumsum(sizes) - sizes
    lanes = np.repeat(starts - offsets, sizes) + np.arange(sizes.sum())
    values = values[lanes]
    last = np.repeat(offsets + sizes, sizes)  # behind the last lane of the group
    parent = np.arange(len(values))
    planes = Planes(values)
    for d in range(1, int(sizes[-1])):
        first = int(offsets[np.searchsorted(sizes, d, "right")])
        valid = np.zeros(len(values), bool)
        valid[first:] = np.arange(first + d, len(values) + d) < last[first:]
        a = planes.pairs(d, valid, radius)
        if len(a):
            parent = _joined(parent, a, a + d)
    tied = parent != np.arange(len(values))
    return values[tied], values[parent[tied]]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, values = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(g: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = linked(g, v.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            group = np.concatenate([group, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy()])
            if len(group) >= LANES:
                done = int(np.searchsorted(group, group[-1]))  # the last group may go on
                yield out(group[:done], values[:done])
                group, values = group[done:], values[done:]
        yield out(group, values)

    return run


def masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """The bits of the key of each table."""
    edges = [round(k * WORD / blocks) for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within the radius. `prints` is a written table.

    A key with more than `group` fingerprints is cut into parts of at most about half as many, and each pair of parts is a
    group of its own. Groups are named by a hash; a clash only adds comparisons, as each compares all 64 bits.
    """
    if not radius < min(8, blocks):
        raise ValueError("the radius must be below 8 and below the number of blocks")
    keys = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
        for k, m in enumerate(masks(radius, blocks))
    ])
    rows = prints.select("fingerprint", F.explode(keys).alias("at")).select("fingerprint", "at.t", "at.key")
    parts = F.ceil(F.col("n") * 2 / group).cast("int").alias("parts")
    large = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("t", "key", parts), "large")
    small_table = large.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(large) if small_table else large, ["t", "key"], "left")
    own = F.pmod(F.xxhash64(F.lit("part"), "fingerprint"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
    name = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = rows.select(name.alias("group"), "fingerprint").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_link(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    blocks: int | None = None,
    group: int = GROUP,
) -> DataFrame:
    """Per row: `id_col`, the `keep` columns, fingerprint (long), component_id, kept.

    component_id is the smallest id (null behind all others) that links of at most `radius` differing bits reach; kept marks the row
    that has it, the first one of repeated rows. A null, empty or blank text has fingerprint zero, linked like any other.
    An empty table gives an empty table. Texts of any length are hashed whole. Other columns are not read, whatever their names; `keep`
    must not name what is returned.
    """
    docs, row = identified(docs)
    carried = list(dict.fromkeys([id_col, *keep, *row]))
    hashed = materialize(fingerprints(docs, text_col, carried, shingle), "fingerprints")
    first = F.struct(null_last(F.col(id_col)).alias("id"), *row)
    prints = materialize(hashed.groupBy("fingerprint").agg(F.count("*").alias("n_rows"), F.min(first).alias("first")), "prints")
    blocks = blocks or (BLOCKS if prints.count() < MANY else MANY_BLOCKS)
    found = components(materialize(links(prints, radius, blocks, group), "links"), "a", "b")
    rooted = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fingerprint")), "rooted")
    roots = materialize(rooted.groupBy("root").agg(F.count("*").alias("n_prints"), F.min("first").alias("best")), "roots")
    placed = join_counted(rooted.select("fingerprint", "n_rows", "root"), roots, ["root"], "n_prints", rooted.count())
    placed = materialize(placed.select("fingerprint", "n_rows", "best"), "placed")
    out = join_counted(hashed, placed, ["fingerprint"], "n_rows", hashed.count())
    stays = F.lit(True)
    for name in row:
        stays = stays & (F.col(name) == F.col("best")[name])
    return out.select(id_col, *keep, "fingerprint", F.col("best")["id"]["value"].alias("component_id"), stays.alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each component, with all its columns; see `near_duplicates`."""
    whole, row = identified(docs)
    stay = near_duplicates(whole, id_col, text_col, row, **settings).filter("kept").select(*row)
    return whole.join(stay, row, "left_semi").select(*[quoted(c) for c in docs.columns])
