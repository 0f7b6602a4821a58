"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one class. Each tree branches classes: a node chooses BRANCHES coordinates of the minwise
signature by a hash of its own path, and a class goes on to the child named by its minwise token there. Two branches a node make
the paths of a linked pair multiply faster than they die out, so the chance to meet does not fall with depth; trees are repeated
until all of them miss a pair at the threshold with at most the probability that the target recall leaves.

Nodes of at most NODE classes are compared exhaustively. In larger ones one class, the pivot, is compared with all, which connects
a group of near copies that no branching parts; if all but LIMIT classes are connected then, the others are compared with every
class of the node, and else it branches. Comparing means a sketch first: a byte of each coordinate, and a bitmap in which every
shingle flips a bit, so that bitmaps of linked texts never differ in more bits than their sets in shingles. Full shingle sets
decide. Pairs that known links connect are not compared: a node first tests a spanning forest of the pairs that its sketches
let pass, the closest ones, and then the pairs that are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dietlens.llm.common import fresh, identified, join_counted, null_last
from dietlens.llm.components import components
from dietlens.session import BROADCAST_ROWS, materialize

SHINGLE, PERCENT, RECALL = 3, 85, 0.9999
SEED = 11
COORDINATES = 64
BRANCHES = 2
#: Bits that the shingles of a text flip.
FLIPS = 2048
#: Most classes of a node that one task compares.
NODE = 4096
#: Classes outside the largest connected part of a larger node, from which on it branches.
LIMIT = 64
BLOCK = 64
#: Nodes of this depth do not branch; their classes are compared in blocks of LIMIT.
DEPTH = 12
#: Classes compared with one hub in one group.
HUB_GROUP = 4096
SKETCH_MISS = 1e-5
SEGMENT = 4096
ROWS = 256
CHUNK_BYTES = 4 << 20


@lru_cache
def _factors(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text in UTF-8; none for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(shingle, len(tokens))
    factors = _factors(size)
    n = len(tokens) - size + 1
    mixed = sum((hashes[k : k + n] * factors[k] for k in range(1, size)), hashes[:n] * factors[0])
    mixed = (mixed ^ (mixed >> np.uint64(32))) * factors[0]
    mixed = np.sort(mixed ^ (mixed >> np.uint64(29)))
    return mixed[np.r_[True, mixed[1:] != mixed[:-1]]]


@lru_cache
def _mixers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    shift = rng.integers(0, 2**64, (COORDINATES, 1), dtype=np.uint64)
    return shift, rng.integers(0, 2**63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(tokens: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The minwise token of each coordinate, as its hash there. `tokens` is not empty."""
    shift, factor = _mixers(seed)
    parts = [((tokens[at : at + SEGMENT] ^ shift) * factor).min(axis=1) for at in range(0, len(tokens), SEGMENT)]
    return np.minimum.reduce(parts)


def flips(tokens: np.ndarray) -> np.ndarray:
    """A bitmap in which each token flips the bit that its hash names."""
    return np.packbits(np.bincount((tokens % np.uint64(FLIPS)).astype(np.int64), minlength=FLIPS).astype(np.uint8) & 1)


def trees(percent: int, recall: float) -> int:
    """How many trees miss a pair at the threshold with probability below 1 - recall, and one for the finite signature."""
    s, miss = percent / 100, 0.0
    for _ in range(10_000):
        miss = (1 - s + s * miss) ** BRANCHES
    return 1 + (1 if miss <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(miss)))


def cutoff(percent: int) -> int:
    """Coordinates in which sketches of a pair at the threshold agree, but for a share SKETCH_MISS of such pairs."""
    s, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)
        if below > SKETCH_MISS:
            return k
    return COORDINATES


def _hashed(docs: DataFrame, data: str, shingle: int) -> DataFrame:
    """The other columns, n_shingles, the digest of the set, its signature and its sketch."""
    keep = [c for c in docs.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(data))
            sizes, digests, mins, sketches = [], [], [], []
            for at in range(0, len(texts), ROWS):
                for text in texts.slice(at, ROWS).to_pylist():
                    found = shingles(text, shingle)
                    sizes.append(len(found))
                    digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                    mins.append(signature(found) if len(found) else np.zeros(COORDINATES, np.uint64))
                    sketches.append(mins[-1].astype(np.uint8).tobytes() + flips(found).tobytes())
            flat = np.concatenate(mins) if mins else np.empty(0, np.uint64)
            offsets = pa.array(np.arange(len(mins) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)) for c in keep],
                    pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))),
                    pa.array(sketches, pa.binary()),
                ],
                names=[*keep, "n_shingles", "digest", "mins", "sketch"],
            )

    schema = T.StructType([docs.schema[c] for c in keep]).add("n_shingles", "long").add("digest", "binary")
    return docs.mapInArrow(run, schema.add("mins", T.ArrayType(T.LongType())).add("sketch", "binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES + FLIPS // 8)


def _sizes_fit(a, b, percent: int):
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of sketches differ, row by row."""
    flipped = np.ascontiguousarray(a[..., COORDINATES:] ^ b[..., COORDINATES:])
    return np.bitwise_count(flipped.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _can_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Whether sketches, row by row, let pairs with `sizes` shingles in both sets together pass."""
    agree = (a[..., :COORDINATES] == b[..., :COORDINATES]).sum(axis=-1) >= least
    return agree & ((100 + percent) * _differing(a, b) <= (100 - percent) * sizes)


def _near_pivot(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(member, hub) of rows (cls, n_shingles, sketch, pivot, pivot_size, pivot_sketch) that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(5).to_numpy()
            near = pa.array(_can_link(_matrix(batch.column(1)), _matrix(batch.column(4)), sizes, least, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(3).filter(near)], names=["member", "hub"])

    columns = rows.select("cls", "sketch", "n_shingles", "pivot", "pivot_sketch", "pivot_size")
    return columns.mapInArrow(run, "member long, hub long")


def _near_listed(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(member, hub) for rows (cls, n_shingles, color, sketch, others) and each of the others that may be linked with them.

    A pair of which both are listed comes out once: the other must then be the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, hubs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4)]
            sketches = _matrix(batch.column(3))
            lists = batch.column(5)
            flat = lists.flatten()
            cls, size, color = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            others = _matrix(flat.field(3))
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for i in range(len(lists)):
                at = slice(ends[i], ends[i + 1])
                small, large = np.minimum(size[at], own[1][i]), np.maximum(size[at], own[1][i])
                fits = (color[at] != own[2][i]) & (100 * small >= percent * large)
                fits &= _can_link(others[at], sketches[i], small + large, least, percent)
                if own[3][i]:
                    fits &= cls[at] < own[0][i]
                found = cls[at][fits]
                members.append(np.full(len(found), own[0][i]))
                hubs.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (members, hubs)], names=["member", "hub"])

    columns = rows.select("cls", "n_shingles", "color", "sketch", "listed", "others")
    return columns.mapInArrow(run, "member long, hub long")


def _forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray, color: np.ndarray) -> np.ndarray:
    """The edges a - b of a spanning forest of least costs between the colours, by Boruvka's rounds."""
    part = np.unique(color, return_inverse=True)[1]
    order = np.lexsort((b, a, cost))  # ties in one order, so that no round closes a circle
    a, b = a[order], b[order]
    chosen = np.zeros(len(a), bool)
    left = np.arange(len(a))
    while True:
        left = left[part[a[left]] != part[b[left]]]
        if not len(left):
            return order[chosen]
        ends = np.concatenate([part[a[left]], part[b[left]]])
        edge = np.concatenate([left, left])
        first = np.full(part.max() + 1, len(a))
        np.minimum.at(first, ends, edge)
        first = np.unique(first[first < len(a)])
        chosen[first] = True
        x, y = part[a[first]], part[b[first]]
        up = np.arange(part.max() + 1)
        while len(x):
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while not (up[up] == up).all():
                up = up[up]
            x, y = up[x], up[y]
            x, y = x[x != y], y[x != y]
        part = up[part]


def _pairs(cls: np.ndarray, size: np.ndarray, color: np.ndarray, sketch: np.ndarray, least: int, percent: int, first: bool):
    """(member, hub) of rows of one node, sorted by class, that differ in colour and may be linked; hub is the smaller one.

    With `first` only a spanning forest of the closest.
    """
    pairs = []
    coordinates = sketch[:, :COORDINATES]
    for at in range(0, len(cls), BLOCK):
        rows = slice(at, at + BLOCK)
        small, large = np.minimum.outer(size[rows], size), np.maximum.outer(size[rows], size)
        fits = (color[rows, None] != color) & (100 * small >= percent * large)
        fits &= np.arange(len(cls)) < np.arange(at, at + len(fits))[:, None]
        if not fits.any():
            continue
        fits &= (coordinates[rows, None, :] == coordinates[None, :, :]).sum(axis=2) >= least
        i, j = np.nonzero(fits)
        i += at
        differ = _differing(sketch[i], sketch[j])
        near = (100 + percent) * differ <= (100 - percent) * (size[i] + size[j])
        pairs.append((i[near], j[near], differ[near] / (size[i] + size[j])[near]))
    i, j, cost = (np.concatenate(v) for v in zip(*pairs, strict=True)) if pairs else [np.empty(0, np.int64)] * 3
    if first and len(i):
        chosen = _forest(i, j, cost, color)
        i, j = i[chosen], j[chosen]
    return cls[i], cls[j]


def _pairs_of_nodes(members: DataFrame, least: int, percent: int, first: bool) -> DataFrame:
    """`_pairs` of nodes with at most NODE classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray], sketch: np.ndarray) -> pa.RecordBatch:
            node = columns[0]
            edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]) if len(node) else [0]
            found = [
                _pairs(*(c[a:b] for c in columns[1:]), sketch[a:b], least, percent, first)
                for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1
            ]
            found = [np.concatenate(v) for v in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["member", "hub"])

        waiting = [np.empty(0, np.int64) for _ in range(4)], np.empty((0, COORDINATES + FLIPS // 8), np.uint8)
        for batch in batches:
            columns = [np.concatenate([w, batch.column(k).to_numpy()]) for k, w in enumerate(waiting[0])]
            sketch = np.concatenate([waiting[1], _matrix(batch.column(4))])
            done = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0  # the last node may go on
            yield out([c[:done] for c in columns], sketch[:done])
            waiting = [c[done:] for c in columns], sketch[done:]
        yield out(*waiting)

    columns = members.select("node", "cls", "n_shingles", "color", "sketch").repartition("node").sortWithinPartitions("node", "cls")
    return columns.mapInArrow(run, "member long, hub long").distinct()


def _sent(texts: DataFrame, shingle: int) -> DataFrame:
    """The shingle set of each text, once for each group that asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                text, cls, asks = (batch.column(k)[i].as_py() for k in range(3))
                packed = shingles(text, shingle).tobytes()
                for ask in asks:
                    out.append((ask["hub"], ask["part"], cls, packed))
                    size += len(packed) + 32
                    if size > CHUNK_BYTES:
                        yield _packed(out)
                        out, size = [], 0
            yield _packed(out)

    return texts.mapInArrow(run, "hub long, part int, cls long, tokens binary")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    types = {"hub": pa.int64(), "part": pa.int32(), "cls": pa.int64(), "tokens": pa.binary()}
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(types))


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens = None, None
        for batch in batches:
            a, b = [], []
            for hub, part, is_hub, cls, packed in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = np.frombuffer(packed, np.uint64)
                if is_hub:
                    at, tokens = (hub, part), found
                    continue
                assert at == (hub, part)
                place = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                common = int((tokens[place] == found).sum())
                if 100 * common >= percent * (len(tokens) + len(found) - common):
                    a.append(cls)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, data: str, row: Sequence[str], shingle: int, percent: int) -> DataFrame:
    """(a, b): those of the distinct `pairs` (member, hub; written) that full sets confirm.

    Only the texts of classes in `pairs` are read; each is sent to the hubs it is compared with. A hub with many members is sent to
    several groups of at most about HUB_GROUP of them.
    """
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    hubs = materialize(hubs.select("hub", "n", F.ceil(F.col("n") / HUB_GROUP).cast("int").alias("parts")), "hubs")
    part = F.lit(0)
    if hubs.agg(F.max("parts")).first()[0] not in (None, 1):
        pairs = join_counted(pairs, hubs, ["hub"], "n", pairs.count())
        part = F.pmod(F.xxhash64("member"), "parts").cast("int")
    dealt = pairs.select(F.col("member").alias("cls"), F.struct("hub", part.alias("part")).alias("ask"))
    own = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asks = dealt.unionByName(own.select(F.col("hub").alias("cls"), F.struct("hub", "part").alias("ask")))
    # A class is asked for by its partners and, if it is a hub, by its groups: at most the rows divided by HUB_GROUP.
    asked = asks.groupBy("cls").agg(F.collect_list("ask").alias("asks")).join(classes.select("cls", "first.*"), "cls")
    asked = materialize(asked.select("cls", *row, "asks"), "asked")
    places = asked.select(*row)
    near = docs.join(F.broadcast(places), list(row), "left_semi") if asked.count() <= BROADCAST_ROWS else docs
    texts = near.select(*row, F.coalesce(F.col(f"`{data}`"), F.lit("")).cast("binary").alias("_text")).join(asked, list(row))
    sent = _sent(texts.select("_text", "cls", "asks"), shingle)
    dealt = sent.select("hub", "part", (F.col("cls") == F.col("hub")).alias("is_hub"), "cls", "tokens").repartition("hub", "part")
    ordered = dealt.sortWithinPartitions("hub", "part", F.desc("is_hub"))
    return ordered.mapInArrow(_compare(percent), "a long, b long")


def _node(parent, coordinate):
    return F.xxhash64(parent, coordinate, F.element_at("mins", coordinate + 1)).alias("node")


def _children(members: DataFrame) -> DataFrame:
    """(node, cls) one level further down. The coordinates hang on the node alone, so all its classes branch alike."""
    seed = F.xxhash64("node", F.lit(SEED))
    step = F.pmod(F.shiftright(seed, 32), F.lit(COORDINATES // BRANCHES)) + 1
    # Different ones: k steps of at most COORDINATES / BRANCHES never come round.
    chosen = [F.pmod(seed + k * step, F.lit(COORDINATES)).cast("int") for k in range(BRANCHES)]
    return members.select("cls", F.explode(F.array(*[_node(F.col("node"), c) for c in chosen])).alias("node"))


def _colored(members: DataFrame, known: DataFrame | None) -> DataFrame:
    """`members` with `color`: the least class that known links reach."""
    if known is None:
        return members.withColumn("color", F.col("cls"))
    found = members.join(known.withColumnRenamed("node", "cls"), "cls", "left")
    return found.withColumn("color", F.coalesce("root", "cls")).drop("root")


def _joined(known: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """(node, root) of the known components after new links (a, b)."""
    if new.isEmpty():
        return known
    edges = new if known is None else new.unionByName(known.toDF("a", "b"))
    return materialize(components(edges, "a", "b"), "known")


def _exhausted(members: DataFrame, nodes: DataFrame, total: int, least: int, percent: int) -> DataFrame:
    """Pairs of different colour in `nodes` (node, n, color as major, n_minor) of which one is not of the largest colour."""
    blocks = F.ceil(F.col("n_minor") / LIMIT).cast("int")
    placed = materialize(
        join_counted(members, nodes.withColumn("blocks", blocks), ["node"], "n", total)
        .withColumn("listed", F.col("color") != F.col("major")), "placed",
    )
    block = F.pmod(F.xxhash64(F.lit("block"), "cls"), F.col("blocks")).cast("int").alias("block")
    one = F.struct("cls", "n_shingles", "color", "sketch")
    lists = placed.filter("listed").groupBy("node", block).agg(F.collect_list(one).alias("others"), F.first("n").alias("n"))
    lists = materialize(lists, "lists")
    spread = placed.drop("n").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _near_listed(join_counted(spread, lists, ["node", "block"], "n", total), least, percent).distinct()


def linked(classes: DataFrame, docs: DataFrame, data: str, row: Sequence[str], shingle: int, percent: int, recall: float) -> DataFrame | None:
    """(node, root) of the classes that confirmed links of the trees join, None if there are none. `classes` and `docs` are stored tables."""
    least = cutoff(percent)
    slim = classes.select("cls", "n_shingles", "sketch")
    roots = [F.xxhash64(F.lit(t), F.lit(SEED)) for t in range(trees(percent, recall))]
    first = [_node(root, F.lit(BRANCHES * t + k)) for t, root in enumerate(roots) for k in range(BRANCHES)]
    # One token is shared by chance as soon as there are very many texts, so nodes of the first depth branch whatever their size.
    level = _children(classes.select("cls", "mins", F.explode(F.array(*first)).alias("node")))
    known = None
    for depth in range(2, DEPTH + 1):
        nodes = level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        nodes = materialize(nodes, "nodes")
        n_rows = nodes.agg(F.sum("n")).first()[0]
        if not n_rows:
            break
        members = join_counted(level, nodes, ["node"], "n", n_rows).select("node", "n", "cls").join(slim, "cls")
        members = materialize(_colored(members, known), "members")
        crowded = nodes.filter(F.col("n") > NODE)
        any_crowded = not crowded.isEmpty()

        # A star of every crowded node, and a forest of the closest pairs of those that fit a task.
        tested = _pairs_of_nodes(members.filter(F.col("n") <= NODE), least, percent, True)
        if any_crowded:
            tested = tested.unionByName(_stars(members.filter(F.col("n") > NODE), slim, least, percent)).distinct()
        tested = materialize(tested, "tested")
        known = _joined(known, materialize(confirmed(tested, classes, docs, data, row, shingle, percent), "links"))

        # What is still apart: all pairs in nodes that fit a task; in others the few against all, or they branch.
        members = materialize(_colored(members.drop("color"), known), "members")
        rest = _pairs_of_nodes(members.filter(F.col("n") <= NODE), least, percent, False)
        if any_crowded:
            apart = members.filter(F.col("n") > NODE)
            parts = apart.groupBy("node", "color").agg(F.count("*").alias("k"))
            parts = parts.groupBy("node").agg(F.sum("k").alias("n"), F.max(F.struct("k", "color")).alias("top"))
            parts = parts.select("node", "n", F.col("top.color").alias("major"), (F.col("n") - F.col("top.k")).alias("n_minor"))
            parts = materialize(parts.filter("n_minor > 0"), "parts")
            few = parts if depth == DEPTH else parts.filter(F.col("n_minor") <= LIMIT)
            rest = rest.unionByName(_exhausted(apart.drop("n"), few, n_rows, least, percent)).distinct()
        rest = materialize(rest.join(tested, ["member", "hub"], "left_anti"), "rest")
        known = _joined(known, materialize(confirmed(rest, classes, docs, data, row, shingle, percent), "links"))
        if not any_crowded or depth == DEPTH:
            break
        large = materialize(parts.filter(F.col("n_minor") > LIMIT).select("node", "n"), "large")
        if large.isEmpty():
            break
        going = join_counted(members.select("node", "cls"), large, ["node"], "n", n_rows)
        level = materialize(_children(going.join(classes.select("cls", "mins"), "cls")), "level")
    return known


def _stars(members: DataFrame, slim: DataFrame, least: int, percent: int) -> DataFrame:
    """(member, hub): every class of each node with the node's pivot, a class chosen by hash, if they may be linked."""
    nodes = members.groupBy("node").agg(
        F.count("*").alias("k"), F.min(F.struct(F.xxhash64("node", "cls").alias("h"), "cls")).alias("p"),
        F.min("color").alias("low"), F.max("color").alias("high"),
    ).filter("low < high").select("node", "k", F.col("p.cls").alias("pivot"))
    shown = slim.select(F.col("cls").alias("pivot"), F.col("n_shingles").alias("pivot_size"), F.col("sketch").alias("pivot_sketch"))
    nodes = materialize(nodes.join(shown, "pivot"), "pivots")
    met = join_counted(members, nodes, ["node"], "k", members.count())
    met = met.filter((F.col("cls") != F.col("pivot")) & _sizes_fit(F.col("n_shingles"), F.col("pivot_size"), percent))
    return _near_pivot(met, least, percent)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    recall: float = RECALL,
) -> DataFrame:
    """Per row: `id_col`, the `keep` columns, n_shingles, component_id, kept.

    Two texts are linked when 100 * intersection >= `percent` * union of their sets of distinct word shingles, which full sets
    confirm; a link is found with probability `recall` at least, linked texts that others connect too more surely. component_id is
    the smallest id (null behind all others) that links reach; kept says whether it is the row's own. A text with fewer words than
    `shingle` is one shingle. A null, empty or blank text has no set and is linked with nothing. Repeated rows are linked like
    other copies. Very long texts are read whole; a task holds the shingle hashes of one text at a time. An empty table gives an
    empty table. Other columns are not read, whatever their names.
    """
    docs, row = identified(docs)
    own, data = fresh("own"), fresh("data")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias(data)
    carried = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, *keep])]).alias(own)
    hashed = materialize(_hashed(docs.select(*row, carried, text), data, shingle), "hashed")
    first = F.struct(null_last(F.col(own)[id_col]).alias("id"), *row)
    filled = hashed.filter("n_shingles > 0")
    classes = filled.groupBy("digest").agg(
        F.count("*").alias("n_rows"), F.min(first).alias("first"),
        *[F.first(c).alias(c) for c in ("n_shingles", "mins", "sketch")],
    ).withColumn("cls", F.monotonically_increasing_id())  # kept by writing
    classes = materialize(classes, "classes")
    found = linked(classes, docs, text_col, row, shingle, percent, recall)
    rooted = materialize(_colored(classes.select("cls", "digest", "n_rows", "first"), found), "rooted")
    least = rooted.groupBy("color").agg(F.count("*").alias("n"), F.min("first").alias("best"))
    least = materialize(least.withColumnRenamed("color", "root"), "least")
    placed = join_counted(rooted.withColumnRenamed("color", "root"), least, ["root"], "n", rooted.count())
    placed = materialize(placed.select("digest", "n_rows", F.col("best")["id"]["value"].alias("component_id")), "placed")
    rows = filled.select(own, "n_shingles", "digest")
    out = join_counted(rows, placed, ["digest"], "n_rows", filled.count()).select(own, "n_shingles", "component_id")
    alone = hashed.filter("n_shingles = 0").select(own, "n_shingles", F.col(own)[id_col].alias("component_id"))
    columns = [F.col(own)[c].alias(c) for c in dict.fromkeys([id_col, *keep])]
    return out.unionByName(alone).select(
        *columns, "n_shingles", "component_id", F.col(own)[id_col].eqNullSafe(F.col("component_id")).alias("kept")
    )
