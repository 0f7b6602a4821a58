"""BPE encoding and decoding with a pair occurrence index.

A batch of a partition is encoded as a whole. Texts are cut into pieces; the distinct pieces that are new to the task's worker
are laid end to end as a linked list of symbols, and an index maps each mergeable pair to all its places. Ranks with places
are taken in ascending order; all places of a rank merge at once, and only the lists of the pairs that change are updated.
(A merge makes a symbol that only later ranks hold, so no rank comes up twice.)
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dietlens.llm.common import fresh

# Unicode White_Space, as the tokenizer's regular expressions see it. Fixed value.
SPACE = r"\t-\r \x85\xa0  -     　"
# The pattern that cuts text before the merges. Fixed value.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_PIECES = regex.compile(PIECE)
# No piece crosses from other characters to white space, and of a run of white space only the last character goes on.
_UNITS = re.compile(rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]?[^{SPACE}]+")
# Where cutting in front of every blank would cut elsewhere than _UNITS does.
_ODD = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")

MAX_FILE = 64 << 20
BATCH_CHARS = 2 << 20
ROWS = 512
#: Distinct units and their ids that a worker remembers; beyond that it starts anew. This bounds memory only.
MAX_UNITS = 1 << 18
MAX_IDS = 1 << 22


@dataclass(frozen=True)
class Vocabulary:
    """Symbols as bytes, merges by rank as (left, right, merged), and strings with an id of their own."""

    symbols: list[bytes]
    merges: np.ndarray
    special: dict[str, int]
    name: str

    @cached_property
    def byte_ids(self) -> np.ndarray:
        ids = {s: i for i, s in enumerate(self.symbols) if len(s) == 1 and i not in self.special.values()}
        return np.array([ids[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        keys = self.merges[:, 0] * len(self.symbols) + self.merges[:, 1]
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        keys, order = self.ranked
        wanted = left.astype(np.int64) * len(self.symbols) + right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, order[at], -1)


def _printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself, or from U+0100 on the other bytes in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def load(path: str) -> Vocabulary:
    """A byte-level BPE vocabulary from a JSON file of the tokenizers library, of at most MAX_FILE bytes."""
    with open(path, "rb") as file:
        data = file.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    spec, byte_of = json.loads(data), _printable()
    model = spec["model"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} does not hold a byte-level BPE without a prefix space")
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    symbols = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in [*vocab.items(), *special.items()]:
        symbols[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    return Vocabulary(symbols, merges, special, path)


def encode_pieces(vocabulary: Vocabulary, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, end to end, and the number of ids of each."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbol = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    filled = sizes > 0
    after[ends[filled] - 1] = -1
    before[(ends - sizes)[filled]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(places: np.ndarray) -> None:
        """Put the pairs that begin at these places into the index."""
        ranks = vocabulary.ranks(symbol[places], symbol[after[places]])
        known = ranks >= 0
        places, ranks = places[known], ranks[known]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = ranks[np.r_[0, cuts]].tolist()
        for rank, part in zip(firsts, np.split(places, cuts) if len(cuts) else [places], strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(part)

    add(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        left, right, merged = vocabulary.merges[rank]
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(symbol[at] == left) & (after[at] >= 0)]
        at = at[symbol[after[at]] == right]
        if left == right and len(at) > 1:  # of overlapping places the first, third and so on of a run
            new_run = np.r_[True, after[at[:-1]] != at[1:]]
            starts = np.flatnonzero(new_run)
            at = at[(np.arange(len(at)) - starts[np.cumsum(new_run) - 1]) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        symbol[at], symbol[gone] = merged, -1
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        lefts = before[at]
        add(np.concatenate([lefts[lefts >= 0], at[beyond >= 0]]))
    alive = symbol >= 0
    counts = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], counts[ends] - counts[ends - sizes]


class Encoder:
    """Encodes batches of texts, and remembers the ids of units of text across batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)  # of unit k in ids; its end is the start of k + 1
        for name, i in self.vocabulary.special.items():
            self._store([name + " "], np.array([i], np.int32), np.array([1]))

    def _store(self, keys: Sequence[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.units)
        used = int(self.starts[n])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used + 2 * len(ids), np.int32)])
        if n + len(keys) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(n + 2 * len(keys), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(keys)] = used + np.cumsum(counts)
        self.units.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _cut(self, text: str) -> list[str]:
        """Keys of the units of a text: a unit of one blank and other characters without it, any other with a blank behind."""
        if _ODD.search(text):
            return [u[1:] if u[0] == " " and " " not in u[1:] else u + " " for u in _UNITS.findall(text)]
        keys = text.split(" ")
        if keys[0]:
            keys[0] += " "
            return keys
        return keys[1:]

    def _keys(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._cut(text)
        parts = self.special.split(text)
        return [k for i, part in enumerate(parts) for k in ([part + " "] if i % 2 else self._cut(part))]

    def _learn(self, keys: Sequence[str]) -> None:
        cut = [_PIECES.findall(k[:-1] if k.endswith(" ") else " " + k) for k in keys]
        places = {p: i for i, p in enumerate(dict.fromkeys(p for pieces in cut for p in pieces))}
        ids, counts = encode_pieces(self.vocabulary, [p.encode() for p in places])
        starts = np.cumsum(counts) - counts
        order = np.fromiter((places[p] for pieces in cut for p in pieces), np.int64)
        flat = _gather(ids, starts[order], counts[order])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        totals = np.concatenate([[0], np.cumsum(counts[order])])
        self._store(keys, flat, np.diff(totals[np.concatenate([[0], ends])]))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the place behind the last id of each."""
        if len(self.units) > MAX_UNITS or self.starts[len(self.units)] > MAX_IDS:
            self.clear()
        cut = [self._keys(t) for t in texts]
        flat = [k for keys in cut for k in keys]
        new = list(set(flat).difference(self.units))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.units.__getitem__, flat), np.int64, len(flat))
        starts = self.starts[at]
        counts = self.starts[at + 1] - starts
        totals = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return _gather(self.ids, starts, counts), totals[ends]


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs values[start : start + count], end to end."""
    behind = np.cumsum(counts)
    total = int(behind[-1]) if len(behind) else 0
    return values[np.repeat(starts - behind + counts, counts) + np.arange(total)]


_ENCODERS: dict[str, Encoder] = {}  # of this worker, by vocabulary


def _encoder(vocabulary: Vocabulary) -> Encoder:
    if vocabulary.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.name] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.name]


def _portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, about BATCH_CHARS bytes at a time."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(BATCH_CHARS, sizes.sum() + BATCH_CHARS, BATCH_CHARS), "right")
    at = 0
    for cut in [*np.unique(cuts).tolist(), len(texts)]:
        if cut > at:
            yield texts.slice(at, cut - at).to_pylist()
            at = cut


def _decode(symbols: Sequence[bytes], ids: np.ndarray) -> str:
    return b"".join(map(symbols.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: Sequence[str] = ("doc_id",), decoded: str | None = None
) -> DataFrame:
    """Per row the `keep` columns and `ids`, the ids of the whole text. Strings with an id of their own become that id.

    With `decoded`, a column of that name has the text decoded from the ids, without a second pass. A null text counts as empty
    and has no ids. Rows are encoded one by one, so ties and repeated rows need no rule. An empty table gives an empty table.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most MAX_FILE bytes of JSON
    data = fresh("text")
    names = [*keep, "ids", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts, done = batch.column(batch.num_columns - 1).cast(pa.string()), 0
            for portion in _portions(texts):
                ids, ends = encoder.encode(portion)
                starts = np.concatenate([[0], ends])
                columns = [c.slice(done, len(portion)) for c in batch.columns[:-1]]
                done += len(portion)
                columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))
                if decoded:
                    symbols = encoder.vocabulary.symbols
                    columns.append(pa.array([_decode(symbols, ids[a:b]) for a, b in zip(starts, ends, strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(data))
    schema = T.StructType([slim.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType()))
    return slim.mapInArrow(run, schema.add(decoded, "string") if decoded else schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """Per row the `keep` columns and the text of its ids. Bytes that are not UTF-8 become U+FFFD; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.symbols)
    data = fresh("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            starts = lists.offsets.to_pylist()
            for at in range(0, len(lists), ROWS):
                spans = zip(starts[at : at + ROWS], starts[at + 1 : at + ROWS + 1], strict=False)
                texts = [_decode(shared.value, lists.values[a:b].to_numpy()) for a, b in spans]
                kept = [c.slice(at, ROWS) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*keep, out])

    empty = F.array().cast("array<int>")
    slim = rows.select(*keep, F.coalesce(F.col(ids_col), empty).alias(data))
    return slim.mapInArrow(run, T.StructType([slim.schema[c] for c in keep]).add(out, "string"))
