"""WARC archives of pages, and a two-level capture index to read them back.

Archives hold one gzip member per record. A payload that an earlier record has already becomes a revisit without a body. The
index sorts captures by reversed-host URL key into compressed blocks. Each index part ends with a sparse directory, the first
key of every block; the manifest has the first key of every part. A lookup searches manifest, directory and block by bisection
and then reads one range of an archive. Files get names of their own per attempt, and only those in a written manifest count,
so a task that runs again after a loss leaves no double records.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.llm.common import identified, join_counted, null_last
from dietlens.session import materialize, new_path

REVISIT_LEAST = 100
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 2_000
DATE = "2024-01-01T00:00:00Z"  # the pages carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's window bits for a gzip member
_LEVEL = 3
_READ_AHEAD = 1 << 20
#: Captures of an index part, until there are MOST_PARTS of them; bytes of records that a task reads.
PART_LINES, MOST_PARTS = 1_000_000, 50_000
READ_BYTES = 64 << 20


def url_key(url: Column) -> Column:
    """The URL with its host reversed and in lower case, without scheme: `com,example,www)/path?query`. Empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + F.lit(1), F.length(rest)))


def _record_id(page: int | None, at: int, place: int) -> str:
    return f"urn:page:{'' if page is None else page}:{at & (2**64 - 1):x}:{place}"


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def record(record_id: str, url: str | None, payload: bytes, refers: str | None, digest: str) -> bytes:
    """A response record, or a revisit of `refers` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _rows(batch: pa.RecordBatch, names: Sequence[str], portion: int = 512) -> Iterator[tuple]:
    columns = [_column(batch, n) for n in names]
    for start in range(0, batch.num_rows, portion):
        yield from zip(*(c.slice(start, portion).to_pylist() for c in columns), strict=True)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the rows (page, at, place, url, payload, digest, refers) to archives; one capture per row, as a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name, sink = "", None
        try:
            for batch in batches:
                out = []
                for page, at, place, key, url, payload, digest, refers in _rows(
                    batch, ["page", "at", "place", "key", "url", "payload", "digest", "refers"]
                ):
                    if sink is None or sink.tell() > ARCHIVE_BYTES:
                        if sink is not None:
                            sink.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink = files.open_output_stream(f"{base}/{name}", compression=None)
                    start = sink.tell()
                    member = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
                    data = record(_record_id(page, at, place), url, payload, refers, digest)
                    sink.write(member.compress(data) + member.flush())
                    out.append((key, at, place, name, start, sink.tell() - start))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("key", "at", "place", "archive", "start", "length"), row, strict=True)) for row in out],
                    pa.schema([("key", pa.string()), ("at", pa.int64()), ("place", pa.int64()), ("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64())]),
                )
        finally:
            if sink is not None:
                sink.close()

    written = pages.mapInArrow(write, "key string, at long, place long, archive string, start long, length long")
    return materialize(written, "captures")


def _parts(total: int, each: int, df: DataFrame) -> int:
    """Partitions of about `each` out of `total`, but for small totals as many as there are cores."""
    return max(-(-total // each), df.sparkSession.sparkContext.defaultParallelism)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the captures, sorted by (key, at, place), as index parts; the manifest, one row per part, as a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name, sink, directory, lines = f"{uuid.uuid4().hex}.cdx.gz", None, [], []

        def flush() -> None:
            block = zlib.compress(json.dumps(lines).encode(), _LEVEL)
            directory.append([lines[0][:3], sink.tell(), len(block)])
            sink.write(block)
            lines.clear()

        for batch in batches:
            for row in _rows(batch, ["key", "at", "place", "archive", "start", "length"]):
                if sink is None:
                    sink = files.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(list(row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if sink is None:
            return
        if lines:
            flush()
        start, data = sink.tell(), zlib.compress(json.dumps(directory).encode())
        sink.write(data)
        sink.close()
        yield pa.RecordBatch.from_pylist([{"first": json.dumps(directory[0][0]), "part": name, "start": start, "length": len(data)}])

    order = ["key", "at", "place"]
    n_parts = _parts(captures.count(), PART_LINES, captures)
    dealt = captures.repartitionByRange(min(n_parts, MOST_PARTS), *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(write, "first string, part string, start long, length long"), "manifest")


class Index:
    """Looks captures up; keeps the directory of the last part and the last block."""

    def __init__(self, folder: str, parts: Sequence[tuple[list, str, int, int]]):
        self.files, self.base = pafs.FileSystem.from_uri(folder)
        self.parts = sorted(parts)
        self.firsts = [p[0] for p in self.parts]
        self.part = self.block = self.source = None

    def _range(self, start: int, length: int) -> list:
        self.source.seek(start)
        return json.loads(zlib.decompress(self.source.read(length)))

    def find(self, key: str, at: int, place: int) -> tuple[str, int, int] | None:
        """Archive, start and length of the capture."""
        wanted = [key, at, place]
        k = bisect_right(self.firsts, wanted) - 1
        if k < 0:
            return None
        if self.part != k:
            _, name, start, length = self.parts[k]
            if self.source is not None:
                self.source.close()
            self.source = self.files.open_input_file(f"{self.base}/{name}")
            self.directory = self._range(start, length)
            self.starts = [entry[0] for entry in self.directory]
            self.part, self.block = k, None
        b = bisect_right(self.starts, wanted) - 1
        if self.block != b:
            self.lines = self._range(*self.directory[b][1:])
            self.keys = [line[:3] for line in self.lines]
            self.block = b
        i = bisect_right(self.keys, wanted) - 1
        return tuple(self.lines[i][3:]) if i >= 0 and self.keys[i] == wanted else None


def look_up(wanted: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """(archive, start, length) of each wanted (key, at, place) that the index has.

    The manifest has a row per index part, at most MOST_PARTS; it is sent to the tasks.
    """
    rows = manifest.collect()
    parts = [(json.loads(r["first"]), r["part"], r["start"], r["length"]) for r in rows]
    shared = wanted.sparkSession.sparkContext.broadcast(parts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(folder, shared.value)
            found = [hit for row in _rows(batch, ["key", "at", "place"]) if (hit := index.find(*row))]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("archive", "start", "length"), hit, strict=True)) for hit in found],
                pa.schema([("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64())]),
            )

    order = ["key", "at", "place"]
    dealt = wanted.select(*order).repartitionByRange(_parts(wanted.count(), PART_LINES, wanted), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(find, "archive string, start long, length long")


def read_records(ranges: DataFrame, folder: str) -> DataFrame:
    """The records at (archive, start, length): record, page, type, refers, digest, n_bytes, payload digest checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        name, source, head, ahead = None, None, 0, b""
        for batch in batches:
            out = []
            for archive, start, length in _rows(batch, ["archive", "start", "length"]):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source, head, ahead = archive, files.open_input_file(f"{base}/{archive}"), 0, b""
                if not head <= start <= start + length <= head + len(ahead):  # neighbours come with one read
                    source.seek(start)
                    head, ahead = start, source.read(max(length, _READ_AHEAD))
                headers, payload = parse(zlib.decompress(ahead[start - head : start - head + length], _GZIP))
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                refers = headers.get("warc-refers-to")
                if refers is None and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{archive} holds a damaged record at {start}")
                out.append({
                    "record": headers["warc-record-id"][1:-1], "page": _page_of(headers["warc-record-id"][1:-1]), "type": headers["warc-type"],
                    "refers": refers and refers[1:-1], "digest": digest, "n_bytes": None if refers else len(payload),
                })
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("record", pa.string()), ("page", pa.int64()), ("type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()),
            ]))

    # Slim rows stand for whole records: the number of tasks comes from the bytes that they will read.
    ranges = materialize(ranges, "ranges")
    total = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = ranges.repartitionByRange(_parts(total, READ_BYTES, ranges), "archive", "start").sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(read, "record string, page long, type string, refers string, digest string, n_bytes long")


def archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_LEAST
) -> tuple[DataFrame, DataFrame]:
    """Writes a record per row below `folder`; returns the written tables of captures and of the index manifest.

    Of equal payloads of at least `least` bytes the one with the smallest id (null last; of repeated rows the first) is a
    response and the others revisit it. A null page has an empty payload, a null URL an empty key. Ids must be integers. Pages of any
    length are one record each. Other columns are not read, whatever their names.
    """
    whole, (at, place) = identified(pages)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    whole = whole.select(
        F.col(id_col).cast("long").alias("page"), F.col(at).alias("at"), F.col(place).alias("place"),
        F.col(url_col).alias("url"), payload.alias("payload"),
    )
    slim = whole.select("page", "at", "place", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n_bytes"))
    slim = materialize(slim, "payloads")
    first = F.min(F.struct(null_last(F.col("page")).alias("page"), "at", "place")).alias("first")
    groups = slim.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), first).filter("n > 1")
    groups = materialize(groups, "equal-payloads")
    again = join_counted(slim.filter(F.col("n_bytes") >= least), groups, ["digest"], "n", slim.count())
    target = F.concat(
        F.lit("urn:page:"), F.coalesce(F.col("first.page.value").cast("string"), F.lit("")), F.lit(":"),
        F.lower(F.hex("first.at")), F.lit(":"), F.col("first.place").cast("string"),
    )
    again = again.filter((F.col("at") != F.col("first.at")) | (F.col("place") != F.col("first.place")))
    again = again.select("at", "place", target.alias("refers"))
    rows = whole.join(again, ["at", "place"], "left").select(
        "*", url_key(F.col("url")).alias("key"), F.sha2("payload", 256).alias("digest")
    )
    captures = write_archives(rows, folder)
    return captures, write_index(captures, folder)


def read_back(captures: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives; revisits are resolved."""
    records = materialize(read_records(look_up(captures, manifest, folder), folder), "records")
    revisits = records.filter("refers IS NOT NULL").select("page", "type", "refers")
    counts = revisits.groupBy("refers").agg(F.count("*").alias("n"))
    targets = records.filter("refers IS NULL").select(F.col("record").alias("refers"), F.col("page").alias("refers_to"), "n_bytes", "digest")
    targets = materialize(targets.join(counts, "refers"), "revisited")
    resolved = join_counted(revisits, targets, ["refers"], "n", records.count())
    plain = records.filter("refers IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page", "n_bytes", "digest", "type", "refers_to"]
    both = plain.select(*columns).unionByName(resolved.select(*columns))
    return both.toDF("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """`archive` and `read_back`; without a folder the archives go to the shared one. An empty table gives an empty table."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read_back(*archive(pages, folder, **columns), folder)
