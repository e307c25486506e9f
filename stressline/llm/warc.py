"""WARC archives with revisit records, and a capture index merged by loser trees.

Writing: each page becomes a gzip member with one WARC/1.1 record. Of equal payloads of at
least ``least`` bytes the page with the largest id is written as response, the
others as revisits that refer to it; shorter payloads are always responses. Members are
gathered into segments, rows of a table in the shared folder, which any
executor can read again (``export_archives`` joins them into files).

Reading: every segment is unpacked and parsed; response payloads are hashed again and
compared with their header. A segment's index entries, sorted by (URL key, time, page), are one run.

Merging: the entries are written once. Their number gives the number of ranges of (URL key, time, page, run, offset), about
``range_rows`` entries each (index entries without payloads, which is what a task holds), so a hot URL is cut as well. In a range the
runs lie one after another in rising order and a loser tree merges them. Ranges follow one another, so the
capture histories are in global order; ``merge_part`` and ``merge_place`` give it.

Null html is the empty payload, a null url the empty one. Rows with a null page_id
are written last among their equals and are revisits where another page has their
payload; of ties in URL and time the smaller page_id comes first. A page_id that is repeated with the same payload and is the largest gives responses only.
Very long payloads are one record each. Other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", re.S)
_BLANK = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: captures of one site sort together."""
    host, rest = _URL.match(url or "").groups()
    host = host.lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


#: Seconds to the end of the year 9999, the last that a WARC date can name.
_LAST = int((datetime(9999, 12, 31, 23, 59, 59, tzinfo=timezone.utc) - _EPOCH).total_seconds())


def capture_time(page_id: int | None) -> datetime:
    """Pages carry no time; one second per id stands for it. Ids beyond the year 9999 get its last second; the page orders them."""
    return _EPOCH + timedelta(seconds=min(max(page_id or 0, 0), _LAST))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    uri = _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id} {digest} {uri}')}>",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    body = _HTTP + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        body = _HTTP
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def members(segment: bytes, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member."""
    at, view = 0, memoryview(segment)
    while at < len(segment):
        z, start, parts = zlib.decompressobj(31), at, []
        while not z.eof:
            if at >= len(segment):
                raise ValueError("the segment ends inside a record")
            piece = view[at : at + step]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield start, at - start, b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a WARC record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


class LoserTree:
    """k-way merge: inner nodes hold the loser of each match, so a new key replays one path."""

    _END = object()

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs, n = key, runs, max(1, len(runs))
        self.heads = [next(r, self._END) for r in runs] or [self._END]
        self.tree = [-1] * n
        winners = [-1] * n + list(range(n))
        for i in range(n - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.tree[i] = (a, b) if self._first(a, b) else (b, a)
        self.top = winners[1] if n > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if y is self._END:
            return True
        if x is self._END:
            return False
        return (self.key(x), a) <= (self.key(y), b)

    def __iter__(self) -> Iterator:
        n = len(self.heads)
        while (out := self.heads[self.top]) is not self._END:
            yield out
            w = self.top
            self.heads[w] = next(self.runs[w], self._END)
            i = (w + n) // 2
            while i >= 1:
                if self._first(self.tree[i], w):
                    self.tree[i], w = w, self.tree[i]
                i //= 2
            self.top = w


_SEGMENT = "archive int, segment long, records long, content binary"


def _write(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, segment, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([segment]), pa.array([len(held)]), pa.array([b"".join(held)], pa.binary())], names=["archive", "segment", "records", "content"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*cols, strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield close()
                    segment, held, size = segment + 1, [], 0
        if held:
            yield close()

    return run


_ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured long, run long, record_offset long, record_length long"
_ENTRY_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]
_ENTRY_KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in _ENTRY.split(", ")]


def _sort_key(x: tuple) -> tuple:
    return x[5], x[6], x[0] is not None, x[0] or 0, x[8]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, segment, content in zip(batch.column("archive").to_pylist(), batch.column("segment").to_pylist(), batch.column("content"), strict=True):
            run, rows = archive << 32 | segment, []
            for offset, length, raw in members(content.as_py()):
                head, block = parse(raw)
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if head["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"]):
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                captured = int(datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
                rows.append((None if page is None else int(page), int(head["x-payload-length"]), digest, head["warc-type"], None if refers is None else int(refers), url_key(head["warc-target-uri"]), captured, run, offset, length))
            rows.sort(key=_sort_key)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ENTRY_KINDS, strict=True)], names=_ENTRY_NAMES)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in _ENTRY_NAMES), strict=True)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ENTRY_KINDS, strict=True)], names=_ENTRY_NAMES)


def merge_runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """k-way merge of rows that come as rising runs, one after another; a run is told by its number, field 7."""
    runs = [list(run) for _, run in itertools.groupby(rows, key=lambda x: x[7])]  # one range of bounded size
    yield from LoserTree([iter(r) for r in runs], _sort_key)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    merged = merge_runs(row for batch in batches for row in _rows_of(batch))
    place = 0
    while rows := list(itertools.islice(merged, 4096)):
        cols = _batch_of(rows).columns
        yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows)), pa.array(range(place, place + len(rows)))], names=[*_ENTRY_NAMES, "merge_part", "merge_place"])
        place += len(rows)


def write_archives(pages: DataFrame, scratch: Scratch, *, least: int = 1000, segment_bytes: int = 1 << 20, broadcast_groups: int = 200_000) -> DataFrame:
    """The table of archive segments."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    group = F.concat_ws("-", "digest", F.xxhash64("payload").cast("string"), F.col("n").cast("string"))
    keyed = base.withColumn("same", F.when(F.col("n") >= least, group).otherwise(F.concat_ws("-", F.lit("own"), F.col("page_id").cast("string"), "digest")))
    equal = keyed.where(F.col("n") >= least).groupBy("same").agg(F.count("*").alias("copies"), F.max("page_id").alias("first")).where("copies > 1").select("same", "first")
    equal = scratch.save(equal, "equal")
    side = F.broadcast(equal) if equal.count() <= broadcast_groups else equal
    named = keyed.join(side, "same", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return scratch.save(named.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_write(segment_bytes), _SEGMENT), "archives")


def read_entries(archives: DataFrame) -> DataFrame:
    """The index entries of all segments; every record is unpacked, parsed and, where it has a payload, hashed again."""
    return archives.select("archive", "segment", "content").mapInArrow(_read, _ENTRY)


def merge_captures(archives: DataFrame, scratch: Scratch, *, range_rows: int = 1 << 17) -> DataFrame:
    """All captures in (URL key, time, page) order: the index entries with merge_part and merge_place."""
    order = ["url_key", "captured", "page_id", "run", "record_offset"]
    entries = scratch.save(read_entries(archives), "entries")
    least = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = entries.repartitionByRange(max(least, entries.count() // range_rows + 1), *order).sortWithinPartitions("run", *order[:3], "record_offset")
    return runs.mapInArrow(_merge, _ENTRY + ", merge_part long, merge_place long")


def capture_histories(pages: DataFrame, **options) -> DataFrame:
    """Pages through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to, and the index columns."""
    scratch = Scratch(pages.sparkSession, "warc")
    return merge_captures(write_archives(pages, scratch, **options), scratch)


def export_archives(archives: DataFrame, folder: str) -> list[str]:
    """Writes one .warc.gz a file archive to a local folder, segment after segment."""
    paths: list[str] = []
    for row in archives.orderBy("archive", "segment").toLocalIterator():
        path = f"{folder}/{row['archive']:06d}.warc.gz"
        with open(path, "ab" if path in paths else "wb") as f:
            f.write(row["content"])
        if path not in paths:
            paths.append(path)
    return paths


#: The digest columns of capture_histories.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') html from pages), q as (select *, strlen(html) n from p),
f as (select *, case when n >= 1000 then max(page_id) over (partition by html) end last_ from q)
select page_id, cast(n as bigint) payload_bytes, sha1(html) payload_digest, case when last_ is not null and last_ is distinct from page_id then 'revisit' else 'response' end record_type, case when last_ is distinct from page_id then last_ end refers_to from f
"""
