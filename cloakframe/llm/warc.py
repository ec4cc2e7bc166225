"""WARC archives: write, read back, and an index merged from sorted runs.

Archives are .warc.gz content, a gzip member for each record, written through Spark's
own writer, so that any shared store and its commit protocol serve. Reading gives one
run of index rows for each archive, sorted by URL key and time, in chunks. The chunks
are dealt to key ranges and merged there by a loser tree into globally ordered captures;
they come in order of their first keys, so a merge holds one chunk of each run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, parts, shared_dir

#: Bytes of records, before compression, after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are stored in full each time.
LEAST_REVISIT = 100
#: An empty gzip member: it ends each line of Spark's text writer and reads as nothing.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX = "urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long, length long"
_INDEX = pa.schema(
    [(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to", "place", "length") else pa.string()) for n in (x.split()[0] for x in INDEX.split(", "))]
)


def url_key(url: str) -> str:
    """The host's labels from the last, then path and query, in lower case; what can't be parsed stays as it is."""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", f":{u.port}" if u.port else ""
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    return f"{labels}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def record(page_id: int | None, url: str, captured: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = HTTP % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {datetime.fromtimestamp(captured, timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(5, wbits=31)
    return press.compress(data) + press.flush()


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> None:
    """Write a record for each row of pages (page_id, url, html) below path.

    Null html is an empty payload, null url an empty one. Of rows with equal payloads
    of LEAST_REVISIT bytes or more, those of the smallest page_id are responses and the
    others revisits of it; where all their ids are null, all are responses. captured
    gives epoch seconds; by default they follow from the page_id.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    when = F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1_000_000_000)) if captured is None else captured
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(when.cast("long"), F.lit(0)).alias("captured"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = plain.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = materialise(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("digest", "first"))
    told = plain.join(first, "digest", "left").select(
        "page_id", "url", "captured", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            out, archive = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(*row)
                archive.append(written // ARCHIVE_BYTES)
                written += len(data)
                out.append(_member(data))
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(archive, pa.int64())], ["record", "archive"])

    made = told.mapInArrow(run, "record binary, archive long")
    made.select(F.col("record").cast("string").alias("value"), "archive").write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Place, compressed length and data of each gzip member that isn't empty."""
    at = 0
    while at < len(content):
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(content[at : at + (1 << 16)])
        fed = min(len(content), at + (1 << 16))
        more = [data]
        while not unpack.eof and fed < len(content):
            more.append(unpack.decompress(content[fed : fed + (1 << 16)]))
            fed += 1 << 16
        fed = min(fed, len(content))
        if not unpack.eof:
            raise ValueError(f"archive ends inside a record at byte {at}")
        end = fed - len(unpack.unused_data)
        if data := b"".join(more):
            yield at, end - at, data
        at = end


def parse(data: bytes) -> dict:
    """The index fields of a record, its payload hashed anew where it is there."""
    head, _, block = data.partition(b"\r\n\r\n")
    first, *rest = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
    block = block[: int(fields["Content-Length"])]
    page = lambda s: int(s[len("<urn:x-page:") : -1]) if len(s) > len("<urn:x-page:>") else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    url = fields.get("WARC-Target-URI", "")
    return {
        "urlkey": url_key(url),
        "captured": fields["WARC-Date"],
        "page_id": page(fields["WARC-Record-ID"]),
        "url": url,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


#: Index rows of a run that are one chunk of it.
CHUNK_ROWS = 512
#: First keys of chunks, those with the smallest hashes, by which key ranges are chosen.
MOST_KEYS = 20_000
_KEY = ("urlkey", "captured", "page_id", "archive", "place")
_CHUNK = "urlkey string, captured string, page_id long, archive string, place long, last binary, rows binary"


def _order(urlkey: str, captured: str, page_id: int | None, archive: str, place: int) -> tuple:
    """What captures are ordered by; no two records have the same."""
    return urlkey, captured, page_id is not None, page_id or 0, archive, place


def _pack(value: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, value.schema) as w:
        w.write_batch(value)
    return out.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted run of index rows of each archive below path, in chunks: the first key, the last one and the rows."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [parse(data) | {"archive": name.as_py(), "place": at, "length": n} for at, n, data in read_members(content.as_py())]
                rows.sort(key=lambda r: _order(*(r[c] for c in _KEY)))
                chunks = [pa.RecordBatch.from_pylist(rows[a : a + CHUNK_ROWS], _INDEX) for a in range(0, len(rows), CHUNK_ROWS)]
                if chunks:
                    first = pa.concat_batches([c.slice(0, 1) for c in chunks]).select(list(_KEY))
                    last = [_pack(c.slice(len(c) - 1).select(list(_KEY))) for c in chunks]
                    yield pa.record_batch([*first.columns, pa.array(last, pa.binary()), pa.array([_pack(c) for c in chunks], pa.binary())], [*_KEY, "last", "rows"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _CHUNK)


class LoserTree:
    """Merges sorted sources of comparable keys; the root holds the winner, each inner node the loser of its match.

    head(i) is the key that source i offers, None if it has none now. A source may be
    refilled or added at any time; update(i) then plays it up to the root again.
    """

    def __init__(self, head: Callable[[int], tuple | None], sources: int = 0):
        self.head, self.sources = head, 0
        self.node: list[int] = [0]
        self.grow(sources)

    def grow(self, sources: int) -> None:
        """Make room for so many sources, and play all matches anew if there was none."""
        size = max(1, len(self.node))
        while size < sources:
            size *= 2
        self.sources = max(self.sources, sources)
        self.node = [0] * size
        level = list(range(size))
        at = size
        while at > 1:
            up = []
            for k in range(0, at, 2):
                win, lose = self._match(level[k], level[k + 1])
                self.node[(at + k) // 2] = lose
                up.append(win)
            level, at = up, at // 2
        self.node[0] = level[0]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x = self.head(a) if a < self.sources else None
        y = self.head(b) if b < self.sources else None
        return (a, b) if y is None or (x is not None and (x, a) <= (y, b)) else (b, a)

    def update(self, source: int) -> None:
        """Play a source whose head is new: the winner that went on, one that now goes before all, or any other."""
        if source >= self.sources and source >= len(self.node):
            self.grow(source + 1)
            return
        self.sources = max(self.sources, source + 1)
        size, best = len(self.node), self.node[0]
        if source == best:
            at, win = (source + size) // 2, source
            while at:
                win, self.node[at] = self._match(win, self.node[at])
                at //= 2
            self.node[0] = win
        elif self._match(source, best)[0] == source:
            # It now wins on all its way; who won there before moves down to the place below which it had won.
            hole, at = 0, source + size
            while at > 1:
                below, at = at, at // 2
                lost = self.node[at]
                if hole and (lost + size) >> ((lost + size).bit_length() - below.bit_length()) == below:
                    self.node[hole], hole = lost, at
                elif not hole and lost == source:
                    hole = at
            self.node[hole], self.node[0] = best, source
        else:
            self.grow(self.sources)

    @property
    def winner(self) -> int | None:
        """The source with the smallest key, None if no source has any."""
        best = self.node[0]
        return best if best < self.sources and self.head(best) is not None else None


def merge_chunks(chunks: Iterator[pa.RecordBatch], low: tuple | None, high: tuple | None) -> Iterator[pa.RecordBatch]:
    """The rows from low to below high of chunks that come in order of their first keys, merged.

    A chunk is taken up when the merge reaches its first key, and dropped when it is
    used up, so at most one chunk of each run is held, two while it goes over to the next.
    """
    waiting = iter(chunks)
    batch: list[pa.RecordBatch | None] = []
    keys: list[list[tuple]] = []
    at: list[int] = []
    free: list[int] = []
    tree = LoserTree(lambda i: keys[i][at[i]] if batch[i] is not None else None)
    coming = next(waiting, None)
    out: list[pa.RecordBatch] = []

    def key_of(rows: pa.RecordBatch) -> list[tuple]:
        return [_order(*r) for r in zip(*(rows.column(c).to_pylist() for c in _KEY))]

    while True:
        best = tree.winner
        if coming is not None and (best is None or keys[best][at[best]] >= key_of(coming.slice(0, 1))[0]):
            if free:
                i = free.pop()
                batch[i], keys[i], at[i] = coming, key_of(coming), 0
            else:
                i = len(batch)
                batch.append(coming), keys.append(key_of(coming)), at.append(0)
            at[i] = 0 if low is None else bisect_left(keys[i], low)
            if at[i] == len(keys[i]):
                batch[i] = None
                free.append(i)
            else:
                tree.update(i)
            coming = next(waiting, None)
            continue
        if best is None or (high is not None and keys[best][at[best]] >= high):
            break
        out.append(batch[best].slice(at[best], 1))
        at[best] += 1
        if at[best] == len(keys[best]):
            batch[best] = None
            free.append(best)
        tree.update(best)
        if len(out) == 2048:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if out:
        yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def merge_runs(runs: DataFrame) -> DataFrame:
    """Sorted runs (as read_runs gives them) as one sequence ordered by URL key, time and page, across partitions too.

    Key ranges end anywhere between two captures, so a URL of very many captures is
    dealt to several tasks. A chunk goes to each range that it reaches into.
    """
    spark = runs.sparkSession
    sample = runs.select(*_KEY).orderBy(F.xxhash64("archive", "place")).limit(MOST_KEYS).collect()
    firsts = sorted(_order(*r) for r in sample)
    n = parts(spark)
    bounds = sorted({firsts[i * len(firsts) // n] for i in range(1, n)}) if firsts else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [_order(*r) for r in zip(*(batch.column(c).to_pylist() for c in _KEY))]
            last = [_order(*(c[0].as_py() for c in _unpack(x.as_py()).columns)) for x in batch.column("last")]
            spans = [(bisect_right(bounds, a), bisect_right(bounds, z)) for a, z in zip(first, last)]
            rows = pa.array([i for i, (a, z) in enumerate(spans) for _ in range(a, z + 1)], pa.int64())
            to = pa.array([k for a, z in spans for k in range(a, z + 1)], pa.int32())
            yield pa.record_batch([to, *(batch.column(c).take(rows) for c in (*_KEY, "rows"))], ["range", *_KEY, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ((k, _unpack(rows.as_py())) for batch in batches for k, rows in zip(batch.column("range").to_pylist(), batch.column("rows")))
        for k, own in groupby(chunks, key=itemgetter(0)):
            yield from merge_chunks((rows for _, rows in own), bounds[k - 1] if k else None, bounds[k] if k < len(bounds) else None)

    dealt = runs.mapInArrow(deal, "range int, urlkey string, captured string, page_id long, archive string, place long, rows binary")
    order = ["range", "urlkey", "captured", F.col("page_id").asc_nulls_first(), "archive", "place"]
    return dealt.repartitionById(len(bounds) + 1, "range").sortWithinPartitions(*order).select("range", "rows").mapInArrow(run, INDEX)


def capture_histories(pages: DataFrame, path: str | None = None, captured: Column | None = None) -> DataFrame:
    """Write pages as archives (below path, by default a new shared folder), read them back and merge their index.

    One row for each record, ordered by URL key and time over all partitions. No rows
    give none, extra columns are ignored. A very long page is one record, which its
    writer and reader hold whole; a url or page_id may repeat or be null.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_archives(pages, path, captured)
    return merge_runs(materialise(read_runs(spark, path)))
