"""WARC archives of web captures, and a merged index of their histories.

Writing: a record is a gzip member of its own, so that it can be read alone from its offset.  Identical
payloads are stored once as a response and otherwise as revisits.  Members are gathered to archives
of about ``ARCHIVE_BYTES``; Spark's text writer puts one archive a file (any file system, task commits as
usual).  It ends every file with a separator, a zero byte: the last byte of every archive, which is cut
off before (an empty member is added where a record's member ends otherwise).
Reading: every file is parsed by the Content-Length of its records, digests are taken anew from the
payloads.  Index: every archive file gives a run sorted by URL key, timestamp and record; runs are
cut at common range bounds, as many as keep a range at ``RANGE_ROWS``, and each range is a k-way merge
of its runs by a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, with_workers

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
#: Bytes at which an archive file is closed; only a larger record makes a larger file.
ARCHIVE_BYTES = 32 << 20
#: Records of the index that one range of the merge is planned for.
RANGE_ROWS = 200_000
#: Records of a run whose keys are read at once.
BLOCK = 1024
_RECORD = "page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, payload string"


def base32_sha1(hex_sha1: Column) -> Column:
    """The bare upper-case base32 form of a hexadecimal SHA-1."""
    parts = [F.lpad(F.conv(F.substring(hex_sha1, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: a response).

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary"))})
    last = rows.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("newest"))
    # a key with very many rows is split by the adaptive skew join: the other side has one row a key
    both = rows.join(last, ["sha1", "payload_bytes"])
    refers = F.when((F.col("payload_bytes") >= least) & (F.col("page_id") < F.col("newest")), F.col("newest"))
    return both.select("page_id", "url", "html", "payload_bytes", base32_sha1(F.col("sha1")).alias("payload_digest"), refers.alias("refers_to"))


def write_archives(records: DataFrame, path: str, *, captured: Column | None = None, size: int | None = None) -> None:
    """One WARC/1.1 record per row of ``plan_records`` in archives of about ``size`` bytes below ``path``."""
    if captured is None:  # pages carry no time of capture: one second per page from a fixed day on
        captured = F.timestamp_seconds(F.lit(1704067200) + F.pmod("page_id", F.lit(1_000_000_000)))
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Date: "), F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL * 2),
    )
    with_workers(records.sparkSession)
    size = size or ARCHIVE_BYTES
    empty = gzip.compress(b"", mtime=0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(members: list[bytes]) -> pa.RecordBatch:
            if members[-1][-1]:  # only a member of 16 MB or more ends with another byte
                members.append(empty)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["archive"])

        members, held = [], 0
        for batch in batches:
            for record in batch.column(0):
                members.append(gzip.compress(record.as_py().encode() + b"\r\n\r\n", 6, mtime=0))
                held += len(members[-1])
                if held >= size:
                    yield archive(members)
                    members, held = [], 0
        if members:
            yield archive(members)

    made = records.select(F.concat(head, block).alias("record")).mapInArrow(pack, "archive binary")
    # the string's bytes are written as they are
    out = made.select(F.col("archive").cast("string").alias("value")).write
    out.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


class _Stream:
    """Bytes of a gzip file (any number of members), unpacked as they are asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buf, self.gone = memoryview(raw), 0, bytearray(), 0
        self.unpack = zlib.decompressobj(31)
        self.members = [(0, 0)]  # where each begins, in unpacked and in packed bytes

    def more(self) -> bool:
        if self.unpack.eof:
            self.at -= len(self.unpack.unused_data)
            self.unpack = zlib.decompressobj(31)
            self.members.append((self.gone + len(self.buf), self.at))
        if self.at >= len(self.raw):
            return False
        chunk = self.raw[self.at : self.at + 65536]
        self.at += len(chunk)
        self.buf += self.unpack.decompress(chunk)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buf.find(mark, start)) < 0:
            start = max(0, len(self.buf) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        self.gone += n
        return out

    def member_of(self, at: int) -> int:
        """Where the member that holds unpacked byte ``at`` begins in the file."""
        i = bisect_right(self.members, (at, len(self.raw)))
        packed = self.members[i - 1][1]
        del self.members[: i - 1]
        return packed


def url_key(url: str) -> str:
    """The host's labels in reverse order, then the path: captures of a site sort together."""
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("#")[0].partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){slash}{path}"


def parse_archive(raw: bytes) -> Iterator[dict]:
    """The records of one gzip archive; ``offset`` is where the gzip member begins that a record begins in."""
    src = _Stream(raw)
    while True:
        begin = src.gone
        head = src.until(b"\r\n\r\n")
        if head is None:
            if src.buf.strip():
                raise ValueError("the archive ends within a header")
            return
        lines = head.decode().split(_EOL)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block = src.take(int(fields["content-length"]))
        if src.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't followed by two line ends")
        http, _, payload = block.partition(b"\r\n\r\n")
        number = lambda name: int(fields[name].rpartition(":")[2].rstrip(">"))
        out = {"page_id": number("warc-record-id"), "url": fields["warc-target-uri"], "captured": fields["warc-date"], "record_type": fields["warc-type"], "offset": src.member_of(begin)}
        if out["record_type"] == "revisit":
            size = next(x for x in http.decode().split(_EOL) if x.lower().startswith("content-length:"))
            out |= {"payload": None, "payload_bytes": int(size.partition(":")[2]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": number("warc-refers-to")}
        else:
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "refers_to": None}
            if out["payload_digest"] != fields["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"record {out['page_id']}: the payload doesn't match its digest")
        yield out | {"url_key": url_key(out["url"])}


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """All records of the gzip archives below ``path``; without ``payload`` that column is null."""
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for file, raw in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for r in parse_archive(raw.as_py()):
                    body = r["payload"] if payload else None
                    rows.append(r | {"file": file.as_py(), "payload": body.decode() if body is not None else None})
                    held += len(body or b"") + 300
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _RECORD)


class LoserTree:
    """Merge of sorted iterators: an inner node holds the loser of the match below it."""

    _END = object()

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, self._END) for r in runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is self._END or y is self._END:
            return x is not self._END
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while True:
            i = self.tree[0]
            if self.head[i] is self._END:
                return
            yield self.head[i]
            self.head[i] = next(self.runs[i], self._END)
            self._play(i)


def merge_index(records: DataFrame, scratch: Scratch, run: str = "file", keys: tuple[str, ...] = ("url_key", "captured", "page_id"), rows: int | None = None) -> DataFrame:
    """All records in the global order of ``keys``, with their ``position`` in it (from 0).

    The rows of one ``run`` (an archive file) are sorted among themselves first; each of the ranges
    of keys then merges its runs.  There are as many ranges as hold ``rows`` records each, and a URL with
    very many captures is cut by time like any others, so a task's memory doesn't grow with the input.
    """
    names = records.columns
    ranges = max(1, -(-records.count() // (rows or RANGE_ROWS)))
    ranged = records.repartitionByRange(ranges, *[F.col(k) for k in keys]).sortWithinPartitions(run, *keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole).combine_chunks()
        of_run = table.column(run).combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of_run)) + 1).tolist(), len(of_run)]

        def heads(a: int, b: int) -> Iterator[tuple]:
            for at in range(a, b, BLOCK):
                part = table.slice(at, min(BLOCK, b - at))
                yield from zip(*(part.column(k).to_pylist() for k in keys), range(at, at + part.num_rows), strict=True)

        order = (x[-1] for x in LoserTree([heads(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]))
        while some := list(islice(order, 8 * BLOCK)):
            yield from table.take(pa.array(some, pa.int64())).to_batches()

    merged = ranged.mapInArrow(merge, records.schema).withColumn("at", F.monotonically_increasing_id())
    merged = scratch.keep(merged.withColumn("range", F.shiftright("at", 33)), "merged")
    # one row a range: how many records lie in the ranges before
    before = F.sum("many").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = merged.groupBy("range").agg(F.count("*").alias("many")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    position = (F.col("start") + F.col("at") - F.shiftleft("range", 33)).alias("position")
    return merged.join(starts, "range").select(*names, position)


def capture_histories(pages: DataFrame, *, path: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives, read them back, and merge their index.

    Returns one row per page in the order of URL key, time and page_id: the record's columns without
    its payload, and ``position``.  Null html is an empty payload, null url an empty URI; control
    characters and spaces of a URL are written as %20.  Rows with a null page_id take no part;
    repeated rows give a record each, in any order among themselves.  A text of any length is one record.
    An empty table gives an empty result.
    """
    spark = with_workers(pages.sparkSession)
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archives")
    pages = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long"), "url", "html")
    write_archives(plan_records(pages, least), path)
    index = scratch.keep(read_archives(spark, path, payload=False).drop("payload"), "index")
    return merge_index(index, scratch)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as a record, read back and merged; equal payloads of any length are stored once."""
    found = capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")
