"""Removal of word sequences that occur more than once, by FM-indexes over content-dealt shards.

Every window of ``window`` words belongs to the smallest hash among its ``GRAM``-word runs; equal
windows have equal smallest hashes.  Consecutive windows of one document with the same one form a
segment.  Only segments whose hash occurs more than once go on; equal segments travel once, with
their number.  Shards are dealt by that hash, so a shard holds all windows equal to any of its own:
its compressed FM-index, built over the shard's distinct segments, finds by backward search the
intervals of at least ``window`` words that occur twice.  Work and traffic grow with the input.

A smallest hash whose segments alone exceed a shard (a short passage in very many contexts) is split:
its windows become segments of one window each, only those that occur twice go on, and they are dealt
by their own hash, which equal windows share as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .fmindex import FMIndex
from .shared import Scratch, with_workers

GRAM = 8
#: Windows of one segment at most: a longer run of equal hashes (periodic text) is cut.
LONGEST = 256
#: Words of the distinct segments that one shard's index is planned for.
SHARD_WORDS = 600_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest hash, content hash, first word, number of words and places of that hash of every segment."""
    gram = min(GRAM, window)
    none = np.empty(0, np.int64)
    if len(h) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    g = T.grams(h, gram)
    low = _sliding_min(g, window - gram + 1)
    n = len(low)
    # windows that lie in one row: their row's end is at least `window` words away
    row_end = np.repeat(first[1:], np.diff(first))[:n] if len(first) > 1 else np.full(n, len(h))
    valid = np.flatnonzero(np.arange(n) + window <= row_end)
    if not len(valid):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    row = np.searchsorted(first, valid, side="right")
    cut = np.concatenate(([True], (np.diff(valid) != 1) | (low[valid][1:] != low[valid][:-1]) | (np.diff(row) != 0)))
    at = np.arange(len(valid))
    since = at - np.maximum.accumulate(np.where(cut, at, 0))
    cut |= since % LONGEST == 0
    starts = np.flatnonzero(cut)
    many = np.diff(np.concatenate((starts, [len(valid)])))
    start = valid[starts]
    size = many + window - 1
    key = T.run_hashes(h, start, size)
    return low[start], key, start, size, _places(g, low, valid, start, size - gram, window - gram + 1)


def _places(g: np.ndarray, low: np.ndarray, valid: np.ndarray, start: np.ndarray, reach: np.ndarray, width: int) -> np.ndarray:
    """How often each segment holds its smallest hash: windows of one segment can be equal only if twice."""
    padded = np.zeros(len(g) + width - 1, np.uint64)
    padded[valid + width - 1] = low[valid]
    top = ~_sliding_min(~padded, width)  # the largest minimum of the windows over each place
    at = np.flatnonzero(g == top)
    a, b = np.searchsorted(at, start), np.searchsorted(at, start + reach, side="right")
    many = b - a
    owner = np.repeat(np.arange(len(start)), many)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
    return np.bincount(owner[g[at[inner]] == low[start][owner]], minlength=len(start))


def _joined(data: np.ndarray, ws: np.ndarray, we: np.ndarray, first: np.ndarray) -> list[str]:
    """SHA-256 of every row's words joined by one space."""
    n = len(data)
    cover = np.zeros(n + 2, np.int8)
    np.add.at(cover, ws, 1)
    np.add.at(cover, we, -1)
    solid = np.cumsum(cover[: n + 1]).astype(bool)
    # one separator byte after each word but the last of a row: where a word ends, its space byte is kept
    sep = np.zeros(n + 1, bool)
    sep[we] = True
    if len(first) > 1:
        last = first[1:][np.diff(first) > 0] - 1
        sep[we[last]] = False
    out = data.copy()
    take = solid[:n] | sep[:n]
    out[sep[:n] & ~solid[:n]] = 32
    where = np.concatenate(([0], np.cumsum(take)))
    packed = out[take].tobytes()
    res = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        res.append(hashlib.sha256(packed[where[ws[a]] : where[we[b - 1]]] if b > a else b"").hexdigest())
    return res


def scan(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, sha (of all words), segs: the segments of every document."""
    seg = pa.struct([("m", pa.int64()), ("k", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("places", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in T.pieces(*T.column(batch.column(1))):
                ws, we, first = T.words(data, off)
                h = T.word_hashes(data, ws, we)
                low, key, start, size, places = segments(h, first, window)
                row = np.searchsorted(first, start, side="right") - 1
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                small = [pa.array(x.astype(np.int32)) for x in (start - first[row], size, places)]
                items = pa.StructArray.from_arrays([pa.array(T.signed(low)), pa.array(T.signed(key)), *small], fields=list(seg))
                columns = [ids.slice(i, j - i), pa.array(np.diff(first)), pa.array(_joined(data, ws, we, first)), pa.ListArray.from_arrays(pa.array(ends), items)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "sha", "segs"])

    return docs.mapInArrow(T.tidy(run), "doc_id long, n_words long, sha string, segs array<struct<m:long,k:long,start:int,len:int,places:int>>")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data, off = T.column(batch.column(1))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "packed"])

    return docs.mapInArrow(T.tidy(run), "doc_id long, packed binary")


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(x) for x in col.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _single_windows(wanted: DataFrame, window: int) -> DataFrame:
    """doc_id, m, k (hash of the window's words), start: every window of the given segments on its own.

    Rows of doc_id, packed, segs (m, start, len).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids, segs = batch.column(0).to_numpy(), batch.column(2).to_pylist()
                for i, j, part, poff in T.pieces(*_unpacked(batch.column(1))):
                    ws, we, first = T.words(part, poff)
                    h = T.word_hashes(part, ws, we)
                    of = [(r, s) for r in range(j - i) for s in segs[i + r]]
                    many = np.array([s["len"] - window + 1 for _, s in of])
                    begin = np.repeat([s["start"] for _, s in of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    row = np.repeat([r for r, _ in of], many)
                    k = T.run_hashes(h, first[row] + begin, np.full(len(row), window))
                    m = np.repeat(np.array([s["m"] for _, s in of], np.int64), many)
                    columns = [pa.array(ids[i + row]), pa.array(m), pa.array(T.signed(k)), pa.array(begin.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "m", "k", "start"])

    return wanted.mapInArrow(T.tidy(run), "doc_id long, m long, k long, start int")


def _fetch(wanted: DataFrame) -> DataFrame:
    """m, k, shard, mult, words of the wanted segments: rows of doc_id, packed, segs."""
    names = ["m", "k", "shard", "mult", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                data, off = _unpacked(batch.column(1))
                segs = batch.column(2).to_pylist()
                for i, j, part, poff in T.pieces(data, off):
                    ws, we, first = T.words(part, poff)
                    h = T.signed(T.word_hashes(part, ws, we))
                    rows = [(s["m"], s["k"], s["shard"], s["mult"], first[r] + s["start"], s["len"]) for r, of in enumerate(segs[i:j]) for s in of]
                    if not rows:
                        continue
                    m, k, shard, mult, start, size = zip(*rows, strict=True)
                    flat = np.concatenate([h[a : a + b] for a, b in zip(start, size, strict=True)])
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(k, pa.int64()), pa.array(shard, pa.int32()), pa.array(mult, pa.int64()), lists], names)

    return wanted.mapInArrow(T.tidy(run), "m long, k long, shard int, mult long, words array<long>")


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard: its index, and the repeated intervals of its segments."""
        words = table.column("words").combine_chunks()
        off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        flat = words.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        _, ids = np.unique(flat, return_inverse=True)
        index = FMIndex(ids.astype(np.int32) + 1, np.diff(off).astype(np.int64), table.column("mult").to_numpy())
        seq, start, end = index.repeated(window)
        by = np.argsort(seq, kind="stable")
        seq, start, end = seq[by], start[by], end[by]
        has, at = np.unique(seq, return_index=True)
        spans = np.stack((start, end), 1).astype(np.int32).ravel()
        ends = np.concatenate((at * 2, [len(spans)])).astype(np.int32)
        m, k = (pa.array(table.column(c).to_numpy()[has], pa.int64()) for c in ("m", "k"))
        return pa.table({"m": m, "k": k, "spans": pa.ListArray.from_arrays(pa.array(ends), pa.array(spans))})

    return run


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    """Words of one document that lie in a repeated interval."""
    cover = np.zeros(n + 1, np.int64)
    for s in spans:
        at = np.asarray(s["spans"]) + s["start"]
        np.add.at(cover, at[::2], 1)
        np.add.at(cover, at[1::2], -1)
    return np.cumsum(cover[:n]) > 0


def _removed(marked: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_removed, kept_sha256 (and text) of rows with doc_id, packed, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                data, off = _unpacked(batch.column(1))
                spans = batch.column(2).to_pylist()
                gone, sha, text = [], [], []
                for i, j, part, poff in T.pieces(data, off):
                    ws, we, first = T.words(part, poff)
                    raw = part.tobytes()
                    for r in range(j - i):
                        a, b = first[r], first[r + 1]
                        keep = ~_covered(b - a, spans[i + r])
                        kept = b" ".join(raw[x:y] for x, y in zip(ws[a:b][keep].tolist(), we[a:b][keep].tolist(), strict=True))
                        gone.append(int(b - a - keep.sum()))
                        sha.append(hashlib.sha256(kept).hexdigest())
                        text.append(kept.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(sha), pa.array(text, pa.string())], ["doc_id", "n_removed", "kept_sha256", "kept_text"])

    return marked.mapInArrow(T.tidy(run), "doc_id long, n_removed long, kept_sha256 string, kept_text string")


def _distinct(runs: DataFrame) -> DataFrame:
    """m, k, mult, doc_id, start, len: equal segments once, with their number and one place of theirs."""
    place = F.min(F.struct("doc_id", "start")).alias("place")
    return runs.groupBy("m", "k").agg(F.count("*").alias("mult"), place, F.max("len").alias("len")).select("m", "k", "mult", "place.doc_id", "place.start", "len")


def substring_dedup(docs: DataFrame, *, window: int = 50, with_text: bool = True, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words which also starts elsewhere.

    ``docs`` needs ``doc_id`` (unique, integer) and ``text``; more columns are ignored.  Returns
    ``doc_id, n_words, n_removed, kept_sha256`` and, with ``with_text``, ``kept_text``: the kept words
    joined by one space (null where nothing was removed).  All occurrences go, the first included.
    Null, empty and short texts have no window and lose nothing; equal texts of at least one window
    lose all words.  A text of any length is one row's work.  An empty table gives an empty result.  Rows
    with a null doc_id take no part.
    """
    spark = with_workers(docs.sparkSession)
    scratch = Scratch(spark, "substring")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    scanned = scratch.keep(scan(docs, window), "scan")
    runs = scanned.select("doc_id", F.inline("segs"))
    twice = runs.groupBy("m").agg(F.sum("places").alias("many")).where("many > 1").select("m")
    runs = scratch.keep(runs.drop("places").join(twice, "m"), "runs")
    distinct = scratch.keep(_distinct(runs), "distinct")
    # a smallest hash with very many contexts would be one shard's work: its windows are dealt one by one
    loads = distinct.groupBy("m").agg(F.sum("len").alias("words")).where(F.col("words") > shard_words)
    hot = scratch.keep(loads.select("m"), "hot")
    if not hot.isEmpty():
        segs = runs.join(hot, "m", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("m", "start", "len")).alias("segs"))
        single = scratch.keep(_single_windows(_packed(docs).join(segs, "doc_id").select("doc_id", "packed", "segs"), window), "single")
        again = single.groupBy("m", "k").agg(F.count("*").alias("many")).where("many > 1").select("m", "k")
        single = scratch.keep(single.join(again, ["m", "k"]).select("doc_id", "m", "k", "start", F.lit(window).alias("len")), "windows")
        runs = runs.join(hot, "m", "left_anti").select("doc_id", "m", "k", "start", "len").unionByName(single)
        rest = distinct.join(hot, "m", "left_anti").withColumn("deal", F.col("m"))
        distinct = rest.unionByName(_distinct(single).withColumn("deal", F.xxhash64("m", "k")))
        distinct = scratch.keep(distinct, "dealt")
    else:
        distinct = distinct.withColumn("deal", F.col("m"))
    total = distinct.agg(F.sum("len")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    spread = distinct.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("int"))
    places = spread.groupBy("doc_id").agg(F.collect_list(F.struct("m", "k", "shard", "mult", "start", "len")).alias("segs"))
    wanted = _packed(docs).join(places, "doc_id").select("doc_id", "packed", "segs")
    spans = _fetch(wanted).groupBy("shard").applyInArrow(_search(window), "m long, k long, spans array<int>")
    spans = scratch.keep(spans, "spans")
    marks = runs.join(spans, ["m", "k"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "spans")).alias("spans"))
    changed = _removed(_packed(docs).join(marks, "doc_id").select("doc_id", "packed", "spans"), with_text)
    out = scanned.select("doc_id", "n_words", "sha").join(changed, "doc_id", "left")
    removed = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
    out = out.select("doc_id", "n_words", removed, F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")
    return out if with_text else out.drop("kept_text")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 35 words over all documents."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35, with_text=False)
