"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Documents and benchmark items are read as words without outer punctuation, ASCII letters lower-cased.
A number is a slot of type NUM, a unit after a number one of type UNIT, and a capitalised word that
starts no sentence one of type NAME.  Windows of ``words`` consecutive template words are joined by
hash; an item is found in a document if at least ``percent`` per cent of its windows are, and if its slots
are filled consistently: each value of the item stands for one value of the document, so that a
question with other names and numbers counts, and a chance mixture of templates does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .shared import Scratch, with_workers

UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz v w kw mw a ma j kj cal kcal "
    "n pa kpa bar c f k degree degrees percent % $ € £ usd eur gbp cent cents dollar dollars euro euros pound pounds mph kmh km/h m/s"
).split()
#: Bits of the map that tells which windows can be a benchmark's; its size is fixed.
MAP_BITS = 22

_EDGE = np.ones(256, bool)  # bytes that are cut off at a word's ends: ASCII that is neither letter nor digit
_EDGE[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _EDGE[_a:_b] = False
for _c in "%$/":
    _EDGE[ord(_c)] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
for _c in ".,:/-+%":
    _NUMERIC[ord(_c)] = True
_STOP = np.zeros(256, bool)
for _c in ".!?:;\"()":
    _STOP[ord(_c)] = True
NUM, UNIT, NAME = (np.uint64(x) for x in (0xA5A5F00D00000001, 0xA5A5F00D00000002, 0xA5A5F00D00000003))


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    data = np.frombuffer(raw, np.uint8)
    ws, we, _ = T.words(data, np.array([0, len(raw)]))
    return np.sort(T.word_hashes(data, ws, we))


def templates(data: np.ndarray, off: np.ndarray, inserted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value hash and slot flag of every word, and the first word of each row.

    ``inserted``: read every row as if it followed other words, so that its first word starts no sentence.
    """
    ws, we, first = T.words(data, off)
    n = len(data)
    if not len(ws):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), first
    s, e = ws.copy(), we.copy()
    while True:
        cut = (s < e) & _EDGE[data[np.minimum(s, n - 1)]]
        if not cut.any():
            break
        s[cut] += 1
    while True:
        cut = (s < e) & _EDGE[data[e - 1]]
        if not cut.any():
            break
        e[cut] -= 1
    blank = s >= e
    value = T.word_hashes(T.lowered(data), s, np.maximum(s, e))
    count = lambda flag: np.concatenate(([0], np.cumsum(flag[data])))
    digits, numeric = count(_DIGIT), count(_NUMERIC)
    hi = np.maximum(s, e)
    number = ~blank & (digits[hi] > digits[s]) & (numeric[hi] - numeric[s] == hi - s)
    head = data[np.minimum(s, n - 1)]
    after = data[np.minimum(s + 1, n - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    # a sentence starts after a stop, after an empty line end, and with the row
    starts = np.ones(len(ws), bool)
    starts[1:] = _STOP[data[we[:-1] - 1]]
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    starts[1:] |= lines[ws[1:]] > lines[we[:-1]]
    starts[first[:-1][first[:-1] < len(ws)]] = not inserted
    name = ~blank & capital & ~starts & (hi - s > 1) & ~number
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    unit = np.zeros(len(ws), bool)
    unit[1:] = (units[at][1:] == value[1:]) & number[:-1]
    unit[first[:-1][first[:-1] < len(ws)]] = False
    unit &= ~number
    name &= ~unit
    shape = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, value)))
    return shape, value, number | unit | name, first


def _windows(shape: np.ndarray, slot: np.ndarray, first: np.ndarray, words: int, literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every window with ``literal`` words or more that are no slots."""
    none = np.empty(0, np.int64)
    if len(shape) < words:
        return none.view(np.uint64), none, none
    g = T.grams(shape, words)
    free = np.concatenate(([0], np.cumsum(~slot)))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero((row[: len(g)] == row[words - 1 :]) & (free[words:] - free[:-words] >= literal))
    return g[at], at, row[at]


def windows(texts: DataFrame, words: int, literal: int, bitmap=None, inserted: bool = False) -> DataFrame:
    """id, at, h, slots (the values of its slots, in order): windows of all rows, at their first words.

    With ``bitmap`` (a broadcast of bits) only those whose bit is set: all that can match stay.
    """
    slots_type = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in T.pieces(*T.column(batch.column(1))):
                shape, value, slot, first = templates(data, off, inserted)
                h, at, row = _windows(shape, slot, first, words, literal)
                if bitmap is not None and len(h):
                    bit = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    hit = (bitmap.value[bit >> 3] >> (bit & 7)) & 1 == 1
                    h, at, row = h[hit], at[hit], row[hit]
                held = at[:, None] + np.arange(words)
                is_slot = slot[held] if len(at) else np.zeros((0, words), bool)
                values = T.signed(value)[held[is_slot]] if len(at) else np.empty(0, np.int64)
                ends = np.concatenate(([0], np.cumsum(is_slot.sum(1)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())).cast(slots_type)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(row)), pa.array(at - first[row]), pa.array(T.signed(h)), lists], ["id", "at", "h", "slots"])

    return texts.mapInArrow(T.tidy(run), "id long, at long, h long, slots array<long>")


#: Kinds of windows in ``features``; from VERBATIM on the kind tells how many words the run has.
TYPED, FOLDED, VERBATIM = 0, 1, 2
_KIND = 0x9E6C63D0876A9A47


def features(texts: DataFrame, words: int, literal: int, runs: list[int], bitmap=None, inserted: bool = False, whole: bool = False) -> DataFrame:
    """id, kind, at, h, slots: windows of three kinds, all to be joined by hash.

    TYPED are those of ``windows``; in FOLDED ones names are literals without case, only numbers and units are
    slots; VERBATIM + k are all runs of k words without case or outer punctuation, for every k of ``runs``.
    ``whole``: of ``runs`` only the longest a row has words for, as long as the row if it is shorter than all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in T.pieces(*T.column(batch.column(1))):
                shape, value, slot, first = templates(data, off, inserted)
                name = slot & (shape == NAME)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                parts = [(TYPED, slot, *_windows(shape, slot, first, words, literal))]
                if not inserted:  # neither of the others depends on where a sentence starts
                    folded = slot & ~name
                    parts.append((FOLDED, folded, *_windows(np.where(name, value, shape), folded, first, words, literal)))
                    size = np.diff(first)
                    for k in runs:
                        g = T.grams(value, k)
                        solid = np.concatenate(([0], np.cumsum(value != T.EMPTY)))
                        ok = (row[: len(g)] == row[k - 1 :]) & (solid[k:] > solid[:-k]) if len(g) else np.zeros(0, bool)
                        if whole and len(g):
                            ok &= (size[row[: len(g)]] == k) | ((size[row[: len(g)]] > k) & (k == max(runs)))
                        at = np.flatnonzero(ok)
                        parts.append((VERBATIM + k, None, g[at], at, row[at]))
                for kind, is_slot, h, at, of in parts:
                    if kind != TYPED:
                        h = T.mix(h + np.uint64(kind * _KIND % 2**64))
                    if bitmap is not None and len(h):
                        bit = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                        hit = (bitmap.value[bit >> 3] >> (bit & 7)) & 1 == 1
                        h, at, of = h[hit], at[hit], of[hit]
                    if is_slot is None or not len(at):
                        values, ends = np.empty(0, np.int64), np.zeros(len(at) + 1, np.int32)
                    else:
                        held = at[:, None] + np.arange(words)
                        values = T.signed(value)[held[is_slot[held]]]
                        ends = np.concatenate(([0], np.cumsum(is_slot[held].sum(1)))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(of)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at - first[of]), pa.array(T.signed(h)), lists], ["id", "kind", "at", "h", "slots"])

    return texts.mapInArrow(T.tidy(run), "id long, kind int, at long, h long, slots array<long>")


def _bitmap(items: DataFrame):
    """A broadcast of the bits of all window hashes: at most 2 ** MAP_BITS rows come to the driver, whatever the benchmark's size."""
    bits = items.select(F.shiftrightunsigned("h", 64 - MAP_BITS).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy(dtype=np.int64)
    have = np.zeros(1 << MAP_BITS, np.uint8)
    have[bits] = 1
    return items.sparkSession.sparkContext.broadcast(np.packbits(have, bitorder="little"))


def _agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys`` the share of slot fillings (asked to slots) in line with the most frequent one of the same value."""
    filled = pairs.select(*keys, F.explode(F.arrays_zip("asked", "slots")).alias("s")).select(*keys, "s.asked", F.col("s.slots").alias("given"))
    fills = filled.groupBy(*keys, "asked", "given").agg(F.count("*").alias("times"))
    best = fills.groupBy(*keys, "asked").agg(F.max("times").alias("top"), F.sum("times").alias("all"))
    return best.groupBy(*keys).agg((F.sum("top") / F.sum("all")).alias("slot_agreement"))


def _candidates(by_doc: DataFrame, items: DataFrame, percent: int, span: int | None = None) -> DataFrame:
    """doc_id, item_id: pairs that can reach ``percent`` of the item's places, or ``span`` of them on end.

    ``by_doc``: distinct (doc_id, h); ``items``: item_id, kind, at, h, all hashes of an item's places.  A pair
    that reaches ``percent`` of n places has one of the n - need + 1 rarest, and one with ``span`` places on end
    has the rarest of those.  Only these are joined, so what very many documents and items have in common
    gives no pairs.  Of other kinds than TYPED and FOLDED every place counts alone.
    """
    known = items.select("item_id", "kind", "at", "h").distinct()
    in_docs = by_doc.groupBy("h").agg(F.count("*").alias("docs"))
    in_items = known.select("item_id", "h").distinct().groupBy("h").agg(F.count("*").alias("items"))
    cost = in_docs.join(in_items, "h").select("h", (F.col("docs") * F.col("items")).alias("cost"))
    places = known.join(cost, "h", "left").groupBy("item_id", "kind", "at").agg(F.sum(F.coalesce("cost", F.lit(0))).alias("cost"))
    of_item = Window.partitionBy("item_id", "kind")
    windows_ = F.col("kind") < VERBATIM
    nth, many = F.row_number().over(of_item.orderBy("cost", "at")), F.count("*").over(of_item)
    rare = nth <= many - F.ceil(many * percent / 100) + 1
    ranked = places.withColumn("rare", rare).withColumn("piece", F.col("at") - F.row_number().over(of_item.orderBy("at")))
    taken = ranked.where(~windows_ | F.col("rare")).select("item_id", "kind", "at")
    if span:
        ahead = Window.partitionBy("item_id", "kind", "piece").orderBy("at").rowsBetween(0, span - 1)
        least = ranked.where(windows_).select("item_id", "kind", F.min(F.struct("cost", "at")).over(ahead).alias("least"), F.count("*").over(ahead).alias("length"))
        taken = taken.unionByName(least.where(f"length = {span}").select("item_id", "kind", "least.at")).distinct()
    probes = known.join(taken, ["item_id", "kind", "at"]).select("item_id", "h").distinct()
    return by_doc.join(probes, "h").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, *, words: int = 5, percent: int = 80, literal: int = 2, consistent: int = 80) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, perhaps with other slot values.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``; more columns are ignored.
    Returns ``doc_id, item_id, n_windows`` (windows of the item), ``n_found`` (of them in the
    document), ``slot_agreement`` (share of slot fillings in line with the most frequent one of the same
    value, 1 without slots).  Windows with fewer than ``literal`` words that are no slots don't count;
    items without a window (null, empty or of fewer than ``words`` words) are never found.  Items of the same
    windows are compared once and reported for the smallest item_id.  Empty tables give an empty result.
    """
    spark = with_workers(docs.sparkSession)
    scratch = Scratch(spark, "decontaminate")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    asked = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), "text")
    # an item's first word starts a sentence in the benchmark, but perhaps not in a document
    items = windows(asked, words, literal).unionByName(windows(asked, words, literal, inserted=True)).distinct()
    items = scratch.keep(items.withColumnRenamed("id", "item_id"), "items")
    # items of equal windows are one
    marks = items.select("item_id", "at", "h").distinct().groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"), F.sum(F.xxhash64("at", "h").cast("decimal(38,0)")).alias("mark"))
    sizes = scratch.keep(marks.groupBy("n_windows", "mark").agg(F.min("item_id").alias("item_id")).select("item_id", "n_windows"), "sizes")
    items = items.join(sizes, "item_id")
    bitmap = _bitmap(items)
    seen = scratch.keep(windows(texts, words, literal, bitmap).withColumnRenamed("id", "doc_id"), "seen")
    by_doc = scratch.keep(seen.select("doc_id", "h").distinct(), "by_doc")
    near = _candidates(by_doc, items.withColumn("kind", F.lit(TYPED)), percent)
    hits = near.join(items.select("item_id", "at", "h", "n_windows").distinct(), "item_id").join(by_doc, ["doc_id", "h"])
    found = hits.groupBy("doc_id", "item_id", "n_windows").agg(F.countDistinct("at").alias("n_found"))
    found = scratch.keep(found.where(f"n_found * 100 >= n_windows * {percent}"), "found")

    # slot values of the item against those of the document, window by window
    here = seen.where("size(slots) > 0").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    asked_of = items.where("size(slots) > 0").select("item_id", "h", F.col("slots").alias("asked")).distinct()
    pairs = found.select("doc_id", "item_id").join(asked_of, "item_id").join(here, ["doc_id", "h"])
    agree = _agreement(pairs, "doc_id", "item_id")
    out = found.join(agree, ["doc_id", "item_id"], "left").withColumn("slot_agreement", F.coalesce("slot_agreement", F.lit(1.0)))
    return out.where(F.col("slot_agreement") * 100 >= consistent).select("doc_id", "item_id", "n_windows", "n_found", "slot_agreement")


def leaks(docs: DataFrame, benchmark: DataFrame, *, words: int = 5, percent: int = 80, literal: int = 2, consistent: int = 80, run: int = 13) -> DataFrame:
    """Like ``contaminated``, but finds occurrences and parts of items too.

    An occurrence is all windows at one distance between their places in the document and in the item.  An item is
    found in a document if one of these holds for its typed or its folded windows (see ``features``):

    - ``percent`` per cent of its windows are in the document, and the slots of all of them agree,
    - one occurrence has as many windows, and its slots agree,
    - consecutive windows of one occurrence hold ``run`` words or more, and their slots agree,

    or if ``run`` consecutive words of it (all, if it has fewer) are in the document, without regard to case and
    outer punctuation.  ``n_windows`` and ``n_found`` count typed windows (0 for an item without any);
    ``slot_agreement`` is the best of these, 1 for words found verbatim; shares equal to a bound count.  Every item
    that is found is reported, equal ones too.  Rows that repeat a doc_id are read as one document with the
    windows of all.  Null, empty and very long texts, empty tables and more columns are as in ``contaminated``.
    """
    spark = with_workers(docs.sparkSession)
    scratch = Scratch(spark, "leaks")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    asked = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), "text")
    every = list(range(1, run + 1))
    items = features(asked, words, literal, every, whole=True).unionByName(features(asked, words, literal, [], inserted=True)).distinct()
    items = scratch.keep(items.select(F.col("id").alias("item_id"), "kind", "at", "h", F.col("slots").alias("asked")), "items")
    # items of equal windows and values are compared once
    marks = items.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("kind", "at", "h", "asked").cast("decimal(38,0)")).alias("mark"))
    members = scratch.keep(marks.select("item_id", F.min("item_id").over(Window.partitionBy("n", "mark")).alias("as_item")), "members")
    items = items.join(members.where("item_id = as_item").select("item_id"), "item_id")
    places = items.select("item_id", "kind", "at").distinct()
    sizes = scratch.keep(places.groupBy("item_id").agg(F.count(F.when(F.col("kind") == TYPED, 1)).alias("typed"), F.count(F.when(F.col("kind") == FOLDED, 1)).alias("folded")), "sizes")
    runs = sorted(r.kind - VERBATIM for r in items.where(f"kind > {VERBATIM}").select("kind").distinct().collect())

    seen = features(texts, words, literal, runs, _bitmap(items)).select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "h", "slots")
    seen = scratch.keep(seen, "seen")
    by_doc = scratch.keep(seen.select("doc_id", "h").distinct(), "by_doc")
    span = max(run - words + 1, 1)  # windows in a run
    near = scratch.keep(_candidates(by_doc, items, percent, span), "near")
    hits = near.join(items.select("item_id", "kind", "at", "h").distinct(), "item_id").join(by_doc, ["doc_id", "h"])
    hits = hits.select("doc_id", "item_id", "kind", "at").distinct()
    many = {name: F.count(F.when(F.col("kind") == kind, 1)) for name, kind in (("n_typed", TYPED), ("n_folded", FOLDED))}
    counts = hits.groupBy("doc_id", "item_id").agg(*(c.alias(n) for n, c in many.items()), F.max(F.col("kind") > VERBATIM).alias("verbatim"))
    enough = " OR ".join(f"(n_{x} > 0 AND (n_{x} * 100 >= {x} * {percent} OR n_{x} >= {span}))" for x in ("typed", "folded"))
    found = scratch.keep(counts.join(sizes, "item_id").where(f"verbatim OR {enough}"), "found")

    # slot values of the item against those of the document; what is found verbatim needs no comparison
    open_ = found.where("NOT verbatim").select("doc_id", "item_id", "typed", "folded", "n_typed", "n_folded")
    here = seen.join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
    # by pair first: a window that very many items share meets the items found in its document only
    pairs = open_.join(items.where(f"kind < {VERBATIM}"), "item_id").join(here, ["doc_id", "h"])
    size, n_found = (F.when(F.col("kind") == TYPED, F.col(a)).otherwise(F.col(b)) for a, b in (("typed", "folded"), ("n_typed", "n_folded")))
    shifted = (F.col("doc_at") - F.col("at")).alias("shift")
    pairs = pairs.select("doc_id", "item_id", "kind", "doc_at", "at", shifted, "asked", "slots", size.alias("size"), n_found.alias("n_found")).distinct()
    shift = Window.partitionBy("doc_id", "item_id", "kind", "shift")
    pairs = pairs.withColumn("n", F.count("*").over(shift)).withColumn("piece", F.col("at") - F.row_number().over(shift.orderBy("at")))
    pairs = scratch.keep(pairs.withColumn("length", F.count("*").over(Window.partitionBy("doc_id", "item_id", "kind", "shift", "piece"))), "pairs")

    def agreeing(rows: DataFrame, *keys: str) -> DataFrame:
        keys = ("doc_id", "item_id", "kind", *keys)
        # a group without slots agrees with itself
        shares = rows.select(*keys).distinct().join(_agreement(rows, *keys), list(keys), "left")
        return shares.select("doc_id", "item_id", F.coalesce("slot_agreement", F.lit(1.0)).alias("slot_agreement"))

    pooled = agreeing(pairs.where(f"n_found * 100 >= size * {percent}").select("doc_id", "item_id", "kind", "doc_at", "asked", "slots").distinct())
    alone = agreeing(pairs.where(f"n * 100 >= size * {percent}"), "shift")
    parts = agreeing(pairs.where(f"length >= {span}"), "shift", "piece")
    sure = found.where("verbatim").select("doc_id", "item_id", F.lit(1.0).alias("slot_agreement"))
    best = pooled.unionByName(alone).unionByName(parts).unionByName(sure).groupBy("doc_id", "item_id").agg(F.max("slot_agreement").alias("slot_agreement"))
    out = found.join(best.where(F.col("slot_agreement") * 100 >= consistent), ["doc_id", "item_id"])
    out = out.withColumnRenamed("item_id", "as_item").join(members, "as_item")
    return out.select("doc_id", "item_id", F.col("typed").alias("n_windows"), F.col("n_typed").alias("n_found"), "slot_agreement")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows with a null doc_id stay."""
    return docs.join(leaks(docs, benchmark, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: template windows of five words, 80 per cent of an item or 13 words on end."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
