"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch.  A document is the set of its distinct word shingles, as 64-bit hashes.  Up to
``2 t`` rounds throw every element into ``t`` bins: in the first ``t`` rounds into a hashed
bin, in round ``t + b`` into bin ``b``.  A bin keeps the smallest (round, hash value), and the
rounds end once every bin is full, so every coordinate is filled after 2 t rounds at the latest,
and a coordinate of two sketches agrees with the probability of the sets' similarity, with the
concentration of sampling without replacement.

Candidates.  ``bands`` groups of ``rows`` coordinates; their number follows from the threshold
so that a pair at the threshold is missed with a probability of at most ``miss``.

Work per group.  Equal sets become one class before any banding.  Every bucket compares its
members with its smallest one, the pivot (as many pairs as rows).  Links found there give
components; only pivots whose members are still in several components get more pairs, see
``Across``.  No candidate is dropped that could be a link, and every link is confirmed on the
full sets: 64-bit hashes of shingles, which two sets of m elements share by chance with a probability
of m^2 / 2^64, whatever their words (see ``tokens.word_hashes``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .shared import Scratch, connected_components, with_workers

ROWS = 6
MISS = 1e-8
_FULL = np.uint64(2**64 - 1)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(texts: pa.Array, width: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row (uint64); empty without words."""
    for _, _, data, off in T.pieces(*T.column(texts)):
        if lower:
            data = T.lowered(data)
        ws, we, first = T.words(data, off)
        h = T.word_hashes(data, ws, we)
        g = T.grams(h, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(g[a : b - width + 1])
            elif b > a:
                yield T.grams(h[a:b], b - a)
            else:
                yield g[:0]


def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch with ``t`` coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(t, _FULL)
    i, want = 0, int(t * (math.log(t) + 1))
    while i < 2 * t:
        k = max(1, min(2 * t - i, want // len(x)))
        rounds = np.arange(i, i + k, dtype=np.uint64)
        h = T.mix(x[None, :] ^ T.mix(rounds + np.uint64(1))[:, None])
        where = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        if i + k > t:
            late = np.arange(max(i, t), i + k)
            where[late - i] = (late - t)[:, None]
        value = (h & np.uint64(0xFFFFFFFF)) | (rounds << np.uint64(32))[:, None]
        np.minimum.at(out, where.ravel(), value.ravel())
        if (out != _FULL).all():
            break
        i, want = i + k, t
    return out


def _band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sk[: bands * rows].reshape(bands, rows)
    key = T.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
    return key


def signatures(docs: DataFrame, width: int, lower: bool, bands: int, rows: int, least: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (hashes of the set), bands (empty if no other set can be linked)."""
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for x in shingle_sets(batch.column(1), width, lower):
                n.append(len(x))
                k1.append(int(T.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                k2.append(int(T.mix(x + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))
                keys.append(T.signed(_band_keys(sketch(x, t), bands, rows)) if len(x) >= least else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            numbers = [pa.array(x, pa.int64()) for x in (n, k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, lists], ["doc_id", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(T.tidy(run), "doc_id long, n long, k1 long, k2 long, bands array<long>")


def sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """id, set: the distinct shingle hashes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # the sets of a few rows at a time
                batch = whole.slice(at, 256)
                found = list(shingle_sets(batch.column(1), width, lower))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = pa.array(T.signed(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "set"])

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(T.tidy(run), "id long, set array<long>")


#: Members of a pivot up to which its pairs are listed as they are; the pairs found are the same either way.
FEW = 16
#: Members of a component that stand for it in the first round of pairs under one element.
DELEGATES = 64


def _twins(df: DataFrame, percent: int, *on: str) -> DataFrame:
    """Pairs of rows with equal ``on``, in different components, that their distances from the pivot allow."""
    other = df.select(*on, *(F.col(k).alias(f"{k}2") for k in df.columns if k not in on))
    near = F.abs(F.col("far") - F.col("far2")) * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)
    return df.join(other, list(on)).where("root < root2").where(near)


def _pair() -> tuple:
    return F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b")


class Across:
    """Pairs under a common pivot, in different components, that can be links.

    Let x and y be members of pivot c, and X and Y their symmetric differences from c, of sizes known
    from the first comparison.  A link means |x ^ y| <= B = (|x| + |y|) (1 - s) / (1 + s), and x ^ y = X ^ Y.
    So X and Y share (|X| + |Y| - B) / 2 elements or more; where that is not positive, both are linked
    with c already.  With the elements of X and Y in one order, rarest first, a shared one must be among
    the first (|X| - |Y| + B) / 2 + 1 of X and the first (|Y| - |X| + B) / 2 + 1 of Y.  Edits of one
    text's own stand first there and are shared by nobody, so a large group of variants gives few pairs.
    Pivots with few members skip this and list the pairs that sizes and distances allow.

    Two large components under one element would give the product of their sizes, though one link
    makes them one.  So pairs come in rounds: in each, a component is stood for by its first members
    under an element, 64 times as many as in the round before, and components are joined before the next.
    The last round has them all, so no pair of different components is left out.
    """

    def __init__(self, star: DataFrame, labels: DataFrame, buckets: DataFrame, stored: DataFrame, percent: int, scratch: Scratch):
        self.percent, self.scratch, self.done = percent, scratch, star.select("a", "b")
        sizes = buckets.select(F.col("id").alias("x"), "n").distinct()
        of = star.select(F.col("a").alias("c"), F.col("b").alias("x"), (F.col("uni") - F.col("inter")).alias("far")).join(sizes, "x")
        of = self._rooted(of, labels)
        mixed = of.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
        mixed = scratch.keep(mixed.select("c", "many"), "mixed")  # read anew, so that the join below can split a large pivot
        of = scratch.keep(of.join(mixed, "c"), "members")
        self.few = of.where(F.col("many") <= FEW).drop("many")

        many = of.where(F.col("many") > FEW).drop("many")
        own, pivots = stored.select(F.col("id").alias("x"), "set"), stored.select(F.col("id").alias("c"), F.col("set").alias("base"))
        differ = F.concat(F.array_except("set", "base"), F.array_except("base", "set"))
        parts = many.join(own, "x").join(pivots, "c").select("c", "x", "n", "far", "root", F.explode(differ).alias("e"))
        parts = scratch.keep(parts, "differences")
        shared = parts.groupBy("c", "e").agg(F.count("*").alias("df")).where("df > 1")
        parts = parts.join(shared, ["c", "e"])
        in_doc = Window.partitionBy("c", "x")
        place = F.row_number().over(in_doc.orderBy("df", "e")) + F.col("far") - F.count("*").over(in_doc)
        parts = parts.withColumn("place", place).where((F.col("place") - 1) * percent <= F.col("n") * (100 - percent)).drop("df")
        self.parts = scratch.keep(parts, "parts")

    @staticmethod
    def _rooted(df: DataFrame, labels: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("id", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))

    def _limited(self, parts: DataFrame, delegates: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of the first ``delegates`` members of every component; (c, e) of groups that have more members."""
        nth = F.row_number().over(Window.partitionBy("c", "e", "root").orderBy("x"))  # limited before the shuffle
        near = _twins(parts.withColumn("nth", nth).where(F.col("nth") <= delegates), self.percent, "c", "e")
        limit = (F.col("n") + F.col("n2")) * (100 - self.percent)  # B times 100 + percent
        ahead = (F.col("far") - F.col("far2")) * (100 + self.percent)
        places = [2 * (F.col(p) - 1) * (100 + self.percent) <= limit + d for p, d in (("place", ahead), ("place2", -ahead))]
        sizes = parts.groupBy("c", "e", "root").agg(F.count("*").alias("size"))
        crowded = sizes.groupBy("c", "e").agg(F.max("size").alias("top"), F.count("*").alias("roots")).where((F.col("top") > delegates) & (F.col("roots") > 1))
        return near.where(places[0] & places[1]).select(*_pair()), crowded.select("c", "e")

    def _new(self, pairs: DataFrame) -> DataFrame:
        found = self.scratch.keep(pairs.distinct().join(self.done, ["a", "b"], "left_anti"), "pairs")
        self.done = self.done.unionByName(found)
        return found

    def first(self, delegates: int) -> tuple[DataFrame, bool]:
        """New pairs (a, b), and whether groups are left that have more members than were paired."""
        pairs, crowded = self._limited(self.parts, delegates)
        found = self._new(pairs.unionByName(_twins(self.few, self.percent, "c").select(*_pair())))
        self.open = self.scratch.keep(self.parts.join(crowded, ["c", "e"], "left_semi").drop("root"), "open")
        return found, not self.open.isEmpty()

    def further(self, labels: DataFrame, delegates: int) -> tuple[DataFrame, bool]:
        """The same for the groups that were left, with the components that have been joined since."""
        rooted = self.scratch.keep(self._rooted(self.open, labels), "rooted")
        pairs, crowded = self._limited(rooted, delegates)
        return self._new(pairs), not crowded.isEmpty()


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, lower: bool = True, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs ``doc_id`` (unique, integer) and ``text``; more columns are ignored.  Returns
    ``doc_id, n_shingles, component_id, kept``: component_id is the smallest doc_id reachable over
    links, kept marks that document.  Null or empty text and text without words: an empty set, linked
    with nothing.  Fewer words than a shingle has: the whole sequence is the one shingle.  Equal
    texts are linked whatever their length.  A similarity of exactly the bound is a link.  An empty table
    gives an empty result.  Rows with a null doc_id take no part.
    """
    spark = with_workers(docs.sparkSession)
    scratch = Scratch(spark, "minhash")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    s = percent / 100
    # different sets with a union of m elements reach (m - 1) / m at most
    least = max(1, math.ceil(s / (1 - s) - 1e-9)) if percent < 100 else 1 << 62
    sig = scratch.keep(signatures(docs, words, lower, bands_for(s, rows, miss) if percent < 100 else 1, rows, least), "signatures")

    classes = sig.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    reps = sig.where(f"n >= {least}").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows_of = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    full = rows_of.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("many")).where("many > 1").select("key", "pivot")
    buckets = scratch.keep(rows_of.join(full, "key").select("key", "pivot", F.col("doc_id").alias("id"), "n"), "buckets")

    ids = buckets.select("id").distinct()
    texts = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    stored = scratch.keep(sets(texts, words, lower), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """a, b, inter, union of distinct pairs."""
        left = stored.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        right = stored.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        both = pairs.join(left, "a").join(right, "b")
        inter = F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("inter")
        both = both.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("total"), inter)
        return scratch.keep(both.select("a", "b", "inter", (F.col("total") - F.col("inter")).alias("uni")), name)

    linked = lambda df: df.where(f"100 * inter >= {percent} * uni")
    first = buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = verified(first, "star")
    links = linked(star).select("a", "b")
    labels = connected_components(links, scratch)

    across = Across(star, labels, buckets, stored, percent, scratch)
    size = DELEGATES
    rest, more = across.first(size)
    while True:
        new = linked(verified(rest, "rest")).select("a", "b")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = connected_components(links, scratch)
        if not more:
            break
        size *= 64
        rest, more = across.further(labels, size)
    scratch.drop(stored)
    scratch.drop(buckets)

    root = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("root"))
    out = sig.select("doc_id", "n", "k1", "k2").join(root, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles of lower-cased words, links from a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
