"""Toxicity by a classifier chain of sparse linear models.

Features are the words of the whole text (ASCII lower case, outer punctuation cut) and their first four
and five bytes, present or not, hashed.  The categories are predicted in sequence: the model of a
later one also sees the logits of the earlier ones, which are out-of-fold predictions while it is
trained.  Training is one task over a bounded sample of labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .decontaminate import _EDGE
from .shared import Scratch, smallest_by_hash, with_workers

BITS = 20
#: Labelled rows of each class of the last category that training takes at most.
SAMPLE = 6000
#: Hashed features that a model may use.
CHOSEN = 6000
FOLDS = 4


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number (below ``2 ** BITS``) of every word and of its two prefixes."""
    ws, we, first = T.words(data, off)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(data)
    if not len(ws):
        return row, row
    s, e = ws.copy(), we.copy()
    while (cut := (s < e) & _EDGE[data[np.minimum(s, n - 1)]]).any():
        s[cut] += 1
    while (cut := (s < e) & _EDGE[data[e - 1]]).any():
        e[cut] -= 1
    keep = s < e
    s, e, row = s[keep], e[keep], row[keep]
    low = T.lowered(data)
    rows, found = [row], [T.word_hashes(low, s, e)]
    for size in (4, 5):
        long = e - s > size
        rows.append(row[long])
        found.append(T.mix(T.word_hashes(low, s[long], s[long] + size) + np.uint64(size)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


class Sparse:
    """Rows of present features, as sorted (row, column) pairs."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int):
        self.rows, self.cols, self.n, self.width = rows, cols, n, width

    def _sums(self, into: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for at in range(0, len(into), 1 << 20):  # a part at a time: no temporary of the whole length
            part = slice(at, at + (1 << 20))
            out += np.bincount(into[part], values[of[part]], size)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.rows, self.cols, w, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sums(self.cols, self.rows, g, self.width)

    def take(self, keep: np.ndarray) -> Sparse:
        new = np.cumsum(keep) - 1
        some = keep[self.rows]
        return Sparse(new[self.rows[some]], self.cols[some], int(keep.sum()), self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, *, ridge: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted logistic regression with a ridge term, by Adam: weights, weights of ``extra``, intercept."""
    w, v = np.zeros(x.width), np.zeros(extra.shape[1])
    total = weight.sum()
    p = np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)
    b = float(np.log(p / (1 - p)))
    m = [np.zeros_like(w), np.zeros_like(v), 0.0]
    s = [np.zeros_like(w), np.zeros_like(v), 0.0]
    for t in range(1, steps + 1):
        g = weight * (_sigmoid(x.times(w) + extra @ v + b) - y) / total
        rate = 0.1 if t < steps * 2 // 3 else 0.02
        for i, (value, grad) in enumerate(((w, x.back(g) + ridge * w), (v, extra.T @ g + ridge * v), (b, g.sum()))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad * grad
            step = rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
            if i == 2:
                b -= float(step)
            else:
                value -= step
    return w, v, b


def _select(x: Sparse, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The features whose presence differs most between the classes, in units of its deviation.

    Rows of weight zero count nothing.
    """
    on, every, seen = x.back(weight * y), x.back(weight), x.back((weight > 0).astype(float))
    p = (weight * y).sum() / weight.sum()
    z = np.where(seen >= 4, np.abs(on - every * p) / np.sqrt(every * p * (1 - p) + 1.0), 0)
    best = np.argsort(-z, kind="stable")[:CHOSEN]
    return np.sort(best[z[best] > 1.5])


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability with the largest F1 on out-of-fold predictions, in the middle of its gap."""
    by = np.argsort(-p, kind="stable")
    hit, miss = np.cumsum((weight * y)[by]), np.cumsum((weight * (1 - y))[by])
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    i = int(f1.argmax())
    below = p[by[i + 1]] if i + 1 < len(p) else 0.0
    return float((p[by[i]] + below) / 2)


def train(ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[dict]:
    """One model per column of ``labels`` (0/1), in the order of the chain."""
    n = len(ids)
    fold = (T.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    extra = np.empty((n, 0))
    chain = []
    for y in labels.T.astype(float):
        if n < 2 * FOLDS or y.min() == y.max():  # nothing to tell apart: the prior for all
            p = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
            nothing = {"chosen": np.empty(0, np.int64), "w": np.empty(0), "v": np.zeros(extra.shape[1])}
            chain.append(nothing | {"b": float(np.log(p / (1 - p))), "threshold": 0.5})
            extra = np.column_stack((extra, np.zeros(n)))
            continue
        whole = Sparse(rows, cols, n, 1 << BITS)
        logit = np.zeros(n)

        def model(keep: np.ndarray, whole=whole, y=y, extra=extra) -> tuple[np.ndarray, Sparse, np.ndarray, np.ndarray, float]:
            chosen = _select(whole, y, weight * keep)
            where = np.full(1 << BITS, -1, np.int32)
            where[chosen] = np.arange(len(chosen))
            some = (where >= 0)[cols]
            small = Sparse(rows[some].astype(np.int64), where[cols[some]].astype(np.int64), n, max(1, len(chosen)))
            return chosen, small, *fit(small.take(keep), extra[keep], y[keep], weight[keep])

        for k in range(FOLDS):
            out = fold == k
            if not out.any() or y[~out].min() == y[~out].max():
                continue
            _, small, w, v, b = model(~out)
            logit[out] = (small.times(w) + extra @ v + b)[out]
        chosen, small, w, v, b = model(np.ones(n, bool))
        chain.append({"chosen": chosen, "w": w[: len(chosen)], "v": v, "b": b, "threshold": _threshold(_sigmoid(logit), y, weight)})
        extra = np.column_stack((extra, np.clip(logit, -10, 10)))
    return chain


def sampled(labels: DataFrame, categories: dict[str, Column], sample: int) -> DataFrame:
    """doc_id, y0.. (0/1 per category), weight: at most ``sample`` rows of each class of the last category.

    Of several labels of one document the largest counts; rows with a null label take no part.
    """
    ys = [c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]
    rows = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), *ys).dropna()
    rows = rows.groupBy("doc_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(ys))))
    last = f"y{len(ys) - 1}"
    many = {r[0]: r[1] for r in rows.groupBy(last).count().collect()}  # two classes
    parts = []
    for value in (0, 1):
        total = many.get(value, 0)
        weight = F.lit(max(1.0, total / sample)).alias("weight")
        parts.append(smallest_by_hash(rows.where(F.col(last) == value), total, sample).select("*", weight))
    return parts[0].unionByName(parts[1])


def fitted(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, sample: int = SAMPLE) -> list[dict]:
    """The trained chain.  The sample is bounded, and so are the models that come back."""
    spark = with_workers(docs.sparkSession)
    chosen = Scratch(spark, "toxicity").keep(sampled(labels, categories, sample), "sample")
    many = len(categories)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    ys = [f"y{i}" for i in range(many)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in T.pieces(*T.column(batch.column(1))):
                pair = np.unique(np.stack(features(data, off)), axis=1) if len(data) else np.empty((2, 0), np.int64)
                ends = np.searchsorted(pair[0], np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pair[1].astype(np.int32)))
                rest = [batch.column(c).slice(i, j - i) for c in (0, *range(2, many + 3))]
                yield pa.RecordBatch.from_arrays([*rest, lists], ["doc_id", *ys, "weight", "cols"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        cols = table.column("cols").combine_chunks()
        size = np.diff(np.frombuffer(cols.buffers()[1], np.int32)[cols.offset : cols.offset + len(cols) + 1])
        row, col = np.repeat(np.arange(len(size), dtype=np.int32), size), cols.flatten().to_numpy()
        truth = np.column_stack([table.column(y).to_numpy() for y in ys])
        chain = train(table.column("doc_id").to_numpy(), row, col, truth, table.column("weight").to_numpy())
        del table, cols, row, col
        T.release()
        return pa.table({"model": pa.array([pickle.dumps(chain)], pa.binary())})

    made = rows.select("doc_id", "text", *ys, "weight").mapInArrow(T.tidy(hashed), f"doc_id long, {', '.join(f'{y} int' for y in ys)}, weight double, cols array<int>")
    got = made.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "model binary").collect()
    if got:
        return pickle.loads(got[0]["model"])
    return train(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, many)), np.empty(0))


def scored(docs: DataFrame, chain: list[dict], names: list[str]) -> DataFrame:
    """All columns, p_<category> for every category, and is_<category>: p at or above the model's threshold."""
    spark = with_workers(docs.sparkSession)
    added = [x for k in names for x in (f"p_{k}", f"is_{k}")]
    docs = docs.drop(*added)
    text = docs.columns.index("text")
    tables = []
    for m in chain:
        table = np.zeros(1 << BITS, np.float32)
        table[m["chosen"]] = m["w"]
        tables.append(table)
    shared = spark.sparkContext.broadcast((np.stack(tables), [(m["v"], m["b"], m["threshold"]) for m in chain]))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rest = shared.value
        used = (weights != 0).any(0)
        for batch in batches:
            for i, j, data, off in T.pieces(*T.column(batch.column(text))):
                n = j - i
                row, col = features(data, off)
                some = used[col]
                key = np.unique(row[some] << BITS | col[some])
                row, col = key >> BITS, key & ((1 << BITS) - 1)
                extra, out = np.empty((n, 0)), []
                for w, (v, b, cut) in zip(weights, rest, strict=True):
                    z = np.bincount(row, w[col], n) + extra @ v + b
                    extra = np.column_stack((extra, np.clip(z, -10, 10)))
                    p = _sigmoid(z)
                    out += [pa.array(p), pa.array(p >= cut)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, n).columns, *out], [*batch.schema.names, *added])

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"p_{k} double, is_{k} boolean" for k in names)]
    return docs.mapInArrow(T.tidy(run), ", ".join(kinds))


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, *, sample: int = SAMPLE) -> DataFrame:
    """Probability and decision of every category for every document.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and what ``categories`` (name to a boolean
    or 0/1 column, in the order of the chain) refer to; more columns are ignored.  Null and empty texts have
    no features and get the intercepts; without labels all get p = 0.001 and no decision.  Rows with a null
    doc_id are scored too.  Rows that repeat a doc_id are each scored, and each learned from if the id is
    in the sample.  A text of any length is scored whole; a probability equal to the threshold decides for
    the category.  An empty table gives an empty result.
    """
    categories = categories or {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, fitted(docs, labels, categories, sample=sample), list(categories)).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, *, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that the last category's model rejects, in one pass over the texts."""
    categories = categories or {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    names = list(categories)
    while any(x in docs.columns for k in names for x in (f"p_{k}", f"is_{k}")):  # columns of the same name stay as they are
        names = [f"_{k}" for k in names]
    found = scored(docs, fitted(docs, labels, categories, sample=sample), names)
    return found.where(~F.col(f"is_{names[-1]}")).select(docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Junk, then toxic, for all documents."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
