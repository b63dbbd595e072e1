"""Quality by positive-unlabelled learning with the non-negative risk.

Every whole text is described by shape statistics (shares of byte classes, repetition of words, word
pairs and lines, lengths), cut into quantile bins.  A linear model minimises the non-negative unbiased
risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with logistic loss: trusted positives against unlabelled
text.  The class prior pi is estimated from held-back parts of both by the best-bin bound: the smallest
ratio of unlabelled to positive mass above any threshold of a first classifier.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .shared import Scratch, smallest_by_hash, with_workers

#: Trusted positives and unlabelled texts that training takes at most.
POSITIVES, UNLABELLED = 8000, 12000
BINS = 12

_CLASSES: list[np.ndarray] = []
for _chars in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "?", ".", ",", "#$%&*", "|", "@", "/:", "-_", "<>{}[]()", "'\"", ";=+~^\\`", "\n"):
    _flag = np.zeros(256, bool)
    _flag[list(_chars.encode())] = True
    _CLASSES.append(_flag)
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_CLASSES.append(_HIGH)
_UPPER = _CLASSES[0]
_MARK = ~(np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) | _HIGH)
N_STATS = len(_CLASSES) + 13


def stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``N_STATS`` numbers per text; all zero for texts without words."""
    n = len(off) - 1
    out = np.zeros((n, N_STATS))
    size = np.maximum(np.diff(off), 1)
    for k, flag in enumerate(_CLASSES):
        total = np.concatenate(([0], np.cumsum(flag[data])))
        out[:, k] = (total[off[1:]] - total[off[:-1]]) / size
    ws, we, first = T.words(data, off)
    if not len(ws):
        return out
    h = T.word_hashes(data, ws, we)
    length = (we - ws).astype(float)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shout = (upper[we] - upper[ws] >= 2) & (upper[we] - upper[ws] >= 0.6 * length)
    capital = _UPPER[data[ws]]
    tail = _MARK[data[we - 1]]
    tail2 = tail & (length > 1) & _MARK[data[np.maximum(we - 2, 0)]]
    bare = _MARK[data[ws]] & tail
    same = np.concatenate(([False], h[1:] == h[:-1]))
    pair = np.concatenate((T.grams(h, 2), h[-1:]))
    lines_at = np.flatnonzero(data == 10)
    k = len(_CLASSES)
    for r in range(n):
        a, b = first[r], first[r + 1]
        m = b - a
        if not m:
            continue
        word = np.sort(h[a:b])
        runs = np.diff(np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True]))))
        pairs = np.sort(pair[a : b - 1])
        lo, hi = np.searchsorted(lines_at, (off[r], off[r + 1]))
        cuts = np.concatenate(([ws[a]], lines_at[lo:hi], [off[r + 1]]))
        starts = np.searchsorted(ws[a:b], cuts[:-1])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[a:b])))
        line = total[np.append(starts[1:], m)] - total[starts]
        line = np.sort(line[line != 0])
        out[r, k:] = (
            np.log1p(m), len(runs) / m, len(runs) / m**0.8, runs.max() / m, same[a + 1 : b].sum() / m,
            1 - (pairs[1:] == pairs[:-1]).sum() / max(1, m - 1), length[a:b].mean(), length[a:b].std(),
            shout[a:b].mean(), capital[a:b].mean(), tail2[a:b].mean(), bare[a:b].mean(),
            (line[1:] == line[:-1]).sum() / max(1, len(line)),
        )
    return out


def design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot quantile bins of every statistic."""
    n, k = x.shape
    out = np.zeros((n, k * (edges.shape[1] + 1)), np.float32)
    for j in range(k):
        out[np.arange(n), j * (edges.shape[1] + 1) + np.searchsorted(edges[j], x[:, j])] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, *, steps: int = 4000, ridge: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk; Adam over minibatches."""
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1] + 1)
    m, s, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, len(u) // 512)
    epochs = max(20, -(-steps // batches))
    for epoch in range(epochs):
        rate = 0.03 if epoch < epochs * 2 // 3 else 0.005
        for i, j in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches), strict=True):
            xp, xu = p[i], u[j]
            if not len(xp) or not len(xu):
                continue
            zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gu, gp = _sigmoid(zu) / len(zu), -prior * _sigmoid(zp) / len(zp)
            if negative < 0:  # the estimate of a risk can't be negative: step back from it
                gu, gp = -gu, -gp
            else:
                gp = gp - prior * _sigmoid(-zp) / len(zp)
            g = np.append(xu.T @ gu + xp.T @ gp, gu.sum() + gp.sum()) + ridge * w
            t += 1
            m = 0.9 * m + 0.1 * g
            s = 0.999 * s + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best-bin estimate of the share of positives among the unlabelled, from held-back halves."""
    a, b = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0
    w, c = fit_nnpu(p[a], u[b], 0.5, steps=400)
    zp, zu = np.sort(p[~a] @ w + c), np.sort(u[~b] @ w + c)
    cuts = zp[: max(1, int(len(zp) * 0.9))]
    above_p = 1 - np.searchsorted(zp, cuts) / len(zp)
    above_u = 1 - np.searchsorted(zu, cuts) / len(zu)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(((above_u + slack) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> dict | None:
    if len(positive) < 4 or len(unlabelled) < 4:
        return None
    every = np.concatenate((positive, unlabelled))
    edges = np.quantile(every, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # rare shapes at either end get bins of their own
    edges = np.sort(np.column_stack((edges, np.quantile(every, [0.01, 0.03, 0.97, 0.99], axis=0).T)), axis=1)
    p, u = design(positive, edges), design(unlabelled, edges)
    prior = estimate_prior(p, u)
    w, b = fit_nnpu(p, u, prior)
    return {"edges": edges, "w": w, "b": b, "prior": prior}


def _described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """x (statistics of the text) beside the ``keep`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in T.pieces(*T.column(batch.column(0))):
                x = stats(data, off)
                ends = np.arange(0, x.size + 1, N_STATS).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), lists], [*keep, "x"])

    rows = docs.select("text", *keep)
    return rows.mapInArrow(T.tidy(run), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]), "x array<double>"]))


def fitted(docs: DataFrame, trusted: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """The model from documents and the doc_ids of trusted positives; None with too few of either."""
    spark = with_workers(docs.sparkSession)
    scratch = Scratch(spark, "quality")
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(ids, "doc_id", "left_semi")
    good = scratch.keep(good, "trusted")
    good = smallest_by_hash(good, good.count(), positives).withColumn("good", F.lit(1))
    # of repeated ids one is taken, after the bound on the hash
    some = smallest_by_hash(ids, ids.count(), unlabelled).distinct().withColumn("good", F.lit(0))
    chosen = scratch.keep(good.unionByName(some), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # positives + unlabelled rows at most

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("good", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_STATS)
        good = table.column("good").to_numpy() == 1
        return pa.table({"model": pa.array([pickle.dumps(train(x[good], x[~good]))], pa.binary())})

    got = _described(rows, ["doc_id", "good"]).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def scored(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and score, the model's probability of good quality (0.5 without a model)."""
    spark = with_workers(docs.sparkSession)
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, off in T.pieces(*T.column(batch.column(0))):
                z = design(stats(data, off), m["edges"]) @ m["w"] + m["b"]
                score = pa.array(_sigmoid(z).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), score], [*keep, "score"])

    rows = docs.select("text", *keep)
    return rows.mapInArrow(T.tidy(run), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]), "score double"]))


def quality(
    docs: DataFrame, labels: DataFrame, *, held_out: Column | None = None, cut: float = 0.3,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``cut``, else 0) for every document.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and ``quality``; more columns are ignored.
    Documents for which ``held_out`` holds take no part in training, neither their labels nor their texts.
    Trusted positives are the labels of quality 1; other labels and nulls are not used.  Null and empty
    texts have statistics of zero and are scored as such.  Rows with a null doc_id are scored and held
    out of training.  Rows that repeat a doc_id are each scored, and each learned from if the id is in a
    sample.  A text of any length is scored whole; a score equal to ``cut`` counts as good.  An empty table
    gives an empty result.
    """
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learn = F.coalesce(~held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fitted(rows.where(learn), labels.where("quality = 1").where(learn), positives=positives, unlabelled=unlabelled)
    out = scored(rows.withColumn("held_out", ~learn), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every whole text; every fifth document (by CRC-32) is held out."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
