import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import tokens as T
from trackloom.llm import toxicity as toxicity_module
from trackloom.llm.quality import estimate_prior, fit_nnpu, quality, stats
from trackloom.llm.shared import smallest_by_hash
from trackloom.llm.toxicity import BITS, FOLDS, Sparse, fit, fitted, scored, toxicity, train, without_toxic

BAD = ["zorkel", "blimfa", "quaxen", "drubbo"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ta", "li", "mo", "re") for b in ("na", "so", "vi") for c in ("m", "r", "s", "nt")]
    docs, labels = [], []
    for d in range(n):
        kind = rng.choice(["good", "good", "junk", "toxic"])
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if kind == "junk":
            w = [x.upper() + "!!" for x in w] if d % 2 else [w[0]] * len(w)
        if kind == "toxic":
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", ",", "er"])
        docs.append((d, " ".join(w), rng.random()))
        labels.append((d, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_chain_finds_toxic_and_keeps_clean(spark):
    docs, labels = corpus(1200)
    d, lab = tables(spark, docs, labels)
    truth = {r[0]: r for r in labels}
    got = toxicity(d, lab.where("doc_id < 800")).where("doc_id >= 800").collect()
    assert np.mean([r.is_toxic == bool(truth[r.doc_id][2]) for r in got]) > 0.97
    assert np.mean([r.is_junk == (truth[r.doc_id][1] == 0) for r in got]) > 0.8
    kept = without_toxic(d, lab)
    assert kept.columns == d.columns and 0.9 * 900 < kept.count() < 1.05 * 900


def test_chain_on_odd_rows(spark):
    docs, labels = corpus(200)
    d, lab = tables(spark, [*docs, (900, None, 0.0), (901, "", 0.0), (902, "... !!", 0.0), (903, "zorkel " * 50_000, 0.0), (None, "taom", 0.0), (5, "twice", 0.0)], [*labels, (5, 1, 0), (6, None, None), (None, 1, 1), (904, 0, 0)])
    got = {r.doc_id: r for r in toxicity(d, lab).collect()}
    assert not got[900].is_toxic and not got[901].is_toxic and got[900].p_toxic == got[901].p_toxic == got[902].p_toxic and got[903].is_toxic
    assert toxicity(d.limit(0), lab).count() == 0
    none = toxicity(d, lab.limit(0)).collect()
    assert len(none) == len(docs) + 6 and not any(r.is_toxic or r.is_junk for r in none)


def test_quality_of_held_out_documents(spark):
    docs, labels = corpus(1500, 1)
    d, lab = tables(spark, docs, labels)
    truth = {r[0]: r[1] for r in labels}
    rows = quality(d, lab).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    good, junk = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert np.mean([g > j for g in good for j in junk]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_on_odd_rows(spark):
    docs, labels = corpus(200, 2)
    d, lab = tables(spark, [*docs, (900, None, 0.0), (901, "", 0.0), (902, "\n\n \t", 0.0), (903, "w " * 200_000, 0.0), (None, "taom", 0.0)], [*labels, (1, None, None), (None, 1, 1)])
    got = {r.doc_id: r for r in quality(d, lab).collect()}
    assert len(got) == 205 and got[900].score == got[901].score and not got[900].held_out == (zlib.crc32(b"900") % 5 != 0)
    assert got[None].held_out
    assert quality(d.limit(0), lab).count() == 0
    assert {r.score for r in quality(d, lab.limit(0)).collect()} == {0.5}


def test_prior_and_risk_on_a_mixture():
    rng = np.random.default_rng(0)
    one_hot = lambda x: np.eye(12, dtype=np.float32)[np.clip((x * 2 + 6).astype(int), 0, 11)]
    p = one_hot(rng.normal(1.5, 0.7, 4000))
    u = one_hot(np.concatenate((rng.normal(1.5, 0.7, 2800), rng.normal(-1.5, 0.7, 1200))))
    prior = estimate_prior(p, u)
    assert abs(prior - 0.7) < 0.06
    w, b = fit_nnpu(p, u, prior)
    assert (one_hot(rng.normal(1.5, 0.7, 2000)) @ w + b > 0).mean() > 0.93 and (one_hot(rng.normal(-1.5, 0.7, 2000)) @ w + b < 0).mean() > 0.93


def test_training_goes_on_beyond_200_steps():
    from trackloom.llm.toxicity import Sparse, fit

    rng = np.random.default_rng(1)
    on = rng.random((600, 80)) < 0.1
    y = (on[:, :10].sum(1) + rng.random(600) > 1.5).astype(float)
    x = Sparse(*np.nonzero(on), 600, 80)

    def loss(**how):
        w, v, b = fit(x, np.empty((600, 0)), y, np.ones(600), **how)
        z = x.times(w) + b
        return np.mean(np.logaddexp(0, z) - y * z) + 1e-4 * (w @ w)

    assert loss() < loss(steps=200)


def test_the_sample_is_that_of_the_smallest_hashes(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    for total in (5000, 0):  # with a bound on the hash, and without
        assert [r.doc_id for r in smallest_by_hash(rows, total, 300).collect()] == want


def test_held_out_rows_teach_the_quality_model_nothing(spark):
    docs, labels = corpus(600, 3)
    held = {d for d, *_ in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    before = {r.doc_id: r.score for r in quality(*tables(spark, docs, labels)).collect()}
    # other labels and texts of the held-out documents: the scores of all others stay
    docs2 = [(d, "changed " * 9, x) if d in held else (d, t, x) for d, t, x in docs]
    labels2 = [(d, 1 - q, 1 - t) if d in held else (d, q, t) for d, q, t in labels]
    after = {r.doc_id: r.score for r in quality(*tables(spark, docs2, labels2)).collect()}
    assert all(before[d] == after[d] for d in before if d not in held) and any(before[d] != after[d] for d in held)


def test_risk_is_minimised_step_by_step():
    """The same steps with a gradient taken by differences of the risk, one coordinate at a time."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(0.8, 1, (60, 3)), rng.normal(0, 1, (80, 3))
    for prior in (0.4, 0.9):

        def risk(w, prior=prior):
            zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            reached = prior * np.logaddexp(0, -zp).mean() + negative if negative >= 0 else -negative
            return reached + 0.5e-5 * (w @ w)

        w, m, s = np.zeros(4), np.zeros(4), np.zeros(4)
        for t in range(1, 21):  # one batch an epoch
            g = np.array([(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(4) * 1e-6])
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - (0.03 if t <= 13 else 0.005) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        got, b = fit_nnpu(p, u, prior, steps=20)
        assert np.allclose(np.append(got, b), w, atol=1e-4)


def test_statistics_of_texts_one_by_one():
    texts = ["One two two. THREE!! four\nfive five\nfive five", "a", "x y x y x y", "", "é è 12,5 (q) -- ..\n\nend"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    x = stats(np.frombuffer(b"".join(raw), np.uint8), off)
    k = x.shape[1] - 13
    for row, t, r in zip(x, texts, raw, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            assert not row.any()
            continue
        count = Counter(w)
        pairs = list(zip(w, w[1:], strict=False))
        size = [len(v.encode()) for v in w]
        assert np.isclose(row[0], sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) / len(r))
        assert np.isclose(row[k - 1], sum(b >= 128 for b in r) / len(r))
        lines = [tuple(re.findall(r"[^\x20\x09-\x0D]+", v)) for v in t.split("\n")]
        lines = [v for v in lines if v]
        want = [
            np.log1p(len(w)), len(count) / len(w), len(count) / len(w) ** 0.8, max(count.values()) / len(w),
            sum(a == b for a, b in pairs) / len(w), 1 - (len(pairs) - len(set(pairs))) / max(1, len(pairs)), np.mean(size), np.std(size),
        ]
        assert np.allclose(row[k : k + 8], want)
        assert np.isclose(row[k + 12], (len(lines) - len(set(lines))) / max(1, len(lines)))


def test_the_chain_scores_as_a_plain_version_does(spark):
    docs, labels = corpus(400, 7)
    d, lab = tables(spark, docs, labels)
    names = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = fitted(d, lab, names)

    def hashed(word):
        raw = np.frombuffer(word, np.uint8)
        return T.word_hashes(raw, np.array([0]), np.array([len(raw)]))

    def present(text):
        found = set()
        for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
            w = re.sub(rb"^[^0-9A-Za-z%$/\x80-\xff]+|[^0-9A-Za-z%$/\x80-\xff]+$", b"", w).lower()
            if w:
                found.add(int(hashed(w)[0] >> np.uint64(64 - BITS)))
            for k in (4, 5):
                if len(w) > k:
                    found.add(int(T.mix(hashed(w[:k]) + np.uint64(k))[0] >> np.uint64(64 - BITS)))
        return found

    got = {r.doc_id: r for r in scored(d.select("doc_id", "text"), chain, list(names)).collect()}
    for doc, text, _ in docs[::7]:
        logits, have = [], present(text)
        for m, name in zip(chain, names, strict=True):
            z = m["b"] + sum(w for c, w in zip(m["chosen"], m["w"], strict=True) if c in have) + sum(v * x for v, x in zip(m["v"], logits, strict=True))
            logits.append(min(10, max(-10, z)))
            assert abs(got[doc][f"p_{name}"] - 1 / (1 + np.exp(-z))) < 1e-5
            assert got[doc][f"is_{name}"] == (got[doc][f"p_{name}"] >= m["threshold"])


def test_later_models_see_out_of_fold_logits_only():
    """Earlier logits that later models learn from come from models that didn't see the row."""
    rng = np.random.default_rng(2)
    n, width = 400, 30
    on = rng.random((n, width)) < 0.2
    first = (on[:, 0] | on[:, 1]).astype(int)
    second = (first & on[:, 2]).astype(int)
    ids = np.arange(n)
    rows, cols = np.nonzero(on)
    seen = []

    def spy(x, extra, y, weight, **how):
        seen.append((extra.copy(), y.copy()))
        return fit(x, extra, y, weight, **how)

    fold = (T.mix(ids.view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    whole = toxicity_module.fit
    toxicity_module.fit = spy
    try:
        chain = train(ids, rows, cols, np.column_stack((first, second)), np.ones(n))
    finally:
        toxicity_module.fit = whole
    assert len(seen) == 2 * (FOLDS + 1) and [m["v"].shape for m in chain] == [(0,), (1,)]
    logit = np.empty(n)
    for k in range(FOLDS):
        out = fold == k
        assert np.array_equal(seen[k][1], first[~out])  # the model of fold k is fit without its rows
        chosen = toxicity_module._select(Sparse(rows, cols, n, 1 << BITS), first.astype(float), (~out).astype(float))
        where = {c: i for i, c in enumerate(chosen)}
        some = np.array([c in where for c in cols])
        small = Sparse(rows[some], np.array([where[c] for c in cols[some]]), n, len(chosen))
        w, v, b = fit(small.take(~out), np.empty(((~out).sum(), 0)), first[~out].astype(float), np.ones((~out).sum()))
        logit[out] = (small.times(w) + b)[out]
    assert np.allclose(seen[-1][0][:, 0], np.clip(logit, -10, 10))
