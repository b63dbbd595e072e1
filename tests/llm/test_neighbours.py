import numpy as np
import pytest

from trackloom.llm.neighbours import Shard, nearest


def brute(ids, x, every, k):
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * x[ids == q][0]).sum(1)
        other = ids != q
        order = np.lexsort((ids[other], -s[other]))[:k]
        out[int(q)] = list(zip(ids[other][order].tolist(), s[other][order].tolist(), strict=True))
    return out


def run(spark, ids, x, **how):
    df = spark.createDataFrame([(int(i), [float(v) for v in row], 1, "z") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int, score string")
    got = {}
    for r in nearest(df, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_over_shards_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    ids = np.arange(3000)
    got, want = run(spark, ids, x, every=50, k=20, shard_size=1000), brute(ids, x.astype(float), 50, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    scores = {(q, i): s for q in want for i, s in zip(ids, (x.astype(float) * x[q].astype(float)).sum(1), strict=True)}
    assert all(abs(s - scores[q, i]) < 1e-9 for q in got for i, s in got[q])
    assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for q in got for a, b in zip(got[q], got[q][1:], strict=False))


@pytest.mark.parametrize("norms", ["unit", "gaussian", "uniform", "log-normal"])
def test_recall_at_production_parameters(norms):
    # one shard of full size and the query's own parameters; no structure: the hardest directions
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16384, 64))
    if norms != "gaussian":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x *= {"unit": 1, "uniform": rng.uniform(0.5, 2, (len(x), 1)), "log-normal": np.exp(rng.normal(size=(len(x), 1)))}[norms]
    x = x.astype(np.float32)
    q = x[::80]
    got, score = Shard.build(x, degree=32, beam=64, alpha=1.2).search(q, 21, 160)
    exact = q.astype(float) @ x.T.astype(float)
    want = np.argsort(-exact, axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(got, want, strict=True)]) >= 0.95
    assert np.allclose(score, np.take_along_axis(exact, got, 1), rtol=1e-12)


def test_doubles_are_scored_as_they_are(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) * np.exp(np.random.default_rng(2).normal(size=(60, 1)) * 20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every=7, k=6, shard_size=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.arange(60), x, 7, 6)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) <= 1e-12 * abs(b[1]) for q in want for a, b in zip(got[q], want[q], strict=True))


def test_one_direction_and_two_shards_of_mixed_norms(spark):
    # scaled copies of few vectors: only norms tell them apart
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(3, 8))[rng.integers(0, 3, 2000)] * rng.uniform(0.5, 2, (2000, 1))).astype(np.float32)
    ids = np.arange(2000)
    got, want = run(spark, ids, x, every=100, k=20, shard_size=1000), brute(ids, x.astype(float), 100, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_copies_and_few_rows(spark):
    x = np.array([[1.0, 0]] * 40 + [[0.5, 0.5]] * 3 + [[-1.0, 0]], np.float32)
    ids = np.arange(len(x))
    assert run(spark, ids, x, every=20, k=25) == brute(ids, x.astype(float), 20, 25)
    assert run(spark, ids[:3], x[:3], every=1, k=20) == brute(ids[:3], x[:3].astype(float), 1, 20)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, every=5, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 4.0), (0, 2, 10, 0.0), (10, 1, 0, 0.0), (10, 2, 7, -1.5)]
    assert nearest(df.where("vec_id < 0")).count() == 0
