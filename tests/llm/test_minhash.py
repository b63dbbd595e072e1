import random
import re

import numpy as np
import pytest

from trackloom.llm.minhash import bands_for, near_duplicates, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def corpus(seed, n_groups=12, variants=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, variants)):
            t = list(base)
            for _ in range(rng.randrange(8)):
                t[rng.randrange(len(t))] = f"W{rng.randrange(4000)}"
            rows.append((len(rows) * 7 % 1000, " ".join(t)))
    return list({d: (d, t) for d, t in rows}.values())


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, id string")
    return sorted(tuple(r) for r in near_duplicates(df, **how).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows, words=3, percent=85) == expected(rows, 3, 85)


def test_a_large_group_of_variants(spark):
    # far more members under one pivot than are listed as pairs, in several components
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        t = list(base)
        for i in rng.sample(range(120), rng.randint(0, 9)):
            t[i] = f"x{d}_{i}" if rng.random() < 0.7 else f"y{i}"
        rows.append((d, " ".join(t)))
    assert run(spark, rows, words=3, percent=85) == expected(rows, 3, 85)


@pytest.mark.parametrize("members", [15, 16, 17, 18])
def test_pivots_with_few_and_with_many_members(spark, members):
    # around the number of members from which pairs come from rare differences
    rng = random.Random(members)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for d in range(1, members + 1):
        t = list(base)
        for i in rng.sample(range(0, 100, 5), rng.randint(1, 6)):
            t[i] = f"y{i}" if rng.random() < 0.7 else f"x{d}"
        rows.append((d, " ".join(t)))
    assert run(spark, rows, words=3, percent=85) == expected(rows, 3, 85)


@pytest.mark.parametrize("delegates", [1, 2, 64])
def test_components_that_share_an_element(spark, monkeypatch, delegates):
    # many members of several components under one pivot: the rounds find what all pairs would
    monkeypatch.setattr("trackloom.llm.minhash.DELEGATES", delegates)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for d in range(1, 120):
        t = list(base)
        for i in range(0, 90, 15):  # three groups, each with changes of its own away from the pivot
            t[i] = f"g{d % 3}_{i}"
        for i in rng.sample(range(90), rng.randint(0, 2)):
            t[i] = f"x{d}_{i}"
        rows.append((d, " ".join(t)))
    want = expected(rows, 3, 85)
    assert run(spark, rows, words=3, percent=85) == want and len({r[2] for r in want}) > 2


def test_words_with_the_structure_of_a_polynomial_hash(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} p q r"), (2, f"{other} p q r"), (3, word), (4, other)]
    assert run(spark, rows, words=3, percent=85) == expected(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "a b c d e"), (9, "x " * 30000), (10, "x " * 20000), (-3, "a b c d e")]
    assert run(spark, rows) == expected(rows, 5, 80)
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 2, 1, True)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 3, 50, 5000):
        s = sketch(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), 234)
        assert (s != 2**64 - 1).all()
    share = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 1300, dtype=np.uint64)
        a, b = np.unique(x[:1200]), np.unique(x[100:])
        share.append((sketch(a, 234) == sketch(b, 234)).mean())
    assert abs(np.mean(share) - 1100 / 1300) < 0.02
    assert (1 - 0.85**6) ** bands_for(0.85) <= 1e-8
