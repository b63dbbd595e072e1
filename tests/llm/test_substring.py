import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm.fmindex import FMIndex, suffix_ranks
from trackloom.llm.substring import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, n):
    words = {d: WORD.findall(t or "") for d, t in rows}
    seen = Counter(tuple(w[i : i + n]) for w in words.values() for i in range(len(w) - n + 1))
    out = []
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, window):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, k long, start string")
    return sorted(tuple(r)[:4] for r in substring_dedup(df, window=window).collect())


@pytest.mark.parametrize("window", [9, 12, 35])
def test_against_all_windows(spark, window):
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.randint(5, 90))] for _ in range(6)]
    rows = []
    for d in range(60):
        t = []
        for _ in range(rng.randint(0, 6)):
            t += rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.5 else [f"é{rng.randrange(9)}" for _ in range(rng.randint(1, 50))]
        rows.append((d, "  ".join(t) + rng.choice(["", "\n", "\t "])))
    assert run(spark, rows, window) == expected(rows, window)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a " * 400), (6, "a b " * 300), (7, "q " + "a b " * 20), (8, "same " * 12), (9, "same " * 12), (10, " ".join(f"u{i}" for i in range(20000)))]
    assert run(spark, rows, 10) == expected(rows, 10)
    assert run(spark, [], 10) == []


def test_words_with_the_structure_of_a_polynomial_hash(spark):
    # a Thue-Morse word and its complement are equal under any polynomial modulo 2 ** 64 with an odd multiplier
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(40))
    rows = [(1, f"{word} {' '.join(f't{i}' for i in range(11))}"), (2, f"{other} {' '.join(f't{i}' for i in range(11))}"), (3, word), (4, f"x {tail}"), (5, f"y {tail}")]
    assert run(spark, rows, 12) == expected(rows, 12)
    # the same with words for letters
    rows = [(1, " ".join(word[:256])), (2, " ".join(other[:256])), (3, " ".join(word))]
    assert run(spark, rows, 200) == expected(rows, 200)


@pytest.mark.parametrize("shard_words", [60, 10**6])
def test_a_short_passage_in_very_many_contexts(spark, shard_words):
    # 11 words that all documents share give windows of 12 with one smallest hash and no equal partner
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(11))
    rows = [(d, f"{' '.join(f'a{rng.randrange(40)}' for _ in range(14))} {shared} {' '.join(f'b{rng.randrange(3)}' for _ in range(9))}") for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in substring_dedup(df, window=12, shard_words=shard_words).collect())
    assert got == expected(rows, 12) and 0 < sum(r[2] > 0 for r in got)


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c x\ny"), (2, "z a b c"), (3, "n")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substring_dedup(df, window=3).collect()} == {1: "x y", 2: "z", 3: None}


@pytest.mark.parametrize("seed", range(4))
def test_index_counts_and_intervals(seed):
    rng = np.random.default_rng(seed)
    seqs = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(20)]
    weights = rng.integers(1, 3, 20)
    index = FMIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]), weights)
    texts = [" ".join(map(str, s)) + " " for s in seqs]
    for _ in range(50):
        pattern = rng.integers(1, 4, rng.integers(1, 6))
        p = " ".join(map(str, pattern)) + " "
        want = sum(int(w) * sum(t.startswith(p, i) for i in range(0, len(t), 2)) for t, w in zip(texts, weights, strict=True))
        assert index.count(pattern) == want
    n = 6
    seen = Counter()
    for s, w in zip(seqs, weights, strict=True):
        for i in range(len(s) - n + 1):
            seen[tuple(s[i : i + n])] += int(w)
    want = {(k, j) for k, s in enumerate(seqs) for i in range(len(s) - n + 1) if seen[tuple(s[i : i + n])] > 1 for j in range(i, i + n)}
    assert {(k, j) for k, a, b in zip(*index.repeated(n), strict=True) for j in range(a, b)} == want


def test_suffix_ranks():
    text = np.array([2, 1, 2, 1, 2, 1, 0])
    order = sorted(range(7), key=lambda i: text[i:].tolist())
    assert np.argsort(suffix_ranks(text)).tolist() == order
