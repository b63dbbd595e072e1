import random

import pytest
import xxhash

from trackloom.llm.lines import line_dedup

MASK = (1 << 64) - 1


def expected(rows, divisor=3):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    where, lines = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            continue
        lines[d] = t.split("\n")
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() if x.strip(" ") else 0 for x in lines[d]]
        start = 0
        for i in range(len(h)):
            p = h[i - 1] if i else 0
            roll = h[i] ^ (((p << 1) | (p >> 63)) & MASK)
            if signed(xxhash.xxh64(roll.to_bytes(8, "little"), seed=42).intdigest()) % divisor == 0 or i == len(h) - 1:
                if sum(x != 0 for x in h[start : i + 1]) >= 2:
                    where.setdefault("\n".join(lines[d][start : i + 1]), []).append((d, start, i + 1))
                start = i + 1
    gone = {}
    for places in where.values():
        for d, a, b in sorted(places)[1:]:
            gone.setdefault(d, set()).update(range(a, b))
    return sorted((d, None, 0, 0) if t is None else (d, "\n".join(x for i, x in enumerate(lines[d]) if i not in gone.get(d, ())), len(lines[d]), len(gone.get(d, ()))) for d, t in rows)


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, start string")
    return sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(df, **how).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    passages = [[f"line {rng.randrange(10**6)} é" for _ in range(rng.randint(2, 12))] for _ in range(5)]
    rows = []
    for d in range(40):
        t = [x for _ in range(rng.randint(1, 5)) for x in (rng.choice(passages) if rng.random() < 0.6 else [f"own {d} {rng.random()}", ""])]
        rows.append((d, "\n".join(t)))
    got = run(spark, rows)
    assert got == expected(rows)
    assert any(r[3] for r in got)


def test_boundaries_move_with_the_lines(spark):
    block = [f"shared line {i}" for i in range(30)]
    rows = [(0, "\n".join(block)), (1, "\n".join(["one more", *block])), (2, "\n".join([*(f"lead {i}" for i in range(7)), *block, "end"]))]
    removed = {d: n for d, _, _, n in run(spark, rows)}
    assert removed[0] == 0 and removed[1] >= 15 and removed[2] >= 15


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "\n\n\n"), (5, "\n\n\n"), (6, "a\nb"), (7, "a\nb"), (8, "a\nb"), (9, "x" * 200_000 + "\ny"), (10, "x" * 200_000 + "\ny"), (11, "\n".join(str(i) for i in range(5000)))]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in line_dedup(df).collect()) == ["None", "a\nb", "a\nb"]


def without_passages(rows):
    """Every pair of neighbouring lines that aren't blank, but for its first occurrence."""
    first, out = {}, []
    for d, t in sorted(rows):
        lines = t.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a, b in zip(solid, solid[1:]):
            e, at = first.setdefault(tuple(lines[a : b + 1]), (d, a))
            if (e, at) != (d, a):
                gone |= set(range(max(a, at + b - a + 1) if e == d else a, b + 1))
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_whole_passages_go(spark):
    rng = random.Random(5)
    rows, spans = [], {}
    for k in range(60):
        passage = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(26)) for _ in range(2 + k % 11)]
        passage[1:1] = [""] * (k % 3)
        for d in (2 * k, 2 * k + 1):
            before, after = ([f"own {d} {side} {i}" for i in range(1 + rng.randrange(3))] for side in "ab")
            rows.append((d, "\n".join([*before, *passage, *after])))
            spans[d] = "\n".join([*before, *after]) if d % 2 else rows[-1][1]
    assert {d: t for d, t, *_ in run(spark, rows, passages=True)} == spans


def test_passages_against_a_plain_version(spark):
    rng = random.Random(6)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", f"own {d}"]) for _ in range(rng.randrange(1, 12))) + f"\nend {d}") for d in range(60)]
    rows += [(100, "x\nx\nx\nx\nx"), (101, "y\n\nz"), (102, "y\n \nz"), (103, "y\n \nz")]
    wanted = without_passages(rows)
    got = run(spark, rows, passages=True)
    # whole chunks may take blank lines at the ends of a passage with them
    assert [(d, [x for x in t.split("\n") if x.strip(" ")]) for d, t, *_ in got] == [(d, [x for x in t.split("\n") if x.strip(" ")]) for d, t, *_ in wanted]
    assert all(n >= m for (*_, n), (*_, m) in zip(got, wanted))
