from pyspark.sql import functions as F

from trackloom.llm.decontaminate import _candidates, contaminated, decontaminated, leaks, windows

ITEM = "A train leaves Paris at 9 km per hour and meets Alice after 12 minutes near the old stone bridge by the river"


def run(spark, docs, items=((1, ITEM),), **how):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id long, h string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, slots string")
    return sorted((r.doc_id, r.item_id, r.n_found, round(r.slot_agreement, 2)) for r in contaminated(d, b, **how).collect())


def test_exact_changed_and_clean(spark):
    other = ITEM.replace("Paris", "Rome").replace(" 9 ", " 140 ").replace("Alice", "Bob").replace("12 minutes", "7.5 hours")
    docs = [(1, "before it " + ITEM + " after it"), (2, "Some words. " + other.upper()[:0] + other + " More."), (3, "A train leaves in the morning, nothing else is the same in this text at all"), (4, ITEM.lower()), (5, " ".join(ITEM.split()[:9]))]
    got = run(spark, docs)
    assert {d for d, *_ in got} >= {1, 2} and not {d for d, *_ in got} & {3, 5}
    assert all(a >= 0.8 for *_, a in got)


def test_slots_must_be_filled_alike(spark):
    item = "if Anna has 3 red apples and Bert has 4 red apples then Anna and Bert share 7 red apples while Anna keeps 3 red apples for home"
    good = item.replace("Anna", "Carl").replace("Bert", "Dora").replace("3", "5").replace("4", "6").replace("7", "11")
    names = iter("Carl Dora Emil Frau Gina Hans Ines Jens".split())
    bad = " ".join(next(names) if w in ("Anna", "Bert") else w for w in item.split())
    digits = iter("5 6 8 9 21 22".split())
    bad = " ".join(next(digits) if w.isdigit() else w for w in bad.split())
    found = {d for d, *_ in run(spark, [(1, "so " + good), (2, "so " + bad)], ((7, item),), consistent=90)}
    assert found == {1}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! ... ---"), (4, "word"), (5, "x. " * 50_000 + ITEM), (6, "so " + ITEM), (None, ITEM)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "too short here"), (5, ITEM), (6, "1 2 3 4 5 6 7 8")]
    assert {(d, i) for d, i, *_ in run(spark, docs, items)} == {(5, 1), (6, 1)}
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_filter_keeps_the_rest(spark):
    d = spark.createDataFrame([(1, "so " + ITEM, "a"), (2, "clean", "b"), (None, ITEM, "c")], "doc_id long, text string, more string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = decontaminated(d, b)
    assert out.columns == ["doc_id", "text", "more"] and sorted(r.more for r in out.collect()) == ["b", "c"]


def plain(text, inserted=False):
    """(template, value, is_slot) of every word, read one by one."""
    import re

    from trackloom.llm.decontaminate import UNITS

    space = " \t\n\x0b\x0c\r"
    edge = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in "%$/" and chr(c) not in space)
    out, end, before_number = [], None, False
    for m in re.finditer(f"[^{space}]+", text):
        word = m[0].strip(edge)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        starts = (not inserted) if end is None else text[end - 1] in ".!?:;\"()" or "\n" in text[end : m.start()]
        number = bool(re.fullmatch(r"[0-9.,:/+%-]*[0-9][0-9.,:/+%-]*", word))
        unit = before_number and low in UNITS and not number
        name = not number and not unit and not starts and len(word.encode()) > 1 and re.match("[A-Z\u00c0-\u00de]", word) is not None
        out.append(("<n>" if number else "<u>" if unit else "<m>" if name else low, low, number or unit or name))
        end, before_number = m.end(), number
    return out


def brute(docs, items, words=5, percent=80, literal=2, consistent=80):
    def windows(t):
        return [(i, tuple(x[0] for x in t[i : i + words]), [x[1] for x in t[i : i + words] if x[2]]) for i in range(len(t) - words + 1) if sum(not x[2] for x in t[i : i + words]) >= literal]

    known = {}
    for i, t in sorted(items):
        both = windows(plain(t or "")) + windows(plain(t or "", inserted=True))
        key = frozenset((at, w) for at, w, _ in both)
        if both and key not in known.values():
            known[i] = key
    slots = {i: {(w, tuple(v)) for _, w, v in windows(plain(dict(items)[i])) + windows(plain(dict(items)[i], inserted=True)) if v} for i in known}
    out = set()
    for d, t in docs:
        mine = windows(plain(t or ""))
        shapes = {w for _, w, _ in mine}
        for i, key in known.items():
            size, found = len({at for at, _ in key}), len({at for at, w in key if w in shapes})
            if found * 100 < size * percent:
                continue
            fills = {}
            for _, w, v in mine:
                for w2, v2 in slots[i]:
                    if w == w2:
                        for a, b in zip(v2, v, strict=True):
                            fills.setdefault(a, {}).setdefault(b, 0)
                            fills[a][b] += 1
            top, every = sum(max(x.values()) for x in fills.values()), sum(sum(x.values()) for x in fills.values())
            if not every or 100 * top / every >= consistent:
                out.add((d, i, found, round(top / every, 2) if every else 1.0))
    return out


def test_against_a_plain_version(spark):
    import random

    rng = random.Random(3)
    vocab = ["the", "a", "train", "leaves", "Éva", "Anna", "Bob", "3", "4.5", "km", "min", "with", "(and", "or)", "stone.", "bridge,", "--", "over!", "10%"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30)))) for i in range(12)]
    docs = []
    for d in range(80):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.7:
            item = rng.choice(items)[1]
            for a, b in (("Anna", "Carl"), ("3", "77"), ("km", "m")):
                item = item.replace(a, b) if rng.random() < 0.5 else item
            t += rng.choice([" ", "\n", ". "]) + item + " end"
        docs.append((d, t))
    assert set(run(spark, docs, items)) == brute(docs, items)


SHOP = "the shop sold 12 red pens on Monday and 15 red pens on Tuesday and 9 red pens on Wednesday and 20 red pens on Thursday and 31 red pens on Friday before closing"


def leaked(spark, docs, items, **how):
    d = spark.createDataFrame(list(docs), "doc_id long, text string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leaks(d, b, **how).collect()}


def test_every_occurrence_is_judged_alone(spark):
    changed = lambda n: SHOP.replace("12", str(n)).replace("15", str(n + 7)).replace("Monday", f"Name{n}")
    docs = [(1, "so " + SHOP), (2, "so " + " and then ".join([SHOP, *map(changed, (40, 50, 60))])), (3, "so " + " or ".join(["Once " + ITEM, ITEM.replace("Paris", "Rome").replace("Alice", "Bob").replace("12", "8").replace(" 9 ", " 3 ")] * 3)), (4, "the shop sold 12 red pens on Monday")]
    items = [(7, SHOP), (8, ITEM)]
    got = leaked(spark, docs, items)
    assert set(got) == {(1, 7), (2, 7), (3, 8)}
    assert all(r.slot_agreement == 1 for r in got.values())


def test_passages_other_case_and_short_items(spark):
    long = " ".join(f"word{i} on{i} the way" for i in range(15))
    parted = long.split()[7:47]
    docs = [(1, "so " + " ".join(parted) + " end"), (2, ITEM.lower()), (3, ITEM.upper().replace("9", "140").replace("12", "5")), (4, "It is Too short, here!"), (5, "a 1 2 3 4 5 6 7 8 9"), (6, "1 2 3 4 5 6 7 9 short here too -- ..."), (7, " ".join(long.split()[:12])), (8, "The train. Leaves in 4 days")]
    items = [(1, long), (2, ITEM), (3, "too short here"), (4, "1 2 3 4 5 6 7 8"), (5, "-- ..."), (6, ""), (7, None)]
    got = leaked(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 4)}
    assert got[4, 3].n_windows == 0 and got[1, 1].n_found < 0.8 * got[1, 1].n_windows


def test_nothing_found_before_is_lost(spark):
    import random

    rng = random.Random(4)
    vocab = ["the", "a", "train", "leaves", "Éva", "Anna", "Bob", "3", "4.5", "km", "with", "stone.", "bridge,", "--", "10%"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30)))) for i in range(12)]
    docs = [(d, " ".join(rng.choice(vocab) for _ in range(20)) + " " + rng.choice(items)[1].replace("Anna", rng.choice(["Carl", "Anna"])).replace("3", rng.choice("37"))) for d in range(60)]
    before = {x[:2] for x in run(spark, docs, items)}
    assert before and before <= set(leaked(spark, docs, items))


def test_equal_items_are_all_reported(spark):
    other = ITEM.replace("Paris", "Rome").replace("12", "15")
    got = leaked(spark, [(1, "so " + ITEM), (2, "so " + other)], [(3, ITEM), (5, other), (7, ITEM), (9, "short one"), (8, "Short one!")])
    assert set(got) == {(d, i) for d in (1, 2) for i in (3, 5, 7)}
    assert set(leaked(spark, [(4, "a short one")], [(9, "short one"), (8, "Short one!")])) == {(4, 8), (4, 9)}


def test_leaks_with_slots_filled_unlike_stay(spark):
    item = "if Anna has 3 red apples and Bert has 4 red apples then Anna and Bert share 7 red apples while Anna keeps 3 red apples for home"
    bad = "if Carl has 5 red apples and Dora has 6 red apples then Emil and Frau share 8 red apples while Gina keeps 9 red apples for home"
    assert not leaked(spark, [(2, "so " + bad)], [(7, item)], consistent=90)


def test_a_template_that_all_items_and_documents_share(spark):
    # five common words: pairs come from rare windows only, and none is lost
    import random

    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(500)]
    lead = "choose the right answer to this"
    items = [(i, f"{lead} {' '.join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))}") for i in range(150)]
    docs = [(d, f"{lead} {' '.join(rng.choice(vocab) for _ in range(20))} {rng.choice(items)[1] if d % 3 == 0 else ''}") for d in range(150)]
    assert set(run(spark, docs, items)) == brute(docs, items)
    d = spark.createDataFrame(docs, "id long, text string")
    b = spark.createDataFrame(items, "id long, text string")
    by_doc = windows(d, 5, 2).select(F.col("id").alias("doc_id"), "h").distinct()
    known = windows(b, 5, 2).select(F.col("id").alias("item_id"), F.lit(0).alias("kind"), "at", "h")
    pairs = by_doc.join(known, "h").select("doc_id", "item_id").distinct().count()
    assert pairs == 150 * 150 and _candidates(by_doc, known, 80).count() < pairs / 20
