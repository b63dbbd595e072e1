import base64
import hashlib
import os
import random

import pytest
from test_minhash import expected as near_duplicates_of

SF = os.environ.get("TRACKLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_in_order(spark, tmp_path):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and len(ids) > 0.6 * len(before)
        if i < len(c.STAGES) - 1:
            assert docs.columns == columns
        if name == "line_dedup":
            assert ids == before and docs.where("length(text) <> n_chars").count() == 0
        before = ids
    assert c.run(spark, SF).count() == len(before)


TOXIC = ["zorkel", "blimfa", "quaxen", "drubbo"]
ITEM = "A train leaves Paris at 9 km per hour and meets Alice after 12 minutes near the old stone bridge by the river"


def odd_tables(spark, folder):
    """Documents with every kind of odd row, labels and benchmark; what each stage must do is known by hand."""
    rng = random.Random(3)
    own = lambda d, n: " ".join(f"w{rng.randrange(900)}" for _ in range(n)) + f" end{d}"
    rows = []
    for d in range(300):
        text = own(d, 40)
        if d % 3 == 0:
            text += " " + " ".join(rng.choice(TOXIC) for _ in range(3))
        rows.append((d, text))
    passage = "\n".join(own(0, 15) for _ in range(5))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "w " * 60_000), (1004, f"lead {own(1, 30)}\n{passage}\ntail"), (1005, f"other {own(2, 30)}\n{passage}\nend")]
    copy = own(3, 60)
    rows += [(1010, copy), (1011, copy), (1012, copy.replace(copy.split()[30], "CHANGED", 1)), (1013, copy.upper())]
    rows += [(1020, f"{own(4, 9)} {ITEM} {own(5, 9)}"), (1021, f"{own(6, 9)}. {ITEM.replace('Paris', 'Rome').replace('12', '31')} {own(7, 9)}"), (1022, own(8, 20))]
    twice = own(9, 30)
    rows += [(1030, twice), (1030, twice), (None, own(10, 20)), (None, copy), (1031, "repeat\nme\n" * 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept string, item_id double, p_toxic string, token_ids int, h array<int>"
    spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None, "L", "K", 0.5, "P", 7, [d or 0]) for d, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 3 == 0), "x") for d in range(200)] + [(None, 0, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, ITEM, 0)], "item_id long, text string, doc_id int").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_every_stage_on_odd_rows_against_plain_versions(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as c

    folder = str(tmp_path)
    rows = odd_tables(spark, folder)
    stages = dict(c.STAGES)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")

    def after(name):
        nonlocal docs
        stages[name](spark, docs, folder).write.parquet(f"{folder}/after_{name}")
        docs = spark.read.parquet(f"{folder}/after_{name}")
        got = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
            others = [c for c in columns if c not in ("doc_id", "text", "n_chars")]
            assert all(tuple(r[c] for c in others) == ("en", "s", "L", "K", 0.5, "P", 7, [r.doc_id or 0]) for r in got)
            return sorted(((r.doc_id, r.text) for r in got), key=key)
        return got

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    clean = sorted((r for r in rows if not any(w in (r[1] or "") for w in TOXIC)), key=key)
    assert after("toxicity") == clean

    want = []
    for d, t in clean:
        if d == 1005:  # of a passage that repeats the later one goes
            t = "\n".join(x for x in t.split("\n") if x not in dict(clean)[1004].split("\n"))
        want.append((d, "repeat\nme\n" if d == 1031 else t))
    got = after("line_dedup")
    assert [(d, None if t is None else [x for x in t.split("\n") if x.strip(" ")]) for d, t in got] == [(d, None if t is None else [x for x in t.split("\n") if x.strip(" ")]) for d, t in want]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())

    kept = {d for d, *_, keep in near_duplicates_of(list({d: (d, t) for d, t in got if d is not None}.values()), 5, 80) if keep}
    want = [r for r in got if r[0] is None or r[0] in kept]
    assert {1010, 1030} <= kept and not {1011, 1012, 1013} & kept
    assert after("minhash_near_dedup") == want

    want = [r for r in want if r[0] not in (1020, 1021)]
    assert after("benchmark_decontamination") == want

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for d, t in want:
        ids = theirs.encode_ordinary(t or "")
        wanted.append((d or -1, ids, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or -1, list(r.token_ids), r.n_tokens, r.decoded_sha256) for r in after("byte_bpe")) == sorted(wanted)

    final = sorted((r.doc_id or -1, list(r.token_ids)) for r in c.run(spark, folder).collect())
    assert final == sorted(r[:2] for r in wanted)


def test_stages_of_an_empty_table_are_empty(spark, tmp_path):
    import corpus_pipeline as c

    odd_tables(spark, f"{tmp_path}/all")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/all/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_registered_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
