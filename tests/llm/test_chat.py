from trackloom.llm.chat import reply_ordered

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def ordered(spark, rows):
    return [tuple(r) for r in reply_ordered(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()]


def test_quotations_link_messages_and_go(spark):
    rows = [
        (1, 0, "user", "How do I  sort a list?\nIt has words."),
        (1, 1, "user", "What about maps?"),
        (1, 2, "assistant", "> how do I sort a list?\n> It has words.\n\nUse sorted."),
        (1, 3, "assistant", "> What about maps?\nSort the items."),
        (1, 4, "user", "> > How do I sort a list?\n> Use sorted.\nThanks"),
        (2, 0, "user", "> nobody said this\nhello"),
    ]
    got = ordered(spark, rows)
    assert [(r[0], r[1], r[5], r[6]) for r in got] == [(1, 0, None, 0), (1, 2, 0, 0), (1, 4, 2, 0), (1, 1, None, 1), (1, 3, 1, 1), (2, 0, None, 0)]
    assert [r[3] for r in got] == ["How do I  sort a list?\nIt has words.", "Use sorted.", "Thanks", "What about maps?", "Sort the items.", "hello"]
    assert [r[4] for r in got] == [0, 2, 2, 0, 1, 1]


def test_a_long_chain_has_one_thread(spark):
    rows = [(7, i, "user", f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(40)]
    got = ordered(spark, rows)
    assert [r[1] for r in got] == list(range(40)) and {r[6] for r in got} == {0}


def test_odd_rows(spark):
    rows = [(None, 0, "user", "> a\nb"), (1, None, "user", None), (1, 0, None, ""), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, 2, "user", "> same\n> " + "x" * 100_000)]
    got = ordered(spark, rows)
    assert len(got) == 6
    assert [r[5] for r in got if r[:2] == (1, 2)] == [1]
    assert ordered(spark, []) == []


def test_same_as_sql_on_random_threads(spark):
    import random

    import duckdb
    import pandas as pd

    from trackloom.llm.oracles import OP10

    rng = random.Random(8)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 12)):
            own = [" ".join(rng.choice(["Yes", "no", "maybe é", "so  what", "line"]) + str(rng.randrange(40)) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3))]
            text = list(own)
            if said and rng.random() < 0.7:
                old = rng.choice(said)
                text = [rng.choice(["> ", ">", " > "]) + x for x in old[rng.randrange(len(old)) :]] + rng.choice([[], [""]]) + text
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["\n", "\n"]).join(text)))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    found = con.execute(OP10)
    names = [d[0] for d in found.description]
    got = reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got.select(names).collect())) == sorted(map(key, found.fetchall()))
    assert got.where("parent_turn IS NOT NULL").count() > 10
