"""Removal of repeated multi-line chunks, cut at content-defined boundaries.  Built-in functions only.

Every line is hashed; a rolling hash (cyclic polynomial, one rotation a step) over the last
``window`` line hashes ends a chunk wherever it falls into one of ``divisor`` classes, so that
boundaries depend on nearby lines alone and shift with them.  Chunks with at least ``least`` lines that
aren't blank are counted by hash over all documents; of a repeated chunk the first (by doc_id, then
line) stays, and the others go if their bytes equal those of the first.

A chunk only goes whole, so parts of a repeated passage stay where its copies are cut differently.  With
``passages`` every two neighbouring lines that aren't blank, with the blank lines between them, count
as a chunk too: any repeated passage of two such lines or more then goes from its first to its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch


def _rotated(x: Column, by: int) -> Column:
    by %= 64
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(back: int):
    return lambda a, b: a.bitwiseXOR(_rotated(b, back))


def _lines(text: str | Column = "text") -> Column:
    return F.split(text, "\n", -1)


def chunks(docs: DataFrame, window: int, divisor: int, least: int, passages: bool = False) -> DataFrame:
    """doc_id, start, len, h: the chunks of every document with two lines or more, ``least`` of them not blank.

    ``passages``: also all pairs of neighbouring lines that aren't blank.
    """
    every = F.transform(_lines(), lambda x: F.struct(F.xxhash64(x).alias("x"), (F.length(F.trim(x)) > 0).alias("solid")))
    rows = docs.where("text IS NOT NULL").select("doc_id", every.alias("every"))
    # blank lines are 0 to the rolling hash, but have their own bytes in a chunk
    rows = rows.select("doc_id", F.col("every.x").alias("lx"), F.transform("every", lambda e: F.when(e["solid"], e["x"]).otherwise(F.lit(0))).alias("lh"))
    # lh is named several times below: Spark then computes it once per row and not inside the lambdas
    roll = F.col("lh")
    for back in range(1, window):
        zeros = F.array_repeat(F.lit(0).cast("long"), F.least(F.lit(back), F.size("lh")))
        shifted = F.slice(F.concat(zeros, F.col("lh")), 1, F.size("lh"))
        roll = F.zip_with(roll, shifted, _joined(back))
    ends = F.filter(F.transform(roll, lambda r, i: F.when(F.pmod(F.xxhash64(r), F.lit(divisor)) == 0, i + 1)), lambda x: x.isNotNull())
    solid = F.filter(F.transform("lh", lambda x, i: F.when(x != 0, i)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "lx", "lh", F.array_union(ends, F.array(F.size("lh"))).alias("ends"), solid.alias("solid"))
    starts = F.slice(F.concat(F.array(F.lit(0)), F.col("ends")), 1, F.size("ends"))
    cut = F.transform(F.arrays_zip(starts.alias("start"), F.col("ends").alias("stop")), lambda c: F.struct(c["start"].alias("start"), (c["stop"] - c["start"]).alias("len")))
    cut = F.filter(cut, lambda c: (c["len"] > 1) & (F.size(F.filter(F.slice(F.col("lh"), c["start"] + 1, c["len"]), lambda x: x != 0)) >= least))
    if passages:
        n = F.greatest(F.size("solid") - 1, F.lit(0))
        pairs = F.arrays_zip(F.slice("solid", 1, n).alias("a"), F.slice("solid", 2, n).alias("b"))
        cut = F.array_union(cut, F.transform(pairs, lambda p: F.struct(p["a"].alias("start"), (p["b"] - p["a"] + 1).alias("len"))))
    rows = rows.select("doc_id", "lx", cut.alias("cut"))
    pieces = F.transform("cut", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), F.xxhash64(F.slice(F.col("lx"), c["start"] + 1, c["len"])).alias("h")))
    return rows.select("doc_id", F.inline(pieces))


def line_dedup(docs: DataFrame, *, window: int = 2, divisor: int = 3, least: int = 2, passages: bool = False) -> DataFrame:
    """Remove all but the first of every repeated multi-line chunk, with ``passages`` of every repeated passage.

    ``docs`` needs ``doc_id`` (unique, integer) and ``text``.  Returns all its columns, with ``text`` made
    of the lines that stay, and ``n_lines`` and ``n_removed`` (replaced where they exist).  Null text
    stays null with 0 lines; an empty text is one blank line; a text may become empty.  An empty table
    gives an empty result.  Rows with a null doc_id pass unchanged.  Where a pair of lines overlaps its
    own first occurrence, only the lines after that go; some copy of every line stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_removed")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    cut = scratch.keep(chunks(texts, window, divisor, least, passages), "chunks")
    first = cut.groupBy("h", "len").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "start")).alias("first")).where("many > 1")
    first = scratch.keep(first.select("h", "len", "first"), "first")  # read anew, so that the join can split a very common chunk
    again = cut.join(first, ["h", "len"])
    same = F.col("first.doc_id") == F.col("doc_id")
    begin = F.when(same, F.greatest("start", F.col("first.start") + F.col("len"))).otherwise(F.col("start"))
    again = scratch.keep(again.select("doc_id", "start", "len", "h", (same & (F.col("first.start") == F.col("start"))).alias("is_first"), begin.alias("begin")), "again")
    scratch.drop(cut, first)

    # byte comparison with the first occurrence
    marks = again.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "h", "is_first")).alias("marks"))
    # the texts are shuffled at any size: a plan that changes with the size of the marks would surprise
    held = texts.hint("merge").join(marks, "doc_id").select("doc_id", _lines().alias("lines"), "marks")
    bodies = F.transform("marks", lambda m: F.struct(m["start"].alias("start"), m["len"].alias("len"), m["h"].alias("h"), m["is_first"].alias("is_first"), F.array_join(F.slice(F.col("lines"), m["start"] + 1, m["len"]), "\n").alias("body")))
    bodies = scratch.keep(held.select("doc_id", F.size("lines"), bodies.alias("bodies")).select("doc_id", F.inline("bodies")), "bodies")
    model = bodies.where("is_first").select("h", "len", F.col("body").alias("model"))
    unlike = bodies.where("NOT is_first").join(model, ["h", "len"]).where("body <> model").select("doc_id", "start", "len")
    unlike = scratch.keep(unlike, "unlike")  # equal hashes, other bytes: hardly ever a row
    scratch.drop(bodies)

    gone = again.where("NOT is_first").join(unlike, ["doc_id", "start", "len"], "left_anti").select("doc_id", F.col("begin").alias("a"), (F.col("start") + F.col("len")).alias("b"))
    # pieces overlap: of each only what reaches beyond all before it
    reached = F.max("b").over(Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.select("doc_id", F.greatest("a", F.coalesce(reached, F.lit(0))).alias("a"), "b").where("a < b")
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("len")))).alias("gone"))
    both = docs.hint("merge").join(gone, "doc_id", "left").withColumn("lines", _lines())
    befores = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["start"] + g["len"]))
    afters = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("lines")))
    stay = F.flatten(F.transform(F.arrays_zip(befores.alias("a"), afters.alias("b")), lambda s: F.slice(F.col("lines"), s["a"] + 1, s["b"] - s["a"])))
    removed = F.aggregate("gone", F.lit(0), lambda n, g: n + g["len"])
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return both.select(*[c if c != "text" else text.alias("text") for c in docs.columns], F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Rolling hashes over two lines, a boundary at every third line on average, and all pairs of lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, passages=True)
