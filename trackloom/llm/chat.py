"""Conversations in reply order without quotations.  Built-in functions only.

A line's quote level is the number of ``>`` before it.  Consecutive lines of one level form a quoted
passage; passages and their lines are normalised (ASCII case, runs of white space) and hashed.  Every
message offers the passages, lines and the whole of its own text under the same hashes; a quotation
is linked to the first message of its conversation that offers it, and a message replies to the
message from which most characters of its outermost quotations come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

_MARKS = r"^(?:[ \t]{0,3}>)+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(x, _UPPER, _LOWER), r"[ \t\r\n]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """One row per line: conv_id, turn, i, level, line (without its quote marks)."""
    rows = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "raw"))
    level = F.length(F.regexp_replace(F.regexp_extract("raw", f"({_MARKS})", 1), "[^>]", ""))
    return rows.select("conv_id", "turn", "i", level.alias("level"), F.regexp_replace("raw", _MARKS + " ?", "").alias("line"))


def _own(text: Column) -> Column:
    """The text without quoted lines and without blank lines at its ends."""
    left = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(_MARKS))
    return F.regexp_replace(F.array_join(left, "\n"), r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")


def _passages(lines: DataFrame) -> DataFrame:
    """conv_id, turn, level, unit: runs of consecutive lines of one level, normalised and joined."""
    key = ["conv_id", "turn", "level"]
    run = F.col("i") - F.row_number().over(Window.partitionBy(*key).orderBy("i"))
    rows = lines.where("unit <> ''").withColumn("run", run)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "unit"))), lambda s: s["unit"])
    return rows.groupBy(*key, "run").agg(F.array_join(ordered, " ").alias("unit")).drop("run")


def linked(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, parent_turn of the messages whose quotations come from an earlier message."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    lines = parsed(known).withColumn("unit", normalised(F.col("line")))
    quoted = lines.where("level > 0")
    quotes = quoted.where("unit <> ''").select("conv_id", "turn", "level", "unit").unionByName(_passages(quoted))
    quotes = scratch.keep(quotes.select("conv_id", "turn", "level", F.xxhash64("unit").alias("h"), F.length("unit").cast("long").alias("size")), "quotes")
    talks = quotes.select("conv_id").distinct()
    own = lines.where("level = 0").join(talks, "conv_id", "left_semi")
    whole = known.join(talks, "conv_id", "left_semi").select("conv_id", "turn", normalised(_own(F.col("text"))).alias("unit"))
    offers = own.select("conv_id", "turn", "unit").unionByName(_passages(own).drop("level")).unionByName(whole).where("unit <> ''")
    # one row per conversation and unit, whatever the number of messages that repeat it
    offers = offers.groupBy("conv_id", F.xxhash64("unit").alias("h"), F.length("unit").cast("long").alias("size")).agg(F.min("turn").alias("source"))
    hits = quotes.join(offers, ["conv_id", "h", "size"]).where("source < turn")
    votes = hits.groupBy("conv_id", "turn", "level", "source").agg(F.sum("size").alias("votes"))
    outer = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("votes")).alias("less"), (-F.col("source")).alias("late"))).alias("best"))
    return scratch.keep(outer.select("conv_id", "turn", (-F.col("best.late")).alias("parent_turn")), "links")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages without quotations, ordered by conversation, thread and turn.

    ``messages`` needs ``conv_id, turn, role, text``; more columns are ignored.  Returns ``conv_id, turn,
    role, text, n_quoted`` (quoted lines left out), ``parent_turn`` (null where no quotation is found in
    an earlier message) and ``thread_turn`` (the turn that the chain of parents starts from; the own
    turn without a parent), so that a message always follows the one it replies to.  Null text is empty;
    rows with a null conv_id or turn are kept without links; repeated (conv_id, turn) share their
    links.  Of several messages with the same words the first counts as the source; of several sources
    the one with most quoted characters, then the latest.  An empty table gives an empty result.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    links = linked(messages, scratch)
    roots = links.select("conv_id", "turn", F.col("parent_turn").alias("root"))
    if links.limit(1).count():
        for _ in range(64):  # every round doubles the length of the chains that are followed
            up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"))
            joined = roots.join(up, ["conv_id", "root"], "left")
            new = scratch.keep(joined.select("conv_id", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
            roots = new.drop("moved")
            if not new.where("moved").limit(1).count():
                break
    chain = links.join(roots, ["conv_id", "turn"])
    quoted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(_MARKS)))
    rows = messages.select("conv_id", "turn", "role", _own(F.coalesce("text", F.lit(""))).alias("text"), quoted.cast("long").alias("n_quoted"))
    out = rows.join(chain, ["conv_id", "turn"], "left").withColumn("thread_turn", F.coalesce("root", "turn")).drop("root")
    return out.orderBy("conv_id", "thread_turn", "turn").select("conv_id", "turn", "role", "text", "n_quoted", "parent_turn", "thread_turn")


def op10_chat_quotations(spark, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotations."""
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
