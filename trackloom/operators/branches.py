"""Branches of a track search: counters, best candidates, back-walks, duplicate removal."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.batches import by_groups


def prefix_sums(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Inclusive and exclusive running sums within a group."""
    by = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(by)
    return df.withColumns({"inclusive": total, "exclusive": total - F.col(value)})


def branch_limit(links: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` links of every seed and step, in link order."""
    by = Window.partitionBy("seed_id", "step").orderBy("link_id")
    return links.withColumn("branch", F.row_number().over(by).cast("long")).where(F.col("branch") <= limit)


def per_seed_limit(links: DataFrame, limit: int) -> DataFrame:
    by = Window.partitionBy("seed_id").orderBy("link_id")
    return links.withColumn("branch", F.row_number().over(by).cast("long")).where(F.col("branch") <= limit)


def consecutive_holes(links: DataFrame) -> DataFrame:
    """Per link: holes so far, and holes in a row up to it."""
    by = Window.partitionBy("seed_id").orderBy("step")
    so_far = F.sum("is_hole").over(by.rowsBetween(Window.unboundedPreceding, 0))
    island = F.sum(1 - F.col("is_hole")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = links.withColumns({"n_holes": so_far, "island": island})
    run = F.sum("is_hole").over(Window.partitionBy("seed_id", "island").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("n_consecutive", run).drop("island")


def hole_limits(links: DataFrame, total: int, in_a_row: int) -> DataFrame:
    """Links up to where a seed's branch breaks a hole limit, and the tip's length without holes."""
    counted = consecutive_holes(links)
    bad = F.max(((F.col("n_holes") > total) | (F.col("n_consecutive") > in_a_row)).cast("int")).over(Window.partitionBy("seed_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("bad", bad).where("bad = 0").drop("bad").withColumn("length", F.col("step") + 1 - F.col("n_holes"))


def triplets_on_track(links: DataFrame) -> DataFrame:
    """Every three consecutive measurements."""
    by = Window.partitionBy("track_id").orderBy("pos")
    rows = links.select("track_id", "pos", F.col("meas_id").alias("first"), F.lead("meas_id", 1).over(by).alias("second"), F.lead("meas_id", 2).over(by).alias("third"))
    return rows.where("third IS NOT NULL")


def first_smoothed(states: DataFrame) -> DataFrame:
    """The first smoothed state of every track."""
    return states.where("is_smoothed").groupBy("track_id").agg(F.min("pos").alias("pos"), F.min_by("meas_id", "pos").alias("meas_id"))


def best_per_surface(candidates: DataFrame, keys: list[str], chi2_max: float, k: int) -> DataFrame:
    """The ``k`` candidates of smallest chi2 up to ``chi2_max`` (it included)."""
    by = Window.partitionBy(*keys).orderBy("chi2", "meas_id")
    return candidates.where(F.col("chi2").between(0, chi2_max)).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def optimal_measurement(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.min("chi2").alias("chi2"), F.min(F.struct("chi2", "meas_id")).alias("b")).select(*keys, "chi2", F.col("b.meas_id").alias("meas_id"))


def measurement_ranges(measurements: DataFrame, event: str, surface: str) -> DataFrame:
    """Per surface of an event: first and end position of its measurements in surface order."""
    n = measurements.groupBy(event, surface).agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.partitionBy(event).orderBy(surface).rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumns({"stop": end, "start": end - F.col("n")})


def tips(links: DataFrame) -> DataFrame:
    """Links that no other link continues."""
    return links.join(links.select(F.col("previous_id").alias("link_id")).where("link_id IS NOT NULL"), "link_id", "left_anti")


def back_walk(links: DataFrame) -> DataFrame:
    """(tip_id, link_id, back): every tip with its chain of predecessors, the tip itself at 0.

    A chain stays within its seed, so seeds are the groups: one shuffle, and many seeds walk together.
    """

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        link = table.column("link_id").to_numpy()
        order = np.argsort(link)
        up = table.column("previous_id").fill_null(-1).to_numpy()
        known = table.column("previous_id").is_valid().to_numpy()
        before = np.where(known, order[np.minimum(np.searchsorted(link[order], up), len(link) - 1)], -1)
        before[known & (link[before] != up)] = -1  # a predecessor that isn't there ends the chain
        led = np.zeros(len(link), bool)
        led[before[before >= 0]] = True
        tip = front = np.flatnonzero(~led)
        found = []
        while len(front):
            found.append((link[tip], link[front], np.full(len(tip), len(found))))
            after = before[front]
            tip, front = tip[after >= 0], after[after >= 0]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("tip_id", "link_id", "back"), columns, strict=True)))

    return by_groups(links.select("seed_id", "link_id", "previous_id"), ["seed_id"], ["link_id"], kernel, "tip_id long, link_id long, back long")


def duplicate_tips(walks: DataFrame, tips_: DataFrame, min_length: int = 5) -> DataFrame:
    """Tips whose measurements are the last ones of another tip of higher p-value (ties: the lower id stays).

    ``walks``: tip_id, meas_id, back (0: the last); ``tips_``: tip_id, pval, ndf.  Only tips of more than
    ``min_length`` measurements take part, and only those with ndf over 5 can go.  Every tip offers each of
    its endings; a tip goes if the best offer of what it consists of isn't its own.  No pair of tips that merely
    share a last measurement is formed.
    """
    chains = walks.groupBy("tip_id").agg(F.array_sort(F.collect_list(F.struct("back", "meas_id"))).alias("t")).select("tip_id", F.transform("t", lambda s: s["meas_id"]).alias("chain"))
    chains = chains.where(F.size("chain") > min_length).join(tips_, "tip_id")
    sizes = F.sequence(F.lit(min_length + 1), F.size("chain"))
    offers = chains.select(F.explode(F.transform(sizes, lambda k: F.slice("chain", 1, k))).alias("chain"), F.struct("pval", (-F.col("tip_id")).alias("minus")).alias("offer"))
    best = offers.groupBy("chain").agg(F.max("offer").alias("best"))
    return chains.where("ndf > 5").join(best, "chain").where(-F.col("best.minus") != F.col("tip_id")).select("tip_id")


def divergence_key(theta: Column, alive: Column) -> Column:
    """Sort key of tracks by their angle to the transverse plane, dead ones behind all others."""
    return F.when(alive, 0.0).otherwise(1e4) + F.abs(theta - math.pi / 2)
