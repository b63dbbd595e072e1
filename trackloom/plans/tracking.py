"""Queries of finding and fitting, on a simulated telescope with as many events as the tables have blocks of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ambiguity as A
from ..operators import fitting as T
from ..kernels.search import FindingConfig
from .bridge import table
from .windows import kept

QUERIES, ORACLES = {}, {}
PLANES, BZ = [20.0 * i for i in range(9)], 2 * 2.99792458e-4


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _events(spark, d) -> int:
    return max(1, table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 1000.0).alias("e")).distinct().count())


def _truth(spark, d):
    return T.simulate(spark, _events(spark, d), 10, PLANES, bz=BZ)


def _seeds(truth):
    return T.smeared_seeds(truth, scale=0.05)


@query("al33_simulation")
def al33(spark, d):
    return _truth(spark, d)


@query("al31_truth_seeds")
def al31(spark, d):
    return _seeds(_truth(spark, d))


@query("al32_truth_candidates")
def al32(spark, d):
    return T.truth_candidates(_truth(spark, d), pt_min=0.5)


def _found(spark, d, cfg):
    truth = _truth(spark, d)
    seeds = _seeds(truth).withColumnRenamed("track_id", "seed_id").withColumn("plane", F.lit(0))
    return T.find_tracks(truth, seeds, PLANES, bz=BZ, cfg=cfg)


@query("al17_track_finding")
def al17(spark, d):
    return _found(spark, d, FindingConfig())


@query("al21_progressive_finding")
def al21(spark, d):
    return _found(spark, d, FindingConfig(progressive=True))


@query("al25_kalman_fit")
def al25(spark, d):
    truth = _truth(spark, d)
    return T.fit_tracks(truth, _seeds(truth), bz=BZ)


@query("al26_found_smoothing")
def al26(spark, d):
    truth = _truth(spark, d)
    seeds = _seeds(truth).withColumnRenamed("track_id", "seed_id").withColumn("plane", F.lit(0))
    found = T.find_tracks(truth, seeds, PLANES, bz=BZ, cfg=FindingConfig())
    return T.smooth_found(found, truth, seeds, bz=BZ)


@query("sk10_simulation_hits")
def sk10(spark, d):
    return T.simulation_tables(_truth(spark, d))["hits"]


@query("al27_triplet_fit")
def al27(spark, d):
    return T.triplet_fit(_truth(spark, d), bz=BZ)


@query("al30_parallel_resolution")
def al30(spark, d):
    return A.parallel_resolution(table(spark, d, "tracks"), table(spark, d, "track_links"), kept(spark))


@query("al34_cell_generator")
def al34(spark, d):
    return T.generate_cells(spark, _events(spark, d))
