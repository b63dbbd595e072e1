"""Queries of histograms, summaries, comparisons and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import angles, axis, matrices
from ..functions.chi2 import prob
from ..operators import analytics as A
from .bridge import duck, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


def _bin(x: str, n: int, lo: float, hi: float) -> str:
    return f"CAST(CASE WHEN {x} < {lo!r} THEN 0 WHEN {x} >= {hi!r} THEN {n + 1} ELSE LEAST(FLOOR(({x} - {lo!r}) / ({hi!r} - {lo!r}) * {n}) + 1, {n}) END AS BIGINT)"


def _micro(c, name):
    return F.floor(c * 1e6 + 0.5).cast("long").alias(name)


@query("ag13_histogram", f"SELECT {_bin('chi2', 40, 0.0, 32.0)} AS bin, COUNT(*) AS entries FROM tracks GROUP BY 1")
def ag13(spark, d):
    return A.histogram(table(spark, d, "tracks"), F.col("chi2"), 40, 0.0, 32.0)


@query("ag13_histogram2d", f"SELECT {_bin('chi2', 20, 0.0, 32.0)} AS xbin, {_bin('pval', 10, 0.0, 1.0)} AS ybin, COUNT(*) AS entries FROM tracks GROUP BY 1, 2")
def ag13_2d(spark, d):
    return A.histogram2d(table(spark, d, "tracks"), F.col("chi2"), (20, 0.0, 32.0), F.col("pval"), (10, 0.0, 1.0))


@query("ag13_efficiency", f"SELECT {_bin('pz', 25, -8.0, 8.0)} AS bin, COUNT(*) AS total, CAST(SUM(CASE WHEN charge <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(SUM(CASE WHEN charge <> 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS efficiency FROM particles GROUP BY 1")
def ag13_eff(spark, d):
    return A.efficiency(table(spark, d, "particles"), F.col("pz"), F.col("charge") != 0, 25, -8.0, 8.0)


@query("ag13_profile", f"SELECT bin, entries, s / entries AS mean FROM (SELECT {_bin('px', 16, -4.0, 4.0)} AS bin, COUNT(vz) AS entries, SUM(vz) AS s FROM particles GROUP BY 1) AS p")
def ag13_profile(spark, d):
    return A.profile(table(spark, d, "particles"), F.col("px"), F.col("vz"), 16, -4.0, 4.0)


_RES = "WITH r AS (SELECT track_id, chi2, chi2 - ndf AS residual, ndf * 2.0e0 AS variance, ndf FROM tracks)"


def _residuals(spark, d):
    return A.residuals(table(spark, d, "tracks").withColumns({"truth": F.col("ndf").cast("double"), "variance": F.col("ndf") * 2.0}), "chi2", "truth", "variance")


@query("ag14_residual_pull", _RES + "SELECT track_id, residual, residual / SQRT(variance) AS pull, residual / ndf AS relative FROM r")
def ag14(spark, d):
    return _residuals(spark, d).select("track_id", "residual", "pull", "relative")


@query("ag14_resolution", _RES + f", b AS (SELECT {_bin('CAST(ndf AS DOUBLE)', 9, 1.0, 19.0)} AS bin, residual FROM r) SELECT bin, COUNT(*) AS entries, CAST(FLOOR(AVG(residual) * 1e6 + 0.5e0) AS BIGINT) AS mean_u, CAST(FLOOR(STDDEV_SAMP(residual) * 1e6 + 0.5e0) AS BIGINT) AS sigma_u FROM b GROUP BY bin")
def ag14_resolution(spark, d):
    out = A.resolution(_residuals(spark, d), F.col("ndf").cast("double"), 9, 1.0, 19.0)
    return out.select("bin", "entries", _micro(F.col("mean"), "mean_u"), _micro(F.col("sigma"), "sigma_u"))


# the upper tail for even ndf: exp(-x/2) * sum of (x/2)^k / k!, k < ndf / 2
_TAIL = " + ".join(f"CASE WHEN ndf / 2 > {k} THEN POWER(chi2 / 2e0, {k}) / {float(math.factorial(k))!r} ELSE 0e0 END" for k in range(9))
_PROB = f"CASE WHEN chi2 = 0 THEN 1e0 ELSE EXP(-chi2 / 2e0) * ({_TAIL}) END"


@query("pr10_chi2_probability", f"SELECT track_id, CAST(FLOOR({_PROB} * 1e6 + 0.5e0) AS BIGINT) AS pval_u FROM tracks")
def pr10(spark, d):
    return table(spark, d, "tracks").select("track_id", _micro(prob("chi2", "ndf"), "pval_u"))


@query("ag15_track_statistics", f"SELECT ndf, {_bin('chi2 / ndf', 20, 0.0, 10.0)} AS bin, COUNT(*) AS entries FROM tracks GROUP BY 1, 2")
def ag15(spark, d):
    return A.histogram(table(spark, d, "tracks"), F.col("chi2") / F.col("ndf"), 20, 0.0, 10.0, "ndf")


_STATES = """WITH states AS (SELECT track_id, pos, meas_id % 6 = 0 AS is_hole, meas_id % 10 <> 0 AS is_smoothed, CAST(meas_id % 64 AS DOUBLE) / 16e0 AS backward_chi2, 2 AS dimensions FROM track_links)"""


def _states(spark, d):
    m = F.col("meas_id")
    return table(spark, d, "track_links").select("track_id", "pos", (m % 6 == 0).alias("is_hole"), (m % 10 != 0).alias("is_smoothed"), ((m % 64).cast("double") / 16).alias("backward_chi2"), F.lit(2).alias("dimensions"))


@query("ag16_fit_rollup", _STATES + """, s AS (SELECT track_id, SUM(CASE WHEN is_smoothed AND NOT is_hole THEN backward_chi2 ELSE 0e0 END) AS chi2,
    CAST(SUM(CASE WHEN is_smoothed AND NOT is_hole THEN dimensions ELSE 0 END) - 5 AS DOUBLE) AS ndf, CAST(SUM(CASE WHEN is_hole THEN 1 ELSE 0 END) AS BIGINT) AS n_holes FROM states GROUP BY track_id)
    SELECT track_id, chi2, ndf, n_holes, ndf <= 0 AS no_pval FROM s""")
def ag16(spark, d):
    out = A.fit_summary(_states(spark, d))
    return out.select("track_id", "chi2", "ndf", "n_holes", ((F.col("pval") == 0) & (F.col("ndf") <= 0)).alias("no_pval"))


@query("ag17_fit_outcomes", "SELECT fit_outcome, COUNT(*) AS n_tracks FROM tracks GROUP BY fit_outcome")
def ag17(spark, d):
    return A.outcome_counts(table(spark, d, "tracks"))


@query("ag20_harmonic_sum", "SELECT fit_outcome, CAST(FLOOR(1e0 / SUM(1e0 / ndf) * 1e6 + 0.5e0) AS BIGINT) AS harmonic_u FROM tracks GROUP BY fit_outcome")
def ag20(spark, d):
    return A.harmonic(table(spark, d, "tracks"), "ndf", "fit_outcome").select("fit_outcome", _micro(F.col("harmonic_sum"), "harmonic_u"))


@query("ag20_two_level_mean", """WITH i AS (SELECT fit_outcome, event_id, AVG(chi2) AS v FROM tracks GROUP BY fit_outcome, event_id)
    SELECT fit_outcome, COUNT(*) AS n, CAST(FLOOR(AVG(v) * 1e6 + 0.5e0) AS BIGINT) AS mean_u, CAST(FLOOR(STDDEV_SAMP(v) * 1e6 + 0.5e0) AS BIGINT) AS std_u FROM i GROUP BY fit_outcome""")
def ag20_two(spark, d):
    out = A.two_level(table(spark, d, "tracks"), "chi2", ["event_id"], ["fit_outcome"])
    return out.select("fit_outcome", "n", _micro(F.col("mean"), "mean_u"), _micro(F.col("std"), "std_u"))


_SUB = "s AS (SELECT event_id, spacepoint_id, x, y, z FROM spacepoints WHERE z > 0), t AS (SELECT event_id, spacepoint_id, x * 1.0009765625e0 AS x, y, z FROM spacepoints WHERE spacepoint_id % 3 <> 0 AND z > 0)"


def _close(u: float) -> str:
    return " AND ".join(f"ABS(s.{c} - t.{c}) <= {u!r} * ((ABS(s.{c}) + ABS(t.{c})) / 2)" for c in "xyz")


def _two(spark, d):
    s = table(spark, d, "spacepoints").where("z > 0")
    return s, s.where("spacepoint_id % 3 <> 0").withColumn("x", F.col("x") * 1.0009765625)


@query("jo12_approximate_match", f"WITH {_SUB} SELECT spacepoint_id FROM s WHERE EXISTS (SELECT 1 FROM t WHERE s.event_id = t.event_id AND {_close(0.01)})")
def jo12(spark, d):
    return A.close_matches(*_two(spark, d), ["event_id"], ["x", "y", "z"], 0.01, "spacepoint_id")


_RATES = " UNION ALL ".join(f"SELECT {u!r} AS uncertainty, COUNT(*) AS n_matched FROM s WHERE EXISTS (SELECT 1 FROM t WHERE s.event_id = t.event_id AND {_close(u)})" for u in (0.0001, 0.002))


@query("ag21_matching_rate", f"WITH {_SUB}, m AS ({_RATES}), a AS (SELECT COUNT(*) AS n_lhs FROM s), b AS (SELECT COUNT(*) AS n_rhs FROM t) SELECT CAST(uncertainty AS DOUBLE) AS uncertainty, n_matched, n_lhs, n_rhs, n_matched * 100e0 / GREATEST(n_lhs, n_rhs) AS rate FROM m, a, b")
def ag21(spark, d):
    return A.matching_rate(*_two(spark, d), ["event_id"], ["x", "y", "z"], [0.0001, 0.002], "spacepoint_id")


_PARETO = "r AS (SELECT track_id, chi2, ndf, pval, CAST(track_id % 7 AS BIGINT) AS fakes FROM tracks WHERE fit_outcome = 0)"


@query("ag22_pareto_set", f"WITH {_PARETO} SELECT track_id, chi2, fakes, pval, ndf FROM r m WHERE NOT EXISTS (SELECT 1 FROM r n WHERE n.track_id <> m.track_id AND n.chi2 <= m.chi2 AND n.fakes <= m.fakes AND n.pval >= m.pval AND n.ndf >= m.ndf)")
def ag22(spark, d):
    rows = table(spark, d, "tracks").where("fit_outcome = 0").withColumn("fakes", F.col("track_id") % 7)
    return A.pareto(rows, "track_id", ["chi2", "fakes"], ["pval", "ndf"])


@query("ag24_weighted_moments", f"WITH b AS (SELECT ndf, {_bin('chi2', 32, 0.0, 32.0)} - 0.5e0 AS centre, COUNT(*) AS n FROM tracks GROUP BY 1, 2), m AS (SELECT ndf, SUM(n) AS w, SUM(n * centre) AS s, SUM(n * centre * centre) AS q FROM b GROUP BY ndf) SELECT ndf, s / w AS mean, SQRT(GREATEST(q / w - (s / w) * (s / w), 0e0)) AS sigma FROM m")
def ag24(spark, d):
    bins = A.histogram(table(spark, d, "tracks"), F.col("chi2"), 32, 0.0, 32.0, "ndf").withColumn("centre", F.col("bin") - F.lit(0.5).cast("double"))
    return A.weighted_moments(bins, "centre", "entries", "ndf")


@query("ag25_throughput_range", "SELECT event_id, MIN(ndf / chi2) AS slowest, MAX(ndf / chi2) AS fastest, COUNT(*) AS n FROM tracks WHERE chi2 > 0 GROUP BY event_id")
def ag25(spark, d):
    return table(spark, d, "tracks").where("chi2 > 0").groupBy("event_id").agg(F.min(F.col("ndf") / F.col("chi2")).alias("slowest"), F.max(F.col("ndf") / F.col("chi2")).alias("fastest"), F.count("*").alias("n"))


@query("ag23_throughput", "SELECT event_id, COUNT(*) AS n_tracks, COUNT(*) / 0.5e0 AS per_second, 1000e0 / (COUNT(*) / 0.5e0) AS ms_each FROM tracks GROUP BY event_id")
def ag23(spark, d):
    out = table(spark, d, "tracks").groupBy("event_id").agg(F.count("*").alias("n_tracks")).withColumn("per_second", F.col("n_tracks") / F.lit(0.5).cast("double"))
    return out.withColumn("ms_each", 1000 / F.col("per_second"))


@query("ag19_radius_extent", f"SELECT {_bin('z', 24, -240.0, 240.0)} AS bin, MIN(x * x + y * y) AS min_r2, MAX(x * x + y * y) AS max_r2, COUNT(*) AS n FROM spacepoints GROUP BY 1")
def ag19(spark, d):
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    return table(spark, d, "spacepoints").groupBy(A.bin_of(F.col("z"), 24, -240.0, 240.0).alias("bin")).agg(F.min(r2).alias("min_r2"), F.max(r2).alias("max_r2"), F.count("*").alias("n"))


@query("pr3_radius", "SELECT spacepoint_id, SQRT(x * x + y * y) AS radius FROM spacepoints")
def pr3(spark, d):
    return table(spark, d, "spacepoints").select("spacepoint_id", angles.radius(F.col("x"), F.col("y")).alias("radius"))


_WRAP = "CASE WHEN {v} - ({s!r}) >= 0 AND {v} - ({s!r}) < {r!r} THEN {v} ELSE {v} - {r!r} * FLOOR(({v} - ({s!r})) / {r!r}) END"


@query("pr5_wrap_angles", "WITH a AS (SELECT particle_id, px AS phi, ABS(py) AS theta FROM particles), t AS (SELECT particle_id, phi, " + _WRAP.format(v="theta", s=0.0, r=2 * math.pi) + f" AS theta FROM a), u AS (SELECT particle_id, CASE WHEN theta > {math.pi!r} THEN phi + {math.pi!r} ELSE phi END AS phi, CASE WHEN theta > {math.pi!r} THEN {2 * math.pi!r} - theta ELSE theta END AS theta FROM t) SELECT particle_id, " + _WRAP.format(v="phi", s=-math.pi, r=2 * math.pi) + " AS phi, theta FROM u")
def pr5(spark, d):
    phi, theta = angles.wrap_phi_theta(F.col("px"), F.abs(F.col("py")))
    return table(spark, d, "particles").select("particle_id", phi.alias("phi"), theta.alias("theta"))


@query("pr4_eta_theta", "SELECT particle_id, CAST(FLOOR(2e0 * ATAN(EXP(-px)) * 1e6 + 0.5e0) AS BIGINT) AS theta_u FROM particles")
def pr4(spark, d):
    return table(spark, d, "particles").select("particle_id", _micro(angles.eta_to_theta(F.col("px")), "theta_u"))


@query("pr6_normalised", f"WITH a AS (SELECT particle_id, ABS(py) AS theta FROM particles) SELECT particle_id, NOT (theta <= 0 OR theta >= {math.pi!r}) AS ok FROM a")
def pr6(spark, d):
    return table(spark, d, "particles").select("particle_id", angles.has_direction(F.abs(F.col("py"))).alias("ok"))


@query("pr14_particle_hypothesis", "SELECT particle_id, CASE WHEN process = 0 THEN 11 WHEN process = 1 THEN 13 WHEN process = 2 THEN 211 ELSE 0 END AS pdg, CASE WHEN process IN (0, 1) THEN CASE WHEN charge < 0 THEN 1 ELSE -1 END * CASE WHEN process = 0 THEN 11 ELSE 13 END WHEN process = 2 THEN CASE WHEN charge > 0 THEN 211 ELSE -211 END ELSE 0 END AS corrected FROM particles")
def pr14(spark, d):
    pdg = F.when(F.col("process") == 0, 11).when(F.col("process") == 1, 13).when(F.col("process") == 2, 211).otherwise(22)
    return table(spark, d, "particles").select("particle_id", matrices.known_pdg(pdg).alias("pdg"), matrices.corrected_hypothesis(pdg, F.col("charge")).alias("corrected"))


@query("pr12_masked_inverse", "SELECT track_id, CASE WHEN ndf % 4 = 0 THEN 1e0 / (1e0 + chi2) ELSE 2e0 / ((1e0 + chi2) * 2e0 - 0.5e0 * 0.5e0) END AS i00, CASE WHEN ndf % 4 = 0 THEN 0e0 ELSE -0.5e0 / ((1e0 + chi2) * 2e0 - 0.5e0 * 0.5e0) END AS i01 FROM tracks")
def pr12(spark, d):
    half = F.lit(0.5).cast("double")
    i00, i01, _, _ = matrices.masked_inverse(1.0 + F.col("chi2"), half, half, F.lit(2.0), F.when(F.col("ndf") % 4 == 0, 1).otherwise(2))
    return table(spark, d, "tracks").select("track_id", i00.alias("i00"), i01.alias("i01"))


@query("pr15_same_scalar", "SELECT track_id, ABS(chi2 - ndf) <= 0.1e0 * ((ABS(chi2) + ABS(ndf)) / 2e0) AS same FROM tracks")
def pr15(spark, d):
    return table(spark, d, "tracks").select("track_id", angles.same_scalar(F.col("chi2"), F.col("ndf").cast("double"), 0.1).alias("same"))


@query("pr18_axis_bins", "SELECT spacepoint_id, CAST(LEAST(GREATEST(CASE WHEN (z + 100e0) / 200e0 * 10e0 >= 0 THEN FLOOR((z + 100e0) / 200e0 * 10e0) ELSE CEIL((z + 100e0) / 200e0 * 10e0) END, 0), 9) AS BIGINT) AS regular, CAST(((CAST(FLOOR((x + 50e0) / 100e0 * 8e0) AS BIGINT) % 8) + 8) % 8 AS BIGINT) AS circular, CAST(CASE WHEN y > 100 THEN 3 WHEN y > 10 THEN 2 WHEN y > -10 THEN 1 ELSE 0 END AS BIGINT) AS irregular FROM spacepoints")
def pr18(spark, d):
    sp = table(spark, d, "spacepoints")
    return sp.select("spacepoint_id", axis.Regular(10, -100.0, 100.0).bin(F.col("z")).alias("regular"), axis.Circular(8, -50.0, 50.0).bin(F.col("x")).alias("circular"), axis.Irregular((-100.0, -10.0, 10.0, 100.0, 1000.0)).bin(F.col("y")).alias("irregular"))


@query("pr19_axis_zone", "WITH b AS (SELECT spacepoint_id, CAST(FLOOR((x + 50e0) / 100e0 * 8e0) AS BIGINT) AS raw FROM spacepoints), o AS (SELECT -1 AS step UNION ALL SELECT 0 UNION ALL SELECT 1) SELECT spacepoint_id, CAST((((raw + step) % 8) + 8) % 8 AS BIGINT) AS bin FROM b, o")
def pr19(spark, d):
    return table(spark, d, "spacepoints").select("spacepoint_id", F.explode(axis.Circular(8, -50.0, 50.0).zone(F.col("x"), 1, 1)).alias("bin"))


@query("pr20_serialize", "SELECT cell_id, channel1 * 48 + channel0 AS serial, CAST((channel1 * 48 + channel0) % 48 AS BIGINT) AS first_bin, CAST(channel1 AS BIGINT) AS second_bin FROM cells")
def pr20(spark, d):
    serial = axis.serialize(F.col("channel0"), F.col("channel1"), 48)
    first, second = axis.deserialize(serial, 48)
    return table(spark, d, "cells").select("cell_id", serial.alias("serial"), first.cast("long").alias("first_bin"), second.alias("second_bin"))
