"""Histograms, efficiencies, profiles, residuals, Pareto sets and collection comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chi2 import prob
from ..kernels.batches import by_groups
from ..workers import with_workers


def bin_of(value: Column, bins: int, low: float, high: float) -> Column:
    """0 below the range, 1..bins inside, bins + 1 above; null for null and NaN."""
    inside = F.least(F.floor((value - low) / (high - low) * bins).cast("long") + 1, F.lit(bins))
    return F.when(F.isnan(value), None).when(value < low, 0).when(value >= high, bins + 1).otherwise(inside).cast("long")


def histogram(df: DataFrame, value: Column, bins: int, low: float, high: float, *by: str) -> DataFrame:
    return df.withColumn("bin", bin_of(value, bins, low, high)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("entries"))


def histogram2d(df: DataFrame, x: Column, xaxis: tuple[int, float, float], y: Column, yaxis: tuple[int, float, float]) -> DataFrame:
    return df.withColumns({"xbin": bin_of(x, *xaxis), "ybin": bin_of(y, *yaxis)}).groupBy("xbin", "ybin").agg(F.count("*").alias("entries"))


def efficiency(df: DataFrame, value: Column, passed: Column, bins: int, low: float, high: float) -> DataFrame:
    """Per bin: all, passed, and their ratio."""
    out = df.withColumn("bin", bin_of(value, bins, low, high)).groupBy("bin").agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    return out.withColumn("efficiency", F.col("passed") / F.col("total"))


def profile(df: DataFrame, x: Column, y: Column, bins: int, low: float, high: float) -> DataFrame:
    """Per bin of x: entries and the sum and mean of y."""
    return df.withColumn("bin", bin_of(x, bins, low, high)).groupBy("bin").agg(F.count(y).alias("entries"), F.avg(y).alias("mean"))


def residuals(df: DataFrame, fitted: str, truth: str, variance: str) -> DataFrame:
    """Residual, pull (residual over its uncertainty) and relative resolution."""
    res = F.col(fitted) - F.col(truth)
    pull = F.when(F.col(variance) > 0, res / F.sqrt(F.col(variance)))
    return df.withColumns({"residual": res, "pull": pull, "relative": F.when(F.col(truth) != 0, res / F.col(truth))})


def resolution(df: DataFrame, x: Column, bins: int, low: float, high: float, value: str = "residual") -> DataFrame:
    """Moments of ``value`` per bin; sigma is the sample deviation."""
    return df.withColumn("bin", bin_of(x, bins, low, high)).groupBy("bin").agg(F.count(value).alias("entries"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"))


def fit_summary(states: DataFrame) -> DataFrame:
    """Per track: chi2 summed over smoothed states that are no holes, ndf = dimensions - 5, p-value."""
    good = F.col("is_smoothed") & ~F.col("is_hole")
    out = states.groupBy("track_id").agg(F.sum(F.when(good, F.col("backward_chi2")).otherwise(0.0)).alias("chi2"), (F.sum(F.when(good, F.col("dimensions")).otherwise(0)) - 5).cast("double").alias("ndf"), F.count_if("is_hole").alias("n_holes"))
    return out.withColumn("pval", prob("chi2", "ndf"))


def outcome_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("fit_outcome").agg(F.count("*").alias("n_tracks"))


def harmonic(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Reciprocal of the sum of reciprocals."""
    return df.groupBy(*by).agg((1 / F.sum(1 / F.col(value))).alias("harmonic_sum"))


def two_level(df: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Mean and deviation over inner groups of their means."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("v")).groupBy(*outer).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n"))


def weighted_moments(bins: DataFrame, centre: str, weight: str, *by: str) -> DataFrame:
    """Mean and sigma of binned values."""
    w, x = F.col(weight), F.col(centre)
    out = bins.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q"))
    mean = F.col("s") / F.col("w")
    return out.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0))).alias("sigma"))


def _skyline(points: np.ndarray) -> np.ndarray:
    """Places of the rows that no other row equals or undercuts in every column; rows are distinct."""
    order = np.lexsort(points.T[::-1])  # a row can only be beaten by one before it
    best = np.empty((0, points.shape[1]))
    found: list[int] = []
    for at in range(0, len(order), 1024):
        some = order[at : at + 1024]
        beaten = np.zeros(len(some), bool)
        for i in range(0, len(best), 1024):
            beaten |= (best[None, i : i + 1024] <= points[some][:, None]).all(2).any(1)
        some = some[~beaten]
        among = (points[some][None] <= points[some][:, None]).all(2)
        np.fill_diagonal(among, False)
        some = some[~among.any(1)]
        found += some.tolist()
        best = np.concatenate((best, points[some]))
    return np.array(found, np.int64)


def pareto(results: DataFrame, key: str, lower: list[str], higher: list[str]) -> DataFrame:
    """Rows that no other row equals or beats in all metrics; equal rows eliminate each other.

    Rows of equal metrics are counted first.  Every partition keeps its own skyline, and what is left of all
    is merged in a last task: it sees points that are the best of their partition only.
    """
    metrics = [*lower, *higher]
    points = results.groupBy(*metrics).agg(F.count("*").alias("n"), F.min(key).alias(key))
    kind = points.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            x = np.column_stack([table.column(m).to_numpy().astype(float) * (1 if m in lower else -1) for m in metrics])
            held = table.take(pa.array(_skyline(x)))
        if held is not None:
            yield from held.to_batches()

    with_workers(results.sparkSession)
    return points.mapInArrow(keep, kind).repartition(1).mapInArrow(keep, kind).where("n = 1").select(key, *metrics)


def gaussian_fit(rows: DataFrame, by: list[str], value: Column, *, bins: int = 100, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Per group the mean and sigma of a Gaussian fitted to the histogram of ``value``, and sigma's error.

    Least squares over the filled bins with Poisson weights, from the moments on; null with fewer than four filled bins.
    """
    width = (high - low) / bins
    at = F.floor((value - low) / width).cast("long")
    counts = rows.withColumn("at", at).where(F.col("at").between(0, bins - 1)).groupBy(*by, "at").agg(F.count("*").alias("n"))

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        place, n = table.column("at").to_numpy(), table.column("n").to_numpy().astype(float)
        out = []
        for a, b in zip(starts, [*starts[1:], len(n)], strict=True):
            x, y = low + (place[a:b] + 0.5) * width, n[a:b]
            mean = (x * y).sum() / y.sum()
            sigma = max(np.sqrt((y * (x - mean) ** 2).sum() / y.sum()), width / 4)
            fit = np.array([y.max(), mean, sigma])
            error = None
            for _ in range(50 if b - a > 3 else 0):
                u = (x - fit[1]) / fit[2]
                e = np.exp(-u * u / 2)
                jac = np.column_stack((e, fit[0] * e * u / fit[2], fit[0] * e * u * u / fit[2])) / np.sqrt(y)[:, None]
                normal = jac.T @ jac + 1e-12 * np.eye(3)
                step = np.linalg.solve(normal, jac.T @ ((y - fit[0] * e) / np.sqrt(y)))
                fit = fit + np.clip(step, -0.5 * np.abs(fit) - width, 0.5 * np.abs(fit) + width)
                fit[2] = max(abs(fit[2]), width / 100)
                error = float(np.sqrt(np.linalg.inv(normal)[2, 2]))
                if np.abs(step / np.maximum(np.abs(fit), width)).max() < 1e-9:
                    break
            out.append((float(fit[1]), float(fit[2]), error) if error is not None else (None, None, None))
        groups = {k: table.column(k).take(pa.array(starts)) for k in by}
        return pa.table(groups | {k: pa.array([r[i] for r in out], pa.float64()) for i, k in enumerate(("mean", "sigma", "sigma_error"))})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in by)
    return by_groups(counts, by, ["at"], kernel, f"{kinds}, mean double, sigma double, sigma_error double")


def close_matches(lhs: DataFrame, rhs: DataFrame, keys: list[str], columns: list[str], uncertainty: float, ident: str) -> DataFrame:
    """Rows of ``lhs`` with an approximately equal row of ``rhs``: all ``columns`` within ``uncertainty``.

    The first column is cut into logarithmic slices no narrower than the tolerance; a row looks into its
    own slice and both neighbours by an equi-join, the exact test follows.
    """
    import math

    step = math.log((2 + uncertainty) / (2 - uncertainty)) * 1.000001 if uncertainty > 0 else 1e-9
    lead = F.col(columns[0])
    slot = lambda x: F.when(x == 0, F.lit(0)).otherwise(F.floor(F.ln(F.abs(x)) / step).cast("long"))
    left = lhs.select(*keys, ident, *columns, F.signum(lead).alias("sgn"), F.explode(F.array(slot(lead) - 1, slot(lead), slot(lead) + 1)).alias("slot"))
    right = rhs.select(*keys, *(F.col(c).alias(f"{c}_r") for c in columns), F.signum(lead).alias("sgn"), slot(lead).alias("slot"))
    close = F.lit(True)
    for c in columns:
        close = close & (F.abs(F.col(c) - F.col(f"{c}_r")) <= F.lit(uncertainty) * ((F.abs(F.col(c)) + F.abs(F.col(f"{c}_r"))) / 2))
    return left.join(right, [*keys, "sgn", "slot"]).where(close).select(ident).distinct()


def matching_rate(lhs: DataFrame, rhs: DataFrame, keys: list[str], columns: list[str], uncertainties: list[float], ident: str) -> DataFrame:
    """Per uncertainty: matched rows in per cent of the larger collection."""
    sizes = lhs.agg(F.count("*").alias("n_lhs"), F.lit(1).alias("k")).join(rhs.agg(F.count("*").alias("n_rhs"), F.lit(1).alias("k")), "k")
    out = None
    for u in uncertainties:
        n = close_matches(lhs, rhs, keys, columns, u, ident).agg(F.count("*").alias("n_matched"), F.lit(1).alias("k")).withColumn("uncertainty", F.lit(u))
        out = n if out is None else out.unionByName(n)
    return out.join(sizes, "k").select("uncertainty", "n_matched", "n_lhs", "n_rhs", (F.col("n_matched") * 100.0 / F.greatest("n_lhs", "n_rhs")).alias("rate"))
