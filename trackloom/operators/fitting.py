"""Track finding and fitting as grouped operators, and a telescope simulation to test them.

Geometry: planes perpendicular to x, a constant field along z, no material.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chi2 import upper_tail
from ..kernels import kalman as K
from ..kernels.batches import by_groups
from ..kernels.search import FindingConfig, find

SIGMA = np.array([1.0, 1.0, np.pi / 180, np.pi / 180, 0.1, 1.0])
_SEED = ("loc0", "loc1", "phi", "theta", "qop", "time")
FITTED = "event_id long, track_id long, fit_outcome int, loc0 double, loc1 double, phi double, theta double, qop double, var_loc0 double, var_loc1 double, var_phi double, var_theta double, var_qop double, chi2 double, ndf double, pval double, n_holes int"


def simulate(spark: SparkSession, events: int, tracks: int, planes: list[float], *, bz: float, sigma: float = 0.05, p: float = 1.0, seed: int = 42, spread: float = 0.3) -> DataFrame:
    """Truth states and smeared measurements of ``tracks`` tracks per event on every plane."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for event in frame["id"]:
                rng = np.random.default_rng([seed, int(event)])
                vec = np.zeros((tracks, 6))
                vec[:, 0], vec[:, 1] = rng.uniform(-50, 50, (2, tracks))
                vec[:, 2] = rng.uniform(-spread, spread, tracks)
                vec[:, 3] = np.pi / 2 + rng.uniform(-spread, spread, tracks)
                vec[:, 4] = rng.choice([-1.0, 1.0], tracks) / p
                rows = []
                for i, x in enumerate(planes):
                    if i:
                        vec, _ = K.transport(vec, np.full(tracks, x - planes[i - 1]), bz)
                    m = vec[:, :2] + rng.normal(0, sigma, (tracks, 2))
                    rows.append(pd.DataFrame({"event_id": event, "track_id": np.arange(tracks), "plane": i, "x": x, "meas_id": i * tracks + np.arange(tracks), "m0": m[:, 0], "m1": m[:, 1], "var0": sigma**2, "var1": sigma**2, "dim": 2} | {f"t_{n}": vec[:, k] for k, n in enumerate(_SEED)}))
                yield pd.concat(rows)

    schema = "event_id long, track_id long, plane int, x double, meas_id long, m0 double, m1 double, var0 double, var1 double, dim int, " + ", ".join(f"t_{n} double" for n in _SEED)
    return spark.range(events).mapInPandas(run, schema)


def normal(seed: int, *keys: str) -> Column:
    """A standard normal number of the keys alone (Box-Muller on two hashes): the same in any partitioning."""
    uniform = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), *keys), 11) + 0.5) / 2.0**53 for i in (0, 1)]
    return F.sqrt(-2 * F.ln(uniform[0])) * F.cos(2 * math.pi * uniform[1])


def smeared_seeds(truth: DataFrame, *, seed: int = 7, scale: float = 0.1) -> DataFrame:
    """Truth states on the first plane with normal errors of ``scale`` times the initial uncertainties; times have none."""
    errors = [normal(seed + i, "event_id", "track_id") * float(0.0 if n == "time" else SIGMA[i] * scale) for i, n in enumerate(_SEED)]
    return truth.where("plane = 0").select("event_id", "track_id", *((F.col(f"t_{n}") + e).alias(n) for n, e in zip(_SEED, errors, strict=True)))


def fit_tracks(states: DataFrame, seeds: DataFrame, *, bz: float, scatter: float = 0.0, iterations: int = 1) -> DataFrame:
    """Fit every (event_id, track_id): ``states`` has plane, x, m0, m1, var0, var1, dim (m0 null: a hole).

    Many whole tracks are fitted at once; their states come sorted by plane from one shuffle.
    """

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        get = lambda n: table.column(n).to_numpy()
        n = len(starts)
        size = np.diff(np.concatenate((starts, [table.num_rows])))
        m = int(size.max(initial=1))
        row = np.repeat(np.arange(n), size)
        col = np.arange(table.num_rows) - np.repeat(starts, size)

        def spread(values: np.ndarray, fill: float) -> np.ndarray:
            out = np.full((n, m), fill)
            out[row, col] = values
            return out

        x = spread(get("x"), np.nan)
        last = x[np.arange(n), size - 1]
        x = np.where(np.isnan(x), last[:, None], x)  # padding stays on the last plane, as holes
        m0, m1 = spread(get("m0").astype(float), np.nan), spread(get("m1").astype(float), np.nan)
        has = ~np.isnan(m0)
        meas = np.nan_to_num(np.stack((m0, m1), 2))
        var = np.nan_to_num(np.stack((spread(get("var0").astype(float), 1.0), spread(get("var1").astype(float), 1.0)), 2), nan=1.0)
        dim = spread(np.nan_to_num(get("dim").astype(float), nan=2), 2).astype(int)
        seed = np.stack([get(c)[starts] for c in _SEED], 1)
        out = K.fit(x, meas, var, dim, has, seed, np.broadcast_to(np.diag(SIGMA**2), (n, 6, 6)), bz, scatter=scatter, iterations=iterations)
        best, cov = out["smoothed"][:, 0], np.einsum("nii->ni", out["smoothed_cov"][:, 0])
        padding = (np.arange(m)[None, :] >= size[:, None]).sum(1)
        return pa.table({
            "event_id": get("event_id")[starts], "track_id": get("track_id")[starts], "fit_outcome": out["outcome"].astype(np.int32),
            **{c: best[:, i] for i, c in enumerate(_SEED[:5])}, **{f"var_{c}": cov[:, i] for i, c in enumerate(_SEED[:5])},
            "chi2": out["chi2"], "ndf": out["ndf"].astype(float), "pval": upper_tail(out["chi2"], out["ndf"]), "n_holes": (out["n_holes"] - padding).astype(np.int32),
        })

    rows = states.select("event_id", "track_id", "plane", "x", "m0", "m1", "var0", "var1", "dim").join(seeds, ["event_id", "track_id"])
    return by_groups(rows, ["event_id", "track_id"], ["plane"], kernel, FITTED)


def find_tracks(measurements: DataFrame, seeds: DataFrame, planes: list[float], *, bz: float, cfg: FindingConfig | None = None) -> DataFrame:
    """(event_id, seed_id, branch, pos, meas_id, chi2, ndf): candidates of every event.

    ``measurements``: event_id, plane, meas_id, m0, m1, var0, var1, dim; ``seeds``: event_id, seed_id, plane and the
    state.  An event is one group: the search follows its branches from plane to plane.
    """
    cfg = cfg or FindingConfig()

    def run(hits: pa.Table, starts: pa.Table) -> pa.Table:
        h = hits.to_pandas()
        s = starts.to_pandas().sort_values("seed_id")
        per_plane = []
        for i in range(len(planes)):
            p = h[h["plane"] == i].sort_values("meas_id")
            per_plane.append((p["meas_id"].to_numpy(), p[["m0", "m1"]].to_numpy(float), p[["var0", "var1"]].to_numpy(float), p["dim"].to_numpy()))
        cov = np.broadcast_to(np.diag(SIGMA**2), (len(s), 6, 6))
        out = find(planes, per_plane, s[list(_SEED)].to_numpy(float), cov, s["plane"].to_numpy(), bz, cfg)
        ids, event = s["seed_id"].to_numpy(), s["event_id"].iloc[0] if len(s) else 0
        count: dict[int, int] = {}
        rows = []
        for b in out:
            count[b.seed] = n = count.get(b.seed, -1) + 1
            rows += [(event, int(ids[b.seed]), n, pos, mid, b.chi2, float(b.ndf - 5)) for pos, mid in enumerate(b.meas)]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["event_id", "seed_id", "branch", "pos", "meas_id", "chi2", "ndf"])

    left = measurements.select("event_id", "plane", "meas_id", "m0", "m1", "var0", "var1", "dim")
    right = seeds.select("event_id", "seed_id", "plane", *_SEED)
    return left.groupBy("event_id").cogroup(right.groupBy("event_id")).applyInArrow(run, "event_id long, seed_id long, branch int, pos int, meas_id long, chi2 double, ndf double")


def smooth_found(found: DataFrame, measurements: DataFrame, seeds: DataFrame, *, bz: float, scatter: float = 0.0) -> DataFrame:
    """Fit and smooth the tracks of ``find_tracks``, with the seeds they were found from; track_id is seed_id * 1024 + branch."""
    own = (F.col("seed_id") * 1024 + F.col("branch")).alias("track_id")
    states = found.select("event_id", own, "meas_id").join(measurements.drop("track_id"), ["event_id", "meas_id"])
    start = found.select("event_id", "seed_id", own).distinct().join(seeds.select("event_id", "seed_id", *_SEED), ["event_id", "seed_id"]).drop("seed_id")
    return fit_tracks(states, start, bz=bz, scatter=scatter)


def simulation_tables(truth: DataFrame) -> dict[str, DataFrame]:
    """particles, hits, measurements and hit_map of simulated tracks, as a simulation writes them."""
    hit = F.col("plane") * 1_000_000 + F.col("track_id")
    return {
        "particles": truth.where("plane = 0").select("event_id", F.col("track_id").alias("particle_id"), *(f"t_{n}" for n in _SEED)),
        "hits": truth.select("event_id", hit.alias("hit_id"), F.col("track_id").alias("particle_id"), "plane", "x", F.col("t_loc0").alias("y"), F.col("t_loc1").alias("z")),
        "measurements": truth.select("event_id", "meas_id", "plane", "m0", "m1", "var0", "var1", "dim"),
        "hit_map": truth.select("event_id", hit.alias("hit_id"), "meas_id"),
    }


def generate_cells(
    spark: SparkSession, events: int, *, modules: int = 2500, size: int = 655,
    hits: tuple[float, float] = (1.65, 0.95), cells: tuple[float, float] = (1.80, 0.89), seed: int = 1,
) -> DataFrame:
    """Random cells: log-normal hits per module, log-normal cells per hit grown by random neighbour steps.

    All hits of an event grow together, one cell a step.
    """

    def one_event(event: int) -> pd.DataFrame:
        rng = np.random.default_rng([seed, event])
        module = np.repeat(np.arange(modules), rng.lognormal(*hits, modules).astype(int))
        many = np.maximum(rng.lognormal(*cells, len(module)).astype(int), 1)
        first = np.cumsum(many) - many
        place = np.empty((int(many.sum()), 2), np.int64)
        place[first] = rng.integers(0, size, (len(module), 2))
        for step in range(1, int(many.max(initial=1))):
            on = first[many > step]
            parent = on + (rng.random(len(on)) * step).astype(int)
            place[on + step] = np.clip(place[parent] + rng.integers(-1, 2, (len(on), 2)), 0, size - 1)
        rows = np.unique(np.column_stack((np.repeat(module, many), place)), axis=0)
        return pd.DataFrame({
            "event_id": event, "module_index": rows[:, 0].astype(np.int32), "channel0": rows[:, 1].astype(np.int32), "channel1": rows[:, 2].astype(np.int32),
            "activation": rng.integers(1, 100, len(rows)), "cell_id": np.arange(len(rows)) + event * 10_000_000,
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from (one_event(int(event)) for event in frame["id"])

    return spark.range(events).mapInPandas(run, "event_id long, module_index int, channel0 int, channel1 int, activation long, cell_id long")


def triplet_fit(states: DataFrame, *, bz: float, scatter: float = 0.0) -> DataFrame:
    """Momentum of every (event_id, track_id) from the triplets of its measurements (three at least).

    Tracks of equal length are fitted together.
    """
    from ..kernels import tripletfit

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        size = np.diff(np.concatenate((starts, [table.num_rows])))
        p = np.column_stack([table.column(c).to_numpy().astype(float) for c in ("x", "m0", "m1")])
        v = np.column_stack((np.zeros(table.num_rows), table.column("var0").to_numpy(), table.column("var1").to_numpy()))
        parts = []
        for m in np.unique(size[size >= 3]):
            rows = starts[size == m][:, None] + np.arange(m)
            out = tripletfit.fit(p[rows], v[rows], scatter)
            first = rows[:, 0]
            slope = np.arctan2(p[rows][:, 1, 2] - p[rows][:, 0, 2], np.hypot(p[rows][:, 1, 0] - p[rows][:, 0, 0], p[rows][:, 1, 1] - p[rows][:, 0, 1]))
            parts.append(pa.table({
                "event_id": table.column("event_id").to_numpy()[first], "track_id": table.column("track_id").to_numpy()[first],
                "qop": -out["curvature"] * np.cos(slope) / bz if bz else np.zeros(len(first)), "var_qop": out["var"] * np.cos(slope) ** 2 / bz**2 if bz else np.zeros(len(first)),
                "chi2": out["chi2"], "ndf": out["ndf"].astype(float), "pval": upper_tail(out["chi2"], out["ndf"]),
            }))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in zip(("event_id", "track_id", "qop", "var_qop", "chi2", "ndf", "pval"), (pa.int64(), pa.int64(), *[pa.float64()] * 5), strict=True)})

    rows = states.where("m0 IS NOT NULL").select("event_id", "track_id", "plane", "x", "m0", "m1", "var0", "var1")
    return by_groups(rows, ["event_id", "track_id"], ["plane"], kernel, "event_id long, track_id long, qop double, var_qop double, chi2 double, ndf double, pval double")


def truth_candidates(truth: DataFrame, *, pt_min: float = 0.0) -> DataFrame:
    """Time-ordered truth measurements of every particle above a transverse momentum, as candidates."""
    rows = truth.where(F.sin("t_theta") >= F.abs("t_qop") * pt_min)
    by = Window.partitionBy("event_id", "track_id").orderBy("plane", "meas_id")
    return rows.select("event_id", "track_id", (F.row_number().over(by) - 1).alias("pos"), "meas_id")
