"""Space points to seeds: binning, doublets, triplets, weights, selection, parameters.

Lengths in mm, momenta in GeV, fields in GeV / (e mm).  Doublets and triplets come from a kernel over whole
events (``kernels.doublets``): many times the points in number, doublets are neither shuffled nor sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import Circular, Regular
from ..kernels import doublets as K
from ..kernels.batches import by_groups

TESLA = 2.99792458e-4


@dataclass(frozen=True)
class SeedConfig:
    z_min: float = -2000.0
    z_max: float = 2000.0
    r_max: float = 200.0
    collision_min: float = -250.0
    collision_max: float = 250.0
    phi_min: float = -math.pi
    phi_max: float = math.pi
    min_pt: float = 0.5
    cot_theta_max: float = 27.2845
    delta_r_min: float = 20.0
    delta_r_max: float = 80.0
    delta_z_max: float = 450.0
    impact_max: float = 10.0
    sigma_scattering: float = 3.0
    max_pt_scattering: float = 10.0
    max_per_middle: int = 5
    b_z: float = 1.99724 * TESLA
    rad_length: float = 0.05
    phi_coverage: int = 1
    neighbours: int = 1

    @property
    def highland(self) -> float:
        return 13.6e-3 * math.sqrt(self.rad_length) * (1 + 0.038 * math.log(self.rad_length))

    @property
    def max_scattering2(self) -> float:
        return (self.highland / self.min_pt) ** 2

    @property
    def min_helix_radius(self) -> float:
        return self.min_pt / self.b_z

    @property
    def min_helix_diameter2(self) -> float:
        return (2 * self.min_pt / self.b_z) ** 2

    @property
    def pt2_per_radius(self) -> float:
        return (self.highland / self.b_z) ** 2


@dataclass(frozen=True)
class FilterConfig:
    delta_inv_diameter: float = 0.00003
    impact_factor: float = 1.0
    compatible_weight: float = 200.0
    delta_r_min: float = 5.0
    good_bottom_r: float = 150.0
    good_bottom_weight: float = 400.0
    good_top_r: float = 150.0
    good_top_weight: float = 200.0
    good_bottom_min_weight: float = 380.0
    min_weight: float = 200.0
    min_bottom_r: float = 43.0


def axes(cfg: SeedConfig) -> tuple[Circular, Regular]:
    """Phi bins as wide as the largest deflection between two layers of a seed, z bins by the slope cut."""
    if cfg.b_z == 0:
        n_phi = 100
    else:
        radius = cfg.min_helix_radius
        if radius < cfg.r_max / 2:
            raise ValueError("the smallest helix must reach r_max: min_pt is too low for the field")

        def bend(r: float) -> float:
            x = r * r / (2 * radius)
            return math.atan(x / math.sqrt(r * r - x * x))

        inner_r = cfg.r_max - cfg.delta_r_max
        inner, r_min = (bend(inner_r), inner_r) if inner_r > 0 else (0.0, cfg.r_max)
        spread = abs(math.asin(cfg.impact_max / r_min) - math.asin(cfg.impact_max / cfg.r_max))
        delta = (bend(cfg.r_max) - inner + spread) / cfg.phi_coverage
        if delta <= 0:
            raise ValueError("the phi bins would have no width")
        n_phi = math.floor(2 * math.pi / delta + 1.0)
    n_z = max(1, math.floor((cfg.z_max - cfg.z_min) / (cfg.cot_theta_max * cfg.delta_r_max)))
    return Circular(n_phi, cfg.phi_min, cfg.phi_max), Regular(n_z, cfg.z_min, cfg.z_max)


def valid(cfg: SeedConfig) -> Column:
    phi = F.atan2("y", "x")
    r = F.floor(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return F.col("z").between(cfg.z_min, cfg.z_max) & phi.between(cfg.phi_min, cfg.phi_max) & (r < math.floor(cfg.r_max))


def binned(spacepoints: DataFrame, cfg: SeedConfig) -> DataFrame:
    """Valid space points with radius and bins; variances default to zero."""
    phi_axis, z_axis = axes(cfg)
    out = spacepoints.where(valid(cfg)).withColumns({"r": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "phi_bin": phi_axis.bin(F.atan2("y", "x")), "z_bin": z_axis.bin(F.col("z"))})
    for c in ("var_r", "var_z"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    return out


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


_IDS = {"b": "b_id", "m": "middle_id", "t": "t_id"}
_VALUES = ("curvature", "impact", "b_z0", "b_r", "t_r", *(f"{p}_{c}" for p in "bmt" for c in "xyz"))


def _per_event(spacepoints: DataFrame, cfg: SeedConfig, kernel: Callable[[pa.Table, dict[str, np.ndarray], np.ndarray], Iterator[dict[str, np.ndarray]]], columns: dict[str, str], together: bool) -> DataFrame:
    """Apply ``kernel`` to the valid points of many whole events.

    Positions alone are shuffled, once and by event (not if events are ``together`` in a partition already); radius
    and bins follow, and pairs never meet a shuffle.
    """
    given = [c for c in ("var_r", "var_z") if c in spacepoints.columns]
    points = spacepoints.where("event_id IS NOT NULL").where(valid(cfg)).select(F.col("event_id").cast("long"), F.col("spacepoint_id").cast("long"), "x", "y", "z", *given)
    kinds = pa.schema([(c, _ARROW[t]) for c, t in columns.items()])

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        p = {c: table.column(c).to_numpy() for c in table.column_names}
        for c in ("var_r", "var_z"):
            p.setdefault(c, np.zeros(table.num_rows))
        p["r"] = np.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=table.num_rows))
        for out in kernel(table, p, group):
            yield pa.table({c: out[c] for c in columns}, kinds)

    def prepared(rows: DataFrame) -> DataFrame:
        return binned(rows, cfg).drop("r", *(c for c in ("var_r", "var_z") if c not in given))

    return by_groups(points, ["event_id"], ["z_bin", "phi_bin"], run, ", ".join(f"{c} {t}" for c, t in columns.items()), prepare=prepared, together=together)


def doublets(spacepoints: DataFrame, cfg: SeedConfig, *, together: bool = False) -> DataFrame:
    """Pairs of a middle and another point, ``is_bottom`` where the other is nearer to the axis.

    Every middle looks up its own and the neighbouring bins for both sides.
    """
    bins = tuple(a.bins for a in axes(cfg))

    def kernel(table, p, group):
        for m, o in K.pairs(p, group, bins, cfg):
            ids = table.column("spacepoint_id")
            yield {"event_id": p["event_id"][m], "middle_id": ids.take(m), "other_id": ids.take(o), "is_bottom": pa.array(p["r"][m] > p["r"][o])}

    return _per_event(spacepoints, cfg, kernel, {"event_id": "long", "middle_id": "long", "other_id": "long", "is_bottom": "boolean"}, together)


def triplets(spacepoints: DataFrame, cfg: SeedConfig, flt: FilterConfig | None = None, *, values: Iterable[str] = _VALUES, together: bool = False) -> DataFrame:
    """Bottom and top doublets of one middle point that lie on a common helix: event_id, b_id, middle_id, t_id and ``values``.

    With ``flt`` also ``n_compatible`` (0, 1 or 2), see ``kernels.doublets.compatible_tops``.
    """
    bins = tuple(a.bins for a in axes(cfg))
    kinds = {"event_id": "long", "b_id": "long", "middle_id": "long", "t_id": "long"} | {v: "double" for v in values}
    if flt:
        kinds["n_compatible"] = "long"

    def kernel(table, p, group):
        ids = table.column("spacepoint_id").combine_chunks()
        numbers = ids.to_numpy(zero_copy_only=False)
        for found in K.triplets(p, group, bins, cfg):
            out = {"event_id": p["event_id"][found["m"]]} | {c: ids.take(pa.array(found[k])) for k, c in _IDS.items()}
            for v in values:
                if v not in found:
                    side, c = v.split("_")
                    out[v] = K.z_at_axis(p, found["m"], found["b"]) if c == "z0" else p[c][found[side]]
                else:
                    out[v] = found[v]
            if flt:
                out["n_compatible"] = K.compatible_tops(found["side"], found["curvature"], numbers[found["t"]], p["r"][found["t"]], flt)
            yield out

    return _per_event(spacepoints, cfg, kernel, kinds, together)


#: What weights and the order of the seeds need of a triplet.
WEIGHT_VALUES = ("impact", "b_r", "t_r", "b_y", "b_z", "t_y", "t_z")


def weighted(found: DataFrame, flt: FilterConfig) -> DataFrame:
    """Weights of triplets with ``n_compatible``, without those that fail the cut on a single triplet.

    A top within ``good_top_r`` replaces, not adds to, the increase of a far bottom.  Weights count to a
    millionth: ties and cuts don't hang on rounding errors of the impact parameter.
    """
    rise = F.when(F.col("t_r") < flt.good_top_r, flt.good_top_weight).when(F.col("b_r") > flt.good_bottom_r, flt.good_bottom_weight).otherwise(0.0)
    raw = -F.col("impact") * flt.impact_factor + F.col("n_compatible") * flt.compatible_weight + rise
    out = found.withColumn("weight", F.floor(raw * 1e6 + 0.5) / 1e6)
    return out.where(~((F.col("b_r") > flt.good_bottom_r) & (F.col("weight") < flt.good_bottom_min_weight)))


def selected(candidates: DataFrame, cfg: SeedConfig, flt: FilterConfig) -> DataFrame:
    """At most ``max_per_middle`` triplets per middle point: the best always, the next if they pass the last cut.

    The shuffle by middle point has weights as whole millionths and the outcome of the cut on the radius, not the radius.
    """
    size = F.col("b_y") * F.col("b_y") + F.col("b_z") * F.col("b_z") + F.col("t_y") * F.col("t_y") + F.col("t_z") * F.col("t_z")
    by = Window.partitionBy("event_id", "middle_id").orderBy(F.desc("millionths"), F.desc("size"), "b_id", "t_id")
    made = candidates.withColumns({"size": size, "far": F.col("b_r") > flt.min_bottom_r, "millionths": F.floor(F.col("weight") * 1e6 + 0.5)})
    ranked = made.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= cfg.max_per_middle).withColumn("weight", F.col("millionths") / 1e6)
    return ranked.where((F.col("rank") == 1) | (F.col("weight") > flt.min_weight) | F.col("far")).drop("size", "far", "millionths")


def seeds(spacepoints: DataFrame, cfg: SeedConfig | None = None, flt: FilterConfig | None = None, *, coordinates: bool = False, together: bool = False) -> DataFrame:
    """(event_id, bottom_id, middle_id, top_id, quality), with ``coordinates`` also bottom_x to top_z."""
    cfg, flt = cfg or SeedConfig(), flt or FilterConfig()
    places = [f"{p}_{c}" for p in "bmt" for c in "xyz"] if coordinates else []
    found = triplets(spacepoints, cfg, flt, values=dict.fromkeys([*WEIGHT_VALUES, *places]), together=together)
    best = selected(weighted(found, flt), cfg, flt)
    ids = {"bottom": "b", "middle": "m", "top": "t"}
    own = [F.col("b_id").alias("bottom_id"), F.col("middle_id"), F.col("t_id").alias("top_id"), F.col("weight").alias("quality")]
    if coordinates:
        own += [F.col(f"{short}_{c}").alias(f"{side}_{c}") for side, short in ids.items() for c in "xyz"]
    return best.select("event_id", *own)


def _vec(name: str) -> list[Column]:
    return [F.col(f"{name}_{c}") for c in "xyz"]


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list, b: list):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def track_parameters(found: DataFrame, spacepoints: DataFrame | None = None, field: tuple[float, float, float] = (0.0, 0.0, 2 * TESLA), *, keep: Iterable[str] = ()) -> DataFrame:
    """phi, theta and q/p at the bottom point of every seed, from the circle through its three points; ``keep``: columns that stay.

    A frame with its z axis along the field and its x axis towards the middle point; there the conformal
    map turns the circle into a line.  Seeds that carry no coordinates take them from ``spacepoints``.
    """
    for side in () if "bottom_x" in found.columns else ("bottom", "middle", "top"):
        found = found.join(spacepoints.select("event_id", F.col("spacepoint_id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in "xyz")), ["event_id", f"{side}_id"])
    size = math.sqrt(sum(c * c for c in field))
    ez = [F.lit(c / size) for c in field]
    rel = [a - b for a, b in zip(_vec("middle"), _vec("bottom"), strict=True)]
    raw = _cross(ez, rel)
    steps = found.withColumns({f"ey{i}": c for i, c in enumerate(raw)})
    norm = F.sqrt(_dot(*[[F.col(f"ey{i}") for i in range(3)]] * 2))
    steps = steps.withColumns({f"ey{i}": F.col(f"ey{i}") / norm for i in range(3)})
    ey = [F.col(f"ey{i}") for i in range(3)]
    steps = steps.withColumns({f"ex{i}": c for i, c in enumerate(_cross(ey, ez))})
    ex = [F.col(f"ex{i}") for i in range(3)]
    far = [a - b for a, b in zip(_vec("top"), _vec("bottom"), strict=True)]
    steps = steps.withColumns({"x1": _dot(rel, ex), "y1": _dot(rel, ey), "x2": _dot(far, ex), "y2": _dot(far, ey), "z2": _dot(far, ez)})
    d1, d2 = (F.col(f"x{i}") * F.col(f"x{i}") + F.col(f"y{i}") * F.col(f"y{i}") for i in (1, 2))
    steps = steps.withColumns({"u1": F.col("x1") / F.nullif(d1, F.lit(0.0)), "v1": F.col("y1") / F.nullif(d1, F.lit(0.0)), "u2": F.col("x2") / F.nullif(d2, F.lit(0.0)), "v2": F.col("y2") / F.nullif(d2, F.lit(0.0))})
    steps = steps.withColumn("a", (F.col("v2") - F.col("v1")) / F.nullif(F.col("u2") - F.col("u1"), F.lit(0.0))).withColumn("b", F.col("v2") - F.col("a") * F.col("u2"))
    perp = F.sqrt(1 + F.col("a") * F.col("a"))
    steps = steps.withColumn("radius", -perp / F.nullif(2 * F.col("b"), F.lit(0.0)))  # null on a straight line
    chord = F.sqrt(F.col("x2") * F.col("x2") + F.col("y2") * F.col("y2"))
    curved = 2 * F.col("radius") * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), chord / (2 * F.col("radius")))))
    # on a straight line the arc is the chord
    steps = steps.withColumn("inv_tan", F.col("z2") / F.nullif(F.coalesce(curved, chord), F.lit(0.0)))
    out = [ex[i] + ey[i] * F.col("a") + ez[i] * perp * F.col("inv_tan") for i in range(3)]
    steps = steps.withColumns({f"dir_{c}": e for c, e in zip("xyz", out, strict=True)})
    dx, dy, dz = _vec("dir")
    return steps.select(
        "event_id", "bottom_id", "middle_id", "top_id", F.atan2(dy, dx).alias("phi"), F.atan2(F.sqrt(dx * dx + dy * dy), dz).alias("theta"),
        F.coalesce(1 / (F.col("radius") * size) / F.sqrt(1 + F.col("inv_tan") * F.col("inv_tan")), F.lit(0.0)).alias("qop"),
        *keep,
    )


def initial_covariance(params: DataFrame, *, sigma: tuple[float, ...] = (1.0, 1.0, math.pi / 180, math.pi / 180, 0.0, 299.792458), sigma_qopt: float = 0.1, sigma_pt_rel: float = 0.1, inflation: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 1.0, 100.0)) -> DataFrame:
    """Diagonal of the 6 x 6 covariance: loc0, loc1, phi, theta, q/p, time."""
    names = ("loc0", "loc1", "phi", "theta", "qop", "time")
    out = {}
    for name, s, f in zip(names, sigma, inflation, strict=True):
        var = F.lit(s * s)
        if name == "qop":
            sine = F.sin("theta") * sigma_qopt
            rel = F.col("qop") * sigma_pt_rel
            slope = F.col("qop") / F.tan("theta")
            var = var + sine * sine + rel * rel + F.lit(sigma[3] ** 2 * inflation[3]) * slope * slope
        out[f"cov_{name}"] = var * f
    return params.withColumns(out)


def form_spacepoints(measurements: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Two-dimensional measurements in global coordinates: centre + rotation * (loc0, loc1, 0)."""
    rows = measurements.where("dimensions = 2").join(surfaces, "surface_link")
    point = [F.col(f"c{c}") + F.col(f"rot_{c}u") * F.col("loc0") + F.col(f"rot_{c}v") * F.col("loc1") for c in "xyz"]
    return rows.select("event_id", F.col("measurement_id").alias("spacepoint_id"), *(p.alias(c) for p, c in zip(point, "xyz", strict=True)), F.col("measurement_id").alias("measurement_1"), F.lit(None).cast("long").alias("measurement_2"), F.lit(0.0).alias("var_r"), F.lit(0.0).alias("var_z"))
