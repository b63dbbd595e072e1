"""Queries of space-point binning, doublets, triplets, seeds and their parameters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import seeding as S
from .bridge import duck, points_by_event, table

QUERIES, ORACLES = {}, {}
CFG, FLT = S.SeedConfig(), S.FilterConfig()
_PHI, _Z = S.axes(CFG)


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


def _micro(c, name):
    return F.floor(c * 1e6 + 0.5).cast("long").alias(name)


_VALID = f"z >= {CFG.z_min!r} AND z <= {CFG.z_max!r} AND ATAN2(y, x) >= {-math.pi!r} AND ATAN2(y, x) <= {math.pi!r} AND FLOOR(SQRT(x * x + y * y)) < 200"
_POINTS = f"""WITH pts AS (SELECT event_id, spacepoint_id, x, y, z, SQRT(x * x + y * y) AS r, 0e0 AS var_r, 0e0 AS var_z,
    CAST(((CAST(FLOOR((ATAN2(y, x) - {-math.pi!r}) / ({math.pi!r} - {-math.pi!r}) * {float(_PHI.bins)!r}) AS BIGINT) % {_PHI.bins}) + {_PHI.bins}) % {_PHI.bins} AS BIGINT) AS phi_bin, CAST(0 AS BIGINT) AS z_bin
    FROM spacepoints WHERE {_VALID})"""
_R = CFG.min_pt / CFG.b_z  # the smallest helix radius
_HIGHLAND = 13.6e-3 * math.sqrt(CFG.rad_length) * (1 + 0.038 * math.log(CFG.rad_length))
_NEXT = f"JOIN pts o ON m.event_id = o.event_id AND (m.phi_bin - o.phi_bin + {_PHI.bins + 1}) % {_PHI.bins} <= 2"


def _pairs(name: str, bottom: bool) -> str:
    """Doublets by the cuts as they are usually written: slope of the bisector, both circle centres, the nearer one."""
    dr, dz = ("m.r - o.r", "m.z - o.z") if bottom else ("o.r - m.r", "o.z - m.z")
    return f""", {name}_near AS (SELECT m.event_id, m.spacepoint_id AS middle_id, o.spacepoint_id AS other_id, m.x AS mx, m.y AS my, m.z AS mz, m.r AS mr, o.x AS ox, o.y AS oy, o.z AS oz, o.r AS o_r,
        {dr} AS dr, {dz} AS dz FROM pts m {_NEXT} WHERE {dr} < {CFG.delta_r_max!r} AND {dr} > {CFG.delta_r_min!r}),
    {name}_flat AS (SELECT *, mz * dr - mr * dz AS z_origin, 0.5e0 * (mx + ox) AS mid_x, 0.5e0 * (my + oy) AS mid_y, (ox - mx) * (ox - mx) + (oy - my) * (oy - my) AS d2,
        CASE WHEN ox <> mx AND oy <> my THEN (oy - my) / (ox - mx) END AS slope FROM {name}_near),
    {name}_turn AS (SELECT *, SQRT({_R * _R!r} - d2 / 4e0) / SQRT((slope * slope + 1e0) / (slope * slope)) AS step FROM {name}_flat
        WHERE ABS(dz) < {CFG.cot_theta_max!r} * dr AND ABS(dz) < {CFG.delta_z_max!r} AND z_origin > {CFG.collision_min!r} * dr AND z_origin < {CFG.collision_max!r} * dr),
    {name} AS (SELECT * FROM {name}_turn WHERE slope IS NULL OR LEAST((mid_x + step) * (mid_x + step) + (mid_y - step / slope) * (mid_y - step / slope),
        (mid_x - step) * (mid_x - step) + (mid_y + step / slope) * (mid_y + step / slope)) > {(_R - CFG.impact_max) ** 2!r})"""


def _sides(name: str, side: str, bottom: bool) -> str:
    """Lines of the doublets: cot theta, and u and v in the frame whose x axis points to the middle point (variances are zero)."""
    sign = -1 if bottom else 1
    return f""", {side}_line AS (SELECT *, 1e0 / d2 AS inv2, mx / mr AS cos_m, my / mr AS sin_m FROM {name}),
    {side}_side AS (SELECT event_id, middle_id, mr, other_id AS {side}_id, o_r AS {side}_r, ox AS {side}_x, oy AS {side}_y, oz AS {side}_z, {sign}e0 * (oz - mz) * SQRT(inv2) AS {side}_cot,
        ((ox - mx) * cos_m + (oy - my) * sin_m) * inv2 AS {side}_u, ((oy - my) * cos_m - (ox - mx) * sin_m) * inv2 AS {side}_v FROM {side}_line)"""


# the line v = a u + b through both doublets; curvature and impact parameter from it
_CUTS = f""", k0 AS (SELECT b.*, t_id, t_r, t_x, t_y, t_z, t_cot, t_u, t_v, t_u - b_u AS du FROM b_side b JOIN t_side t ON b.event_id = t.event_id AND b.middle_id = t.middle_id),
    k1 AS (SELECT *, (t_v - b_v) / du AS a, (b_cot - t_cot) * (b_cot - t_cot) AS dcot2, 1e0 + b_cot * b_cot AS inv_sin2 FROM k0 WHERE du <> 0),
    k2 AS (SELECT *, 1e0 + a * a AS s2, b_v - a * b_u AS b FROM k1),
    k3 AS (SELECT *, CASE WHEN b = 0 OR {CFG.b_z!r} * SQRT(s2 / (b * b)) / 2e0 > {CFG.max_pt_scattering!r} THEN {(_HIGHLAND / CFG.max_pt_scattering) ** 2!r}
        ELSE 4e0 * (b * b / s2) * {(_HIGHLAND / CFG.b_z) ** 2!r} END AS scatter FROM k2),
    trips AS MATERIALIZED (SELECT event_id, b_id, middle_id, t_id, b / SQRT(s2) AS curvature, ABS((a - b * mr) * mr) AS impact, b_r, t_r, b_y, b_z, t_y, t_z FROM k3
      WHERE s2 >= b * b * {(2 * _R) ** 2!r} AND ABS((a - b * mr) * mr) <= {CFG.impact_max!r}
        AND (dcot2 <= 0 OR (dcot2 <= {(_HIGHLAND / CFG.min_pt) ** 2 * CFG.sigma_scattering**2!r} * inv_sin2 AND dcot2 <= scatter * inv_sin2 * {CFG.sigma_scattering**2!r})))"""

_TRIPLETS = _POINTS + _pairs("bottoms", True) + _pairs("tops", False) + _sides("bottoms", "b", True) + _sides("tops", "t", False) + _CUTS
_WEIGHTED = _TRIPLETS + f""", near AS MATERIALIZED (SELECT a.event_id, a.b_id, a.middle_id, a.t_id, o.t_id AS t2, o.t_r AS r2, ROW_NUMBER() OVER (PARTITION BY a.event_id, a.b_id, a.middle_id, a.t_id ORDER BY o.t_id) AS rn
      FROM trips a JOIN trips o ON a.event_id = o.event_id AND a.b_id = o.b_id AND a.middle_id = o.middle_id AND a.t_id <> o.t_id AND ABS(a.t_r - o.t_r) >= {FLT.delta_r_min!r}
      AND o.curvature >= a.curvature - {FLT.delta_inv_diameter!r} AND o.curvature <= a.curvature + {FLT.delta_inv_diameter!r}),
    firsts AS MATERIALIZED (SELECT event_id, b_id, middle_id, t_id, r2 AS r_first FROM near WHERE rn = 1),
    compat AS MATERIALIZED (SELECT event_id, b_id, middle_id, t_id, 1 + MAX(CASE WHEN ABS(r2 - r_first) >= {FLT.delta_r_min!r} THEN 1 ELSE 0 END) AS n_compatible FROM near JOIN firsts USING (event_id, b_id, middle_id, t_id) GROUP BY event_id, b_id, middle_id, t_id),
    heavy AS (SELECT trips.*, COALESCE(n_compatible, 0) AS n_compatible, FLOOR((-impact * {FLT.impact_factor!r} + COALESCE(n_compatible, 0) * {FLT.compatible_weight!r}
      + CASE WHEN t_r < {FLT.good_top_r!r} THEN {FLT.good_top_weight!r} WHEN b_r > {FLT.good_bottom_r!r} THEN {FLT.good_bottom_weight!r} ELSE 0e0 END) * 1e6 + 0.5e0) / 1e6 AS weight
      FROM trips LEFT JOIN compat USING (event_id, b_id, middle_id, t_id)),
    weighted AS (SELECT * FROM heavy WHERE NOT (b_r > {FLT.good_bottom_r!r} AND weight < {FLT.good_bottom_min_weight!r})),
    ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY event_id, middle_id ORDER BY weight DESC, b_y * b_y + b_z * b_z + t_y * t_y + t_z * t_z DESC, b_id, t_id) AS BIGINT) AS rank FROM weighted),
    chosen AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= {CFG.max_per_middle} AND (rank = 1 OR weight > {FLT.min_weight!r} OR b_r > {FLT.min_bottom_r!r}))"""


def _points(spark, d):
    return S.binned(table(spark, d, "spacepoints"), CFG)


def _found(spark, d, flt=None, values=()):
    return S.triplets(points_by_event(spark, d), CFG, flt, values=values, together=True)


def _weighted(spark, d):
    return S.weighted(_found(spark, d, FLT, S.WEIGHT_VALUES), FLT)


@query("fi1_valid_spacepoints", f"SELECT spacepoint_id FROM spacepoints WHERE {_VALID}")
def fi1(spark, d):
    return table(spark, d, "spacepoints").where(S.valid(CFG)).select("spacepoint_id")


@query("al5_spacepoint_binning", _POINTS + "SELECT spacepoint_id, phi_bin, z_bin FROM pts")
def al5(spark, d):
    return _points(spark, d).select("spacepoint_id", "phi_bin", "z_bin")


@query("ag5_grid_capacities", _POINTS + "SELECT event_id, phi_bin, z_bin, COUNT(*) AS n FROM pts GROUP BY event_id, phi_bin, z_bin")
def ag5(spark, d):
    return _points(spark, d).groupBy("event_id", "phi_bin", "z_bin").agg(F.count("*").alias("n"))


for _bottom, _name in ((True, "bottom"), (False, "top")):

    @query(f"jo3_{_name}_doublets", _POINTS + _pairs("ds", _bottom) + "SELECT event_id, middle_id, other_id FROM ds")
    def jo3(spark, d, bottom=_bottom):
        return S.doublets(table(spark, d, "spacepoints"), CFG).where(F.col("is_bottom") == bottom).select("event_id", "middle_id", "other_id")


@query("fi3_doublet_counts", _POINTS + _pairs("ds", True) + "SELECT event_id, COUNT(*) AS n_doublets, COUNT(DISTINCT middle_id) AS n_middles FROM ds GROUP BY event_id")
def fi3(spark, d):
    return S.doublets(table(spark, d, "spacepoints"), CFG).where("is_bottom").groupBy("event_id").agg(F.count("*").alias("n_doublets"), F.countDistinct("middle_id").alias("n_middles"))


@query("jo4_triplets", _TRIPLETS + "SELECT event_id, b_id, middle_id, t_id FROM trips")
def jo4(spark, d):
    return _found(spark, d).select("event_id", "b_id", "middle_id", "t_id")


@query("fi4_triplet_geometry", _TRIPLETS + "SELECT b_id, middle_id, t_id, CAST(FLOOR(curvature * 1e9 + 0.5e0) AS BIGINT) AS curvature_n, CAST(FLOOR(impact * 1e6 + 0.5e0) AS BIGINT) AS impact_u FROM trips")
def fi4(spark, d):
    return _found(spark, d, values=("curvature", "impact")).select("b_id", "middle_id", "t_id", F.floor(F.col("curvature") * 1e9 + 0.5).cast("long").alias("curvature_n"), _micro(F.col("impact"), "impact_u"))


@query("jo5_compatible_tops", _WEIGHTED + "SELECT b_id, middle_id, t_id, CAST(n_compatible AS BIGINT) AS n_compatible FROM heavy")
def jo5(spark, d):
    return _found(spark, d, FLT).select("b_id", "middle_id", "t_id", "n_compatible")


@query("fi5_triplet_weights", _WEIGHTED + "SELECT b_id, middle_id, t_id, CAST(FLOOR(weight * 1e6 + 0.5e0) AS BIGINT) AS weight_u FROM weighted")
def fi5(spark, d):
    return _weighted(spark, d).select("b_id", "middle_id", "t_id", _micro(F.col("weight"), "weight_u"))


@query("so4_seeds_per_middle", _WEIGHTED + "SELECT event_id, middle_id, b_id, t_id, rank FROM chosen")
def so4(spark, d):
    return S.selected(_weighted(spark, d), CFG, FLT).select("event_id", "middle_id", "b_id", "t_id", F.col("rank").cast("long").alias("rank"))


@query("al6_seed_finding", _WEIGHTED + "SELECT event_id, b_id AS bottom_id, middle_id, t_id AS top_id, CAST(FLOOR(weight * 1e6 + 0.5e0) AS BIGINT) AS quality_u FROM chosen")
def al6(spark, d):
    return S.seeds(points_by_event(spark, d), together=True).select("event_id", "bottom_id", "middle_id", "top_id", _micro(F.col("quality"), "quality_u"))


_B = 2 * S.TESLA
_PARAMS = _WEIGHTED + f""", p0 AS (SELECT c.event_id, c.b_id AS bottom_id, c.middle_id, c.t_id AS top_id, m.x - b.x AS rx, m.y - b.y AS ry, t.x - b.x AS fx, t.y - b.y AS fy, t.z - b.z AS z2
      FROM chosen c JOIN spacepoints b ON c.event_id = b.event_id AND c.b_id = b.spacepoint_id JOIN spacepoints m ON c.event_id = m.event_id AND c.middle_id = m.spacepoint_id JOIN spacepoints t ON c.event_id = t.event_id AND c.t_id = t.spacepoint_id),
    p1 AS (SELECT *, SQRT(rx * rx + ry * ry) AS n FROM p0),
    p2 AS (SELECT *, n AS x1, (fx * rx + fy * ry) / n AS x2, (fy * rx - fx * ry) / n AS y2 FROM p1),
    p3 AS (SELECT *, 1e0 / x1 AS u1, x2 / NULLIF(x2 * x2 + y2 * y2, 0e0) AS u2, y2 / NULLIF(x2 * x2 + y2 * y2, 0e0) AS v2 FROM p2),
    p4 AS (SELECT *, v2 / NULLIF(u2 - u1, 0e0) AS a FROM p3), p5 AS (SELECT *, v2 - a * u2 AS b FROM p4),
    p6 AS (SELECT *, -SQRT(1e0 + a * a) / NULLIF(2e0 * b, 0e0) AS radius FROM p5),
    p7 AS (SELECT *, z2 / COALESCE(2e0 * radius * ASIN(GREATEST(-1e0, LEAST(1e0, SQRT(x2 * x2 + y2 * y2) / (2e0 * radius)))), SQRT(x2 * x2 + y2 * y2)) AS inv_tan FROM p6)"""


@query("al8_track_parameters", _PARAMS + f"""SELECT bottom_id, middle_id, top_id, CAST(FLOOR(ATAN2((ry + rx * a) / n, (rx - ry * a) / n) * 1e6 + 0.5e0) AS BIGINT) AS phi_u,
    CAST(FLOOR(ATAN2(1e0, inv_tan) * 1e6 + 0.5e0) AS BIGINT) AS theta_u,
    CAST(FLOOR(COALESCE(1e0 / (radius * {_B!r}) / SQRT(1e0 + inv_tan * inv_tan), 0e0) * 1e6 + 0.5e0) AS BIGINT) AS qop_u FROM p7""")
def al8(spark, d):
    # parameters come before the order by middle point: that shuffles their three numbers and not nine coordinates
    sides = {"bottom": "b", "middle": "m", "top": "t"}
    places = [f"{p}_{c}" for p in sides.values() for c in "xyz"]
    found = S.weighted(_found(spark, d, FLT, list(dict.fromkeys([*S.WEIGHT_VALUES, *places]))), FLT)
    named = found.withColumns({"bottom_id": F.col("b_id"), "top_id": F.col("t_id")} | {f"{side}_{c}": F.col(f"{p}_{c}") for side, p in sides.items() for c in "xyz"})
    made = S.track_parameters(named, keep=["b_id", "t_id", "weight", "b_r", "b_y", "b_z", "t_y", "t_z"])
    rounded = made.select("*", *(_micro(F.col(c), f"{c}_u") for c in ("phi", "theta", "qop")))
    return S.selected(rounded, CFG, FLT).select(F.col("b_id").alias("bottom_id"), "middle_id", F.col("t_id").alias("top_id"), "phi_u", "theta_u", "qop_u")


@query("pr9_initial_covariance", "SELECT particle_id, CAST(FLOOR((POWER(0.1e0 * SIN(1e0 + vz / 200e0), 2) + POWER(0.1e0 * px, 2) + POWER(px / TAN(1e0 + vz / 200e0), 2) * 3.046174197867086e-4) * 1e6 + 0.5e0) AS BIGINT) AS cov_qop_u FROM particles")
def pr9(spark, d):
    rows = table(spark, d, "particles").select("particle_id", (1.0 + F.col("vz") / 200.0).alias("theta"), F.col("px").alias("qop"))
    return S.initial_covariance(rows).select("particle_id", _micro(F.col("cov_qop"), "cov_qop_u"))


@query("al4_spacepoint_formation", """WITH m AS (SELECT track_id * 100 + pos AS measurement_id, track_id % 16 AS event_id, meas_id % 50 AS surface_link, CAST(meas_id % 64 AS DOUBLE) / 8e0 AS loc0, CAST(track_id % 64 AS DOUBLE) / 4e0 AS loc1, CASE WHEN meas_id % 9 = 0 THEN 1 ELSE 2 END AS dimensions FROM track_links)
    SELECT event_id, measurement_id AS spacepoint_id, 20e0 * surface_link AS x, loc0 + 1e0 AS y, loc1 - 2e0 AS z FROM m WHERE dimensions = 2""")
def al4(spark, d):
    # planes across x, local axes along y and z
    links = table(spark, d, "track_links")
    found = links.select((F.col("track_id") * 100 + F.col("pos")).alias("measurement_id"), (F.col("track_id") % 16).alias("event_id"), (F.col("meas_id") % 50).alias("surface_link"), ((F.col("meas_id") % 64).cast("double") / 8).alias("loc0"), ((F.col("track_id") % 64).cast("double") / 4).alias("loc1"), F.when(F.col("meas_id") % 9 == 0, 1).otherwise(2).alias("dimensions"))
    zero, one = F.lit(0.0), F.lit(1.0)
    planes = spark.range(50).select(F.col("id").alias("surface_link"), (F.col("id") * 20.0).alias("cx"), one.alias("cy"), F.lit(-2.0).alias("cz"), zero.alias("rot_xu"), zero.alias("rot_xv"), one.alias("rot_yu"), zero.alias("rot_yv"), zero.alias("rot_zu"), one.alias("rot_zv"))
    return S.form_spacepoints(found, planes).select("event_id", "spacepoint_id", "x", "y", "z")
