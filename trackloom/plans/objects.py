"""Queries of object equality, fields, resolution fits and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import equality as E
from ..functions import matrices
from ..operators import analytics as A
from ..operators import truth as T
from ..sources import events, sinks
from .bridge import duck, table

QUERIES, ORACLES = {}, {}
#: Relative uncertainty of the comparisons below.
UNCERTAINTY = 0.0009765625


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return keep


def _near(a: str, b: str) -> str:
    return f"ABS({a} - {b}) <= {UNCERTAINTY!r} * ((ABS({a}) + ABS({b})) / 2)"


# the other side of a comparison: every third object shifted in one coordinate, every fifth by very little
_SHIFT = "CASE WHEN spacepoint_id % 3 = 0 THEN 1.0078125e0 WHEN spacepoint_id % 5 = 0 THEN 1.000244140625e0 ELSE 1e0 END"


def _points(spark, d):
    sp = table(spark, d, "spacepoints").withColumn("f", F.expr(_SHIFT))
    a, b = F.struct("x", "y", "z").alias("a"), F.struct("x", (F.col("y") * F.col("f")).alias("y"), "z").alias("b")
    return sp.select("event_id", "spacepoint_id", a, b)


@query("pr15b_spacepoint", f"SELECT spacepoint_id, {_near('y', f'(y * {_SHIFT})')} AS same FROM spacepoints")
def pr15b_spacepoint(spark, d):
    return _points(spark, d).select("spacepoint_id", E.same_spacepoint(F.col("a"), F.col("b"), UNCERTAINTY).alias("same"))


@query("pr15b_seed", f"""WITH s AS (SELECT event_id, spacepoint_id, {_near('y', f'(y * {_SHIFT})')} AS same FROM spacepoints),
    t AS (SELECT spacepoint_id AS bottom_id, same AND LEAD(same, 1) OVER w AND LEAD(same, 2) OVER w AS same, LEAD(same, 2) OVER w AS last FROM s WINDOW w AS (PARTITION BY event_id ORDER BY spacepoint_id))
    SELECT bottom_id, same FROM t WHERE last IS NOT NULL""")
def pr15b_seed(spark, d):
    by = Window.partitionBy("event_id").orderBy("spacepoint_id")
    rows = _points(spark, d)
    three = {s: F.struct(*(F.lead(s, i).over(by).alias(n) for i, n in enumerate(("bottom", "middle", "top")))) for s in "ab"}
    rows = rows.select(F.col("spacepoint_id").alias("bottom_id"), *(c.alias(s) for s, c in three.items())).where("a.top IS NOT NULL")
    return rows.select("bottom_id", E.same_seed(F.col("a"), F.col("b"), UNCERTAINTY).alias("same"))


def _parameters(loc0, phi, surface):
    zero = F.lit(1.0)
    return F.struct(surface.alias("surface_link"), loc0.alias("loc0"), zero.alias("loc1"), phi.alias("phi"), zero.alias("theta"), (F.col("charge") + 0.5).alias("qop"), zero.alias("time"))


def _two_parameters():
    surface = F.col("particle_id") % 50
    phi = F.col("py") / 4
    a = _parameters(F.col("px"), phi, surface)
    b = _parameters(F.col("px") * F.when(F.col("process") == 1, 1.0078125).otherwise(1.0), phi + F.when(F.col("process") == 2, 0.25).otherwise(0.0), F.when(F.col("process") == 3, -1).otherwise(surface))
    return a, b


# directions agree within the uncertainty of their mean: a turn by a quarter radian never does here
_SAME = f"process <> 3 AND process <> 2 AND (process <> 1 OR {_near('px', '(px * 1.0078125e0)')})"


@query("pr15b_parameters", f"SELECT particle_id, {_SAME} AS same FROM particles WHERE ABS(py) <= 12")
def pr15b_parameters(spark, d):
    a, b = _two_parameters()
    rows = table(spark, d, "particles").where("abs(py) <= 12").select("particle_id", a.alias("a"), b.alias("b"))
    return rows.select("particle_id", E.same_parameters(F.col("a"), F.col("b"), UNCERTAINTY).alias("same"))


@query("pr15b_track_state", f"SELECT particle_id, ({_SAME}) AND particle_id % 7 <> 0 AND particle_id % 11 <> 0 AS same FROM particles WHERE ABS(py) <= 12")
def pr15b_track_state(spark, d):
    a, b = _two_parameters()

    def state(params, seven, eleven):
        one = F.lit(1.0)
        measured = F.struct(F.lit(3).alias("surface_link"), one.alias("loc0"), one.alias("loc1"), one.alias("var0"), (one + eleven).alias("var1"))
        return F.struct(
            seven.alias("state"), one.alias("filtered_chi2"), one.alias("smoothed_chi2"), one.alias("backward_chi2"), a.alias("filtered"), params.alias("smoothed"), measured.alias("measurement")
        )

    flags = [(F.col("particle_id") % k == 0).cast("int") for k in (7, 11)]
    rows = table(spark, d, "particles").where("abs(py) <= 12").select("particle_id", state(a, F.lit(0), F.lit(0)).alias("a"), state(b, *flags).alias("b"))
    return rows.select("particle_id", E.same_track_state(F.col("a"), F.col("b"), UNCERTAINTY).alias("same"))


@query("pr15b_track", f"""WITH n AS (SELECT track_id, MAX(CASE WHEN meas_id % 40 = 0 THEN 1 ELSE 0 END) AS other, COUNT(*) AS n FROM track_links GROUP BY track_id)
    SELECT track_id, track_id % 6 <> 0 AND other = 0 AND NOT (track_id % 5 = 0 AND n > 2) AND (fit_outcome <> 1 OR {_near('chi2', '(chi2 + CASE WHEN track_id % 4 = 0 THEN 1e0 ELSE 0e0 END)')}) AS same FROM tracks JOIN n USING (track_id)""")
def pr15b_track(spark, d):
    one = F.lit(1.0)
    links = table(spark, d, "track_links")

    def chain(surface):
        item = F.struct("pos", F.struct(surface.alias("surface_link"), one.alias("loc0"), one.alias("loc1"), one.alias("var0"), one.alias("var1")).alias("m"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"])

    other = F.col("meas_id") + (F.col("meas_id") % 40 == 0).cast("int")
    both = links.groupBy("track_id").agg(chain(F.col("meas_id")).alias("l_a"), chain(other).alias("l_b"), F.count("*").alias("n")).join(table(spark, d, "tracks"), "track_id")

    def track(chi2, holes, links_):
        params = F.struct(F.lit(1).alias("surface_link"), *(one.alias(c) for c in ("loc0", "loc1", "phi", "theta", "qop", "time")))
        return F.struct("fit_outcome", params.alias("params"), F.col("ndf").cast("double").alias("ndf"), chi2.alias("chi2"), "pval", holes.alias("n_holes"), links_.alias("links"))

    shorter = F.when((F.col("track_id") % 5 == 0) & (F.col("n") > 2), F.slice("l_b", 1, 2)).otherwise(F.col("l_b"))
    a = track(F.col("chi2"), F.lit(0), F.col("l_a"))
    b = track(F.col("chi2") + F.when(F.col("track_id") % 4 == 0, 1.0).otherwise(0.0), (F.col("track_id") % 6 == 0).cast("int"), shorter)
    rows = both.select("track_id", a.alias("a"), b.alias("b"))
    return rows.select("track_id", E.same_track(F.col("a"), F.col("b"), UNCERTAINTY).alias("same"))


@query("pr23_line_sign", "SELECT particle_id, CASE WHEN process = 1 AND px < 0 THEN -px ELSE px END AS observed FROM particles")
def pr23(spark, d):
    sign = matrices.line_sign(F.col("process") == 1, F.col("px"))
    return table(spark, d, "particles").select("particle_id", (sign * F.col("px")).alias("observed"))


@query("ag14_resolution_fit")
def ag14_fit(spark, d):
    rows = A.residuals(table(spark, d, "tracks").withColumns({"truth": F.col("ndf").cast("double"), "variance": F.col("ndf") * 2.0}), "chi2", "truth", "variance")
    return A.gaussian_fit(rows, ["ndf"], F.col("residual"), bins=100, low=-20.0, high=20.0)


@query("sc13_constant_field", "SELECT spacepoint_id, 0e0 AS bx, 0e0 AS by, 2e0 AS bz FROM spacepoints")
def sc13(spark, d):
    return events.constant_field(table(spark, d, "spacepoints"), (0.0, 0.0, 2.0)).select("spacepoint_id", "bx", "by", "bz")


_GRID = {"origin": (-256.0, -256.0, -512.0), "step": (64.0, 64.0, 128.0), "size": (9, 9, 9)}


@query("sc15_grid_field", """WITH c AS (SELECT spacepoint_id, LEAST(GREATEST(x, -256e0), 256e0) AS x, LEAST(GREATEST(y, -256e0), 256e0) AS y, LEAST(GREATEST(z, -512e0), 512e0) AS z FROM spacepoints)
    SELECT spacepoint_id, CAST(FLOOR((x / 64e0) * 1e4 + 0.3137e0) AS BIGINT) AS bx_n, CAST(FLOOR((y / 128e0 - x / 64e0) * 1e4 + 0.3137e0) AS BIGINT) AS by_n, CAST(FLOOR((2e0 + z / 512e0) * 1e4 + 0.3137e0) AS BIGINT) AS bz_n FROM c""")
def sc15(spark, d):
    # a field that is linear in the coordinates is interpolated exactly
    grid = events.constant_grid(spark, (0.0, 0.0, 2.0), **_GRID)
    grid = grid.withColumns({"bx": F.col("x") / 64, "by": F.col("y") / 128 - F.col("x") / 64, "bz": F.col("bz") + F.col("z") / 512}).select(*"ijk", "bx", "by", "bz")
    found = events.grid_field(table(spark, d, "spacepoints"), grid, **_GRID)
    return found.select("spacepoint_id", *(F.floor(F.col(b) * 1e4 + 0.3137).cast("long").alias(f"{b}_n") for b in ("bx", "by", "bz")))


@query("sc18_constant_grid", "SELECT CAST(i.range AS INT) AS i, CAST(j.range AS INT) AS j, CAST(k.range AS INT) AS k, -256e0 + i.range * 64e0 AS x, -512e0 + k.range * 128e0 AS z, 2e0 AS bz FROM range(9) AS i, range(9) AS j, range(9) AS k")
def sc18(spark, d):
    return events.constant_grid(spark, (0.0, 0.0, 2.0), **_GRID).select("i", "j", "k", "x", "z", "bz")


@query("sk9_seed_report", """WITH n AS (SELECT track_id AS seed_id, COUNT(*) AS length FROM track_links GROUP BY track_id),
    c AS (SELECT track_id AS seed_id, particle_id, COUNT(*) AS n_hits FROM track_links JOIN meas_particle USING (meas_id) GROUP BY track_id, particle_id),
    m AS (SELECT seed_id, MIN(particle_id) AS particle_id FROM c JOIN n USING (seed_id) WHERE n_hits = length GROUP BY seed_id)
    SELECT seed_id, length, COALESCE(particle_id, -1) AS particle_id FROM n LEFT JOIN m USING (seed_id)""")
def sk9(spark, d):
    links = table(spark, d, "track_links")
    matched = T.exact_matcher(links, table(spark, d, "meas_particle")).withColumnRenamed("track_id", "seed_id")
    sized = links.groupBy(F.col("track_id").alias("seed_id")).agg(F.count("*").alias("length"))
    return sinks.seed_report(sized.join(matched, "seed_id", "left"))
