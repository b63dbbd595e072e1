"""Queries of readers' and writers' relational parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import truth as T
from ..sources import events as E
from ..sources import sinks as K
from . import seeds as _seeds
from .bridge import duck, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


@query("sc5_local_key", "SELECT l_orderkey AS measurement_id, l_linenumber, CAST(CASE WHEN l_suppkey % 8 IN (2, 3) THEN 1 WHEN l_suppkey % 8 IN (4, 5) THEN 1 WHEN l_suppkey % 8 IN (6, 7) THEN 2 ELSE 0 END AS BIGINT) AS dimensions FROM lineitem")
def sc5(spark, d):
    key = (F.col("l_suppkey") % 8).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("measurement_id"), "l_linenumber", ((key.bitwiseAND(2) != 0).cast("long") + (key.bitwiseAND(4) != 0).cast("long")).alias("dimensions"))


@query("sc6_hit_measurements", """SELECT h.event_id, h.hit_id, COALESCE(m.meas_id, -1) AS meas_id FROM (SELECT DISTINCT event_id, hit_id, CAST(FLOOR(hit_id / 30000e0) AS BIGINT) AS slot FROM hits) AS h
    LEFT JOIN (SELECT DISTINCT meas_id FROM meas_particle) AS m ON h.slot = m.meas_id""")
def sc6(spark, d):
    # thirty order numbers a part number at any scale: most hits have a measurement
    hits = table(spark, d, "hits").select("event_id", "hit_id", F.floor(F.col("hit_id") / 30000.0).alias("slot")).distinct()
    measured = table(spark, d, "meas_particle").select(F.col("meas_id").alias("slot"), "meas_id").distinct()
    return hits.join(measured, "slot", "left").select("event_id", "hit_id", F.coalesce("meas_id", F.lit(-1).cast("long")).alias("meas_id"))


@query("sc8_particle_measurements", "SELECT particle_id, STRING_AGG(CAST(meas_id AS VARCHAR), ',' ORDER BY meas_id) AS meas_ids FROM meas_particle JOIN particles USING (particle_id) GROUP BY particle_id")
def sc8(spark, d):
    mp = table(spark, d, "meas_particle").join(table(spark, d, "particles").select("particle_id"), "particle_id")
    hits = mp.select((F.col("meas_id") * 1000000 + F.col("particle_id")).alias("hit_id"), "particle_id", "meas_id")
    out = T.particle_measurements(hits.select("hit_id", "particle_id"), hits.select("hit_id", "meas_id"), table(spark, d, "particles"))
    return out.select("particle_id", F.array_join("meas_ids", ",").alias("meas_ids"))


@query("sc12_digitization_edges", "SELECT design_id, i, min0 + i * pitch0 AS edge FROM designs, (SELECT UNNEST(RANGE(0, 49)) AS i) AS r")
def sc12(spark, d):
    axis = F.struct(F.lit(48).alias("bins"), F.col("min0").alias("min"), (F.col("min0") + 48 * F.col("pitch0")).alias("max"), F.lit(None).cast("array<double>").alias("edges"))
    rows = table(spark, d, "designs").select("design_id", axis.alias("a"))
    return rows.select("design_id", F.posexplode(E.bin_edges(F.col("a"))).alias("i", "edge")).select("design_id", F.col("i").cast("long").alias("i"), "edge")


@query("sc14_wildcard_lookup", """SELECT module_index, CASE WHEN module_index % 3 = 0 AND module_index % 10 = 0 THEN 3 WHEN module_index % 10 = 0 OR module_index % 10 = 5 THEN 2 ELSE 1 END AS specificity FROM (
    SELECT module_index, CASE WHEN module_index % 10 = 0 THEN 1 WHEN module_index % 10 = 5 THEN 2 ELSE 3 END AS layer FROM modules) AS m""")
def sc14(spark, d):
    m = F.col("module_index")
    layer = F.when(m % 10 == 0, 1).when(m % 10 == 5, 2).otherwise(3).cast("long")
    modules = table(spark, d, "modules").select("module_index", F.lit(1).cast("long").alias("volume"), layer.alias("layer"), F.when((m % 10 == 0) & (m % 3 == 0), 7).otherwise(8).cast("long").alias("sensitive"))
    config = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 2), (1, 2, 0, 2), (1, 1, 7, 3)], "volume long, layer long, sensitive long, specificity int")
    return E.most_specific(modules, config, "module_index").select("module_index", "specificity")


@query("sc17_grid_field", "SELECT spacepoint_id, CAST(FLOOR(CASE WHEN ABS(x) <= 100 AND ABS(y) <= 100 AND ABS(z) <= 100 THEN 2 * x - y + 0.5e0 * z END * 1e6 + 0.5e0) AS BIGINT) AS bz_u FROM spacepoints WHERE ABS(x) <= 100 AND ABS(y) <= 100 AND ABS(z) <= 100")
def sc17(spark, d):
    # a field that is linear in the position is interpolated exactly
    axis = spark.range(5).select(F.col("id").cast("int").alias("i"))
    grid = axis.join(axis.select(F.col("i").alias("j")), F.lit(True)).join(axis.select(F.col("i").alias("k")), F.lit(True))  # 125 points
    at = lambda c: F.col(c) * 50.0 - 100.0
    grid = grid.withColumns({"bx": F.lit(0.0), "by": F.lit(0.0), "bz": 2 * at("i") - at("j") + 0.5 * at("k")})
    points = table(spark, d, "spacepoints").where("ABS(x) <= 100 AND ABS(y) <= 100 AND ABS(z) <= 100")
    out = E.grid_field(points, grid, origin=(-100.0,) * 3, step=(50.0,) * 3, size=(5, 5, 5))
    return out.select("spacepoint_id", F.floor(F.col("bz") * 1e6 + 0.5).cast("long").alias("bz_u"))


@query("sk1_cells_csv", "SELECT event_id, geometry_id, CAST(0 AS BIGINT) AS measurement_id, channel0, channel1, activation AS value FROM cells JOIN modules USING (module_index)")
def sk1(spark, d):
    cells = table(spark, d, "cells").join(table(spark, d, "modules"), "module_index").withColumn("timestamp", F.lit(0.0)).withColumnRenamed("activation", "value")
    return K.cells_csv(cells).drop("timestamp")


_MET = _seeds._WEIGHTED + """, numbered AS (SELECT event_id, b_id, middle_id, t_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY b_id, middle_id, t_id) AS n FROM chosen),
    used AS (SELECT event_id, b_id AS sp, n * 3 AS met FROM numbered UNION ALL SELECT event_id, middle_id, n * 3 + 1 FROM numbered UNION ALL SELECT event_id, t_id, n * 3 + 2 FROM numbered),
    vertices AS MATERIALIZED (SELECT event_id, sp, CAST(ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY MIN(met)) AS BIGINT) AS vertex FROM used GROUP BY event_id, sp)"""


@query("sk4_seed_lines", _MET + """SELECT c.event_id, c.b_id AS bottom_id, c.middle_id, c.t_id AS top_id, 'l ' || b.vertex || ' ' || m.vertex || ' ' || t.vertex AS line FROM chosen c
    JOIN vertices b ON c.b_id = b.sp JOIN vertices m ON c.middle_id = m.sp JOIN vertices t ON c.t_id = t.sp""")
def sk4(spark, d):
    from ..operators import seeding as S

    return K.seed_lines(S.seeds(table(spark, d, "spacepoints")))


@query("sk5_track_lines", """WITH n AS (SELECT event_id, track_id, pos, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY track_id, pos) AS vertex FROM track_links JOIN tracks USING (track_id))
    SELECT event_id, track_id, 'l ' || STRING_AGG(CAST(vertex AS VARCHAR), ' ' ORDER BY pos) AS line FROM n GROUP BY event_id, track_id""")
def sk5(spark, d):
    return K.track_lines(table(spark, d, "tracks"), table(spark, d, "track_links"))


@query("sk8_seed_report", "SELECT track_id AS seed_id, COUNT(*) AS length, COALESCE(MIN(CASE WHEN particle_id <= 50 THEN particle_id END), -1) AS particle_id FROM track_links LEFT JOIN meas_particle USING (meas_id) GROUP BY track_id")
def sk8(spark, d):
    rows = table(spark, d, "track_links").join(table(spark, d, "meas_particle"), "meas_id", "left")
    matched = rows.groupBy(F.col("track_id").alias("seed_id")).agg(F.count("*").alias("length"), F.min(F.when(F.col("particle_id") <= 50, F.col("particle_id"))).alias("particle_id"))
    return K.seed_report(matched)
