"""Queries of small geometric functions and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graphseed
from .bridge import duck, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return keep


@query("pr7_uv_transform", "SELECT spacepoint_id, x / (x * x + y * y) AS u, y / (x * x + y * y) AS v FROM spacepoints")
def pr7(spark, d):
    u, v = G.uv_transform(F.col("x"), F.col("y"))
    return table(spark, d, "spacepoints").select("spacepoint_id", u.alias("u"), v.alias("v"))


@query("pr22_three_point_curvature", """WITH l AS (SELECT spacepoint_id, x, y, LEAD(x, 1) OVER w AS x2, LEAD(y, 1) OVER w AS y2, LEAD(x, 2) OVER w AS x3, LEAD(y, 2) OVER w AS y3 FROM spacepoints WINDOW w AS (PARTITION BY event_id ORDER BY spacepoint_id)),
    s AS (SELECT spacepoint_id, (x2 - x) * (y3 - y) - (x3 - x) * (y2 - y) AS area2, SQRT((x - x2) * (x - x2) + (y - y2) * (y - y2)) * SQRT((x2 - x3) * (x2 - x3) + (y2 - y3) * (y2 - y3)) * SQRT((x - x3) * (x - x3) + (y - y3) * (y - y3)) AS sides FROM l WHERE x3 IS NOT NULL)
    SELECT spacepoint_id, CAST(FLOOR(2e0 * area2 / sides * 1e6 + 0.5e0) AS BIGINT) AS curvature_u FROM s WHERE sides <> 0""")
def pr22(spark, d):
    by = Window.partitionBy("event_id").orderBy("spacepoint_id")
    rows = table(spark, d, "spacepoints").select("spacepoint_id", "x", "y", *(F.lead(c, i).over(by).alias(f"{c}{i + 1}") for i in (1, 2) for c in "xy")).where("x3 IS NOT NULL")
    k = G.three_point_curvature(*(F.col(c) for c in ("x", "y", "x2", "y2", "x3", "y3")))
    return rows.withColumn("k", k).where("k IS NOT NULL").select("spacepoint_id", F.floor(F.col("k") * 1e6 + 0.5).cast("long").alias("curvature_u"))


@query("pr13_local_swap", "SELECT cell_id, CASE WHEN channel0 % 2 = 0 THEN channel0 ELSE channel1 END AS first, CASE WHEN channel0 % 2 = 0 THEN channel1 ELSE channel0 END AS second FROM cells")
def pr13(spark, d):
    axis = F.col("channel0") % 2
    return table(spark, d, "cells").select("cell_id", G.local_coordinate(0, F.col("channel0"), F.col("channel1"), axis).alias("first"), G.local_coordinate(1, F.col("channel0"), F.col("channel1"), axis).alias("second"))


@query("pr15b_same_measurement", "SELECT a.track_id, ABS(a.chi2 - b.chi2) <= 0.2e0 * ((ABS(a.chi2) + ABS(b.chi2)) / 2) AND ABS(a.pval - b.pval) <= 0.2e0 * ((ABS(a.pval) + ABS(b.pval)) / 2) AND a.fit_outcome = b.fit_outcome AS same FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 9")
def pr15b(spark, d):
    t = table(spark, d, "tracks")
    as_meas = lambda name, shift: t.select((F.col("track_id") - shift).alias("track_id"), F.struct(F.col("fit_outcome").alias("surface_link"), F.col("chi2").alias("loc0"), F.col("pval").alias("loc1"), F.lit(1.0).alias("var0"), F.lit(1.0).alias("var1")).alias(name))
    return as_meas("a", 0).join(as_meas("b", 9), "track_id").select("track_id", G.same_measurement("a", "b", 0.2).alias("same"))


@query("fi2_valid_measurements", "SELECT track_id, pos FROM track_links WHERE meas_id % 9 <> 0")
def fi2(spark, d):
    rows = table(spark, d, "track_links").withColumn("dimensions", F.when(F.col("meas_id") % 9 == 0, 1).otherwise(2))
    return rows.where("dimensions = 2").select("track_id", "pos")


@query("fi11_layer_filter", "SELECT cell_id FROM cells JOIN modules USING (module_index) WHERE module_index % 4 <> 0 AND NOT (module_index % 2 = 0 AND activation > 20)")
def fi11(spark, d):
    m = F.col("module_index")
    layers = table(spark, d, "modules").where(m % 4 != 0).select("module_index", (m % 2 == 0).alias("is_barrel"))
    cells = table(spark, d, "cells").withColumn("width", F.col("activation") / 100)
    return graphseed.layer_filter(cells, layers, 0.2).select("cell_id")


@query("fi10_cell_relation", "SELECT cell_id, module_index * 1000000 + channel1 * 1000 + channel0 AS place FROM cells")
def fi10(spark, d):
    return table(spark, d, "cells").select("cell_id", (F.col("module_index") * 1000000 + F.col("channel1") * 1000 + F.col("channel0")).alias("place"))
