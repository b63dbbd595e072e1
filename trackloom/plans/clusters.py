"""Queries of clusterization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusterize as C
from ..operators import sanity
from .bridge import duck, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


@query("sc2_dedup_cells", """
    SELECT event_id, module_index, channel0, channel1, CAST(SUM(activation) AS BIGINT) AS activation,
           ARG_MIN(time_ticks, line_no) AS time_ticks, MIN(line_no) AS cell_id, COUNT(*) AS n_merged
    FROM raw_cells GROUP BY event_id, module_index, channel0, channel1""")
def sc2(spark, d):
    return C.dedup_cells(table(spark, d, "raw_cells"))


@query("sc3_raw_cells", "SELECT event_id, module_index, channel0, channel1, activation, time_ticks FROM raw_cells")
def sc3(spark, d):
    return table(spark, d, "raw_cells").select("event_id", "module_index", "channel0", "channel1", "activation", "time_ticks").sortWithinPartitions(*C.CELL_ORDER)


@query("sc4_geometry_resolve", "SELECT event_id, cell_id, geometry_id, design_id FROM cells JOIN modules USING (module_index)")
def sc4(spark, d):
    return C.resolve_modules(table(spark, d, "cells"), table(spark, d, "modules")).select("event_id", "cell_id", "geometry_id", "design_id")


@query("jo1_cell_adjacency", """
    SELECT a.event_id, a.module_index, a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b
    ON a.event_id = b.event_id AND a.module_index = b.module_index AND ABS(a.channel0 - b.channel0) <= 1 AND ABS(a.channel1 - b.channel1) <= 1
    AND (a.channel0 < b.channel0 OR a.channel0 = b.channel0 AND a.channel1 < b.channel1)""")
def jo1(spark, d):
    return C.adjacency(table(spark, d, "cells"))


_LABELLED = """
    WITH edges AS (SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b
      ON a.event_id = b.event_id AND a.module_index = b.module_index AND ABS(a.channel0 - b.channel0) <= 1 AND ABS(a.channel1 - b.channel1) <= 1),
    walk(a, b) AS (SELECT cell_id, cell_id FROM cells UNION SELECT w.a, e.b FROM walk w JOIN edges e ON w.b = e.a),
    label AS (SELECT a AS cell_id, MIN(b) AS cluster_id FROM walk GROUP BY a),
    labelled AS (SELECT cells.*, cluster_id FROM cells JOIN label USING (cell_id))"""


def _labelled(spark, d):
    return C.clusters(table(spark, d, "cells"))


@query("ag3_connected_components", _LABELLED + "SELECT event_id, module_index, cell_id, cluster_id FROM labelled", True)
def ag3(spark, d):
    return _labelled(spark, d).select("event_id", "module_index", "cell_id", "cluster_id")


@query("ag4_cluster_lists", _LABELLED + "SELECT event_id, module_index, cluster_id, COUNT(*) AS n_cells, STRING_AGG(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id) AS cell_ids FROM labelled GROUP BY event_id, module_index, cluster_id", True)
def ag4(spark, d):
    lists = C.cluster_lists(_labelled(spark, d))
    return lists.select("event_id", "module_index", "cluster_id", F.size("cell_ids").cast("long").alias("n_cells"), F.array_join("cell_ids", ",").alias("cell_ids"))


@query("al1_sparse_ccl", _LABELLED + """,
    met AS (SELECT *, MIN(channel1 * 100000 + channel0) OVER (PARTITION BY event_id, module_index, cluster_id) AS met FROM labelled)
    SELECT event_id, module_index, cell_id, CAST(DENSE_RANK() OVER (PARTITION BY event_id, module_index ORDER BY met) - 1 AS BIGINT) AS cluster_index FROM met""", True)
def al1(spark, d):
    return C.numbered_clusters(_labelled(spark, d)).select("event_id", "module_index", "cell_id", F.col("cluster_index").cast("long").alias("cluster_index"))


_MEASURED = _LABELLED + """,
    located AS (SELECT l.*, m.geometry_id, m.shift0, m.shift1, g.pitch0, g.pitch1, CAST(activation AS DOUBLE) AS w,
        ((min0 + channel0 * pitch0) + (min0 + (channel0 + 1) * pitch0)) / 2 AS x0, ((min1 + channel1 * pitch1) + (min1 + (channel1 + 1) * pitch1)) / 2 AS x1
        FROM labelled l JOIN modules m USING (module_index) JOIN designs g USING (design_id)),
    summed AS (SELECT event_id, module_index, cluster_id, MAX(geometry_id) AS surface_link, COUNT(*) AS n_cells, SUM(w) AS w, SUM(w * x0) AS s0, SUM(w * x1) AS s1,
        SUM(w * x0 * x0) AS q0, SUM(w * x1 * x1) AS q1, (MAX(channel0) - MIN(channel0) + 1) * MAX(pitch0) AS width0, (MAX(channel1) - MIN(channel1) + 1) * MAX(pitch1) AS width1,
        MAX(pitch0) AS pitch0, MAX(pitch1) AS pitch1, MAX(shift0) AS shift0, MAX(shift1) AS shift1 FROM located GROUP BY event_id, module_index, cluster_id),
    measured AS (SELECT event_id, module_index, cluster_id, surface_link, n_cells, s0 / w + shift0 AS loc0, s1 / w + shift1 AS loc1,
        q0 / w - (s0 / w) * (s0 / w) + pitch0 * pitch0 / 12 AS var0, q1 / w - (s1 / w) * (s1 / w) + pitch1 * pitch1 / 12 AS var1, width0, width1 FROM summed WHERE w > 0)"""
_SCALED = "CAST(FLOOR(loc0 * 1e6 + 0.5e0) AS BIGINT) AS loc0_u, CAST(FLOOR(loc1 * 1e6 + 0.5e0) AS BIGINT) AS loc1_u, CAST(FLOOR(var0 * 1e6 + 0.5e0) AS BIGINT) AS var0_u, CAST(FLOOR(var1 * 1e6 + 0.5e0) AS BIGINT) AS var1_u"


def _scaled(df, *cols):
    return [F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_u") for c in cols]


def _measured(spark, d, **how):
    return C.measurements(_labelled(spark, d), table(spark, d, "modules"), table(spark, d, "designs"), **how)


@query("al3_clusterization", _MEASURED + f"SELECT event_id, module_index, cluster_id, surface_link, n_cells, {_SCALED} FROM measured", True)
def al3(spark, d):
    raw = table(spark, d, "raw_cells")
    cell = ((F.col("event_id") * 50 + F.col("module_index")) * 48 + F.col("channel1")) * 48 + F.col("channel0")
    cells = C.dedup_cells(raw).withColumn("cell_id", cell)
    found = C.measurements(C.clusters(cells), table(spark, d, "modules"), table(spark, d, "designs"))
    return found.select("event_id", "module_index", "cluster_id", "surface_link", "n_cells", *_scaled(found, "loc0", "loc1", "var0", "var1"))


@query("ag1_cluster_moments", _MEASURED + f"SELECT cluster_id, n_cells, {_SCALED} FROM measured", True)
def ag1(spark, d):
    found = _measured(spark, d)
    return found.select("cluster_id", "n_cells", *_scaled(found, "loc0", "loc1", "var0", "var1"))


def _diameter_query(strategy: str, sql: str):
    @query(f"ag2_cluster_diameter_{strategy}", _MEASURED + f"SELECT cluster_id, CAST(FLOOR({sql} * 1e6 + 0.5e0) AS BIGINT) AS diameter_u FROM measured", True)
    def ag2(spark, d):
        found = _measured(spark, d, diameter=strategy)
        return found.select("cluster_id", *_scaled(found, "diameter"))


for _strategy, _sql in {"channel0": "width0", "channel1": "width1", "maximum": "GREATEST(width0, width1)", "diagonal": "SQRT(width0 * width0 + width1 * width1)"}.items():
    _diameter_query(_strategy, _sql)


@query("al2_measurement_creation", _MEASURED + "SELECT module_index, COUNT(*) AS n_measurements, CAST(SUM(n_cells) AS BIGINT) AS n_cells, MAX(n_cells) AS largest FROM measured GROUP BY module_index", True)
def al2(spark, d):
    return _measured(spark, d).groupBy("module_index").agg(F.count("*").alias("n_measurements"), F.sum("n_cells").cast("long").alias("n_cells"), F.max("n_cells").alias("largest"))


@query("so1_measurement_order", _MEASURED + "SELECT event_id, cluster_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY surface_link, loc0, loc1, var0, var1, cluster_id) - 1 AS BIGINT) AS measurement_id FROM measured", True)
def so1(spark, d):
    return C.measurement_order(_measured(spark, d)).select("event_id", "cluster_id", "measurement_id")


@query("jo2_cell_lookup", "SELECT cell_id, geometry_id, design_id, pitch0, pitch1 FROM cells JOIN modules USING (module_index) JOIN designs USING (design_id)")
def jo2(spark, d):
    found = table(spark, d, "cells").join(table(spark, d, "modules"), "module_index").join(table(spark, d, "designs"), "design_id")
    return found.select("cell_id", "geometry_id", "design_id", "pitch0", "pitch1")


@query("pr1_cell_position", "SELECT cell_id, ((min0 + channel0 * pitch0) + (min0 + (channel0 + 1) * pitch0)) / 2 AS x0, ((min1 + channel1 * pitch1) + (min1 + (channel1 + 1) * pitch1)) / 2 AS x1 FROM cells JOIN modules USING (module_index) JOIN designs USING (design_id)")
def pr1(spark, d):
    found = table(spark, d, "cells").join(table(spark, d, "modules"), "module_index").join(table(spark, d, "designs"), "design_id")
    return found.select("cell_id", C.cell_position("channel0", "pitch0", "min0").alias("x0"), C.cell_position("channel1", "pitch1", "min1").alias("x1"))


@query("so2_cell_order", "SELECT event_id, module_index, cell_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_id, module_index ORDER BY channel1, channel0) AS BIGINT) AS place FROM cells")
def so2(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy(*C.MODULE).orderBy("channel1", "channel0")
    return table(spark, d, "cells").select("event_id", "module_index", "cell_id", F.row_number().over(by).cast("long").alias("place"))


@query("fi8_contiguous_on_module", """
    WITH marked AS (SELECT event_id, module_index, LAG(module_index) OVER (PARTITION BY event_id ORDER BY line_no) AS before FROM raw_cells),
    runs AS (SELECT event_id, CAST(SUM(CASE WHEN before IS NULL OR before <> module_index THEN 1 ELSE 0 END) AS BIGINT) AS n_runs, COUNT(DISTINCT module_index) AS n_values FROM marked GROUP BY event_id)
    SELECT event_id, n_runs, n_values, n_runs = n_values AS contiguous FROM runs""")
def fi8(spark, d):
    return sanity.contiguous_on(table(spark, d, "raw_cells"), "event_id", "line_no", "module_index")


@query("fi9_ordered_on_cells", """
    WITH marked AS (SELECT event_id, channel1 * 100000 + channel0 AS k, module_index,
        LAG(channel1 * 100000 + channel0) OVER (PARTITION BY event_id, module_index ORDER BY cell_id) AS before FROM cells)
    SELECT event_id, module_index, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN before > k THEN 1 ELSE 0 END) AS BIGINT) AS n_descents,
           CAST(SUM(CASE WHEN before > k THEN 1 ELSE 0 END) AS BIGINT) = 0 AS ordered FROM marked GROUP BY event_id, module_index""")
def fi9(spark, d):
    return sanity.ordered_on(table(spark, d, "cells"), C.MODULE, "cell_id", F.col("channel1") * 100000 + F.col("channel0"))


@query("fi14_input_validity", "SELECT module_index, COUNT(*) AS n_cells, CAST(SUM(CASE WHEN activation > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM cells GROUP BY module_index")
def fi14(spark, d):
    return table(spark, d, "cells").groupBy("module_index").agg(F.count("*").alias("n_cells"), F.count_if(F.col("activation") > 0).alias("n_positive"))


@query("ag18_chain_counters", _MEASURED + """,
    sp AS (SELECT COUNT(*) AS n FROM spacepoints), rc AS (SELECT COUNT(*) AS n FROM raw_cells), ce AS (SELECT COUNT(*) AS n FROM cells), me AS (SELECT COUNT(*) AS n FROM measured)
    SELECT rc.n AS n_raw, ce.n AS n_cells, me.n AS n_measurements, sp.n AS n_spacepoints FROM rc, ce, me, sp""", True)
def ag18(spark, d):
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))  # noqa: E731  single rows
    out = one(table(spark, d, "raw_cells"), "n_raw")
    for df, name in ((table(spark, d, "cells"), "n_cells"), (_measured(spark, d), "n_measurements"), (table(spark, d, "spacepoints"), "n_spacepoints")):
        out = out.join(one(df, name), "k")
    return out.drop("k")


@query("al35_module_runs", """
    WITH sized AS (SELECT event_id, module_index, COUNT(*) AS n FROM cells GROUP BY event_id, module_index),
    placed AS (SELECT *, SUM(n) OVER (PARTITION BY event_id ORDER BY module_index) - n AS before FROM sized)
    SELECT event_id, CAST(FLOOR(before / 256.0e0) AS BIGINT) AS block, COUNT(*) AS n_modules, CAST(SUM(n) AS BIGINT) AS n_cells, MAX(n) AS largest FROM placed GROUP BY event_id, CAST(FLOOR(before / 256.0e0) AS BIGINT)""")
def al35(spark, d):
    return sanity.module_blocks(table(spark, d, "cells"), 256)


_PACKED = """WITH sized AS (SELECT event_id, module_index, COUNT(*) AS n FROM cells GROUP BY event_id, module_index),
    nth AS (SELECT event_id, n, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY module_index) AS place FROM sized),
    pack(event_id, place, bin, held) AS (SELECT event_id, place, CAST(0 AS BIGINT), n FROM nth WHERE place = 1
      UNION ALL SELECT p.event_id, m.place, CASE WHEN p.held >= 96 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.held >= 96 THEN m.n ELSE p.held + m.n END
      FROM pack p JOIN nth m ON p.event_id = m.event_id AND m.place = p.place + 1),
    bins AS (SELECT event_id, bin, COUNT(*) AS n_modules, MAX(held) AS n_cells FROM pack GROUP BY event_id, bin)"""


@query("al35_packed_modules", _PACKED + "SELECT event_id, bin, n_modules, n_cells FROM bins", True)
def al35_packed(spark, d):
    return sanity.packed_modules(table(spark, d, "cells"), 96)


@query("al35_packing_statistics", _PACKED + """SELECT event_id, CAST(SUM(n_modules) AS BIGINT) AS n_modules, CAST(SUM(n_cells) AS BIGINT) AS n_cells, COUNT(*) AS n_bins, MIN(n_cells) AS smallest, MAX(n_cells) AS largest,
    CAST(COUNT(*) * MAX(n_cells) AS DOUBLE) / SUM(n_cells) AS inefficiency FROM bins GROUP BY event_id""", True)
def al35_statistics(spark, d):
    return sanity.packing_statistics(sanity.packed_modules(table(spark, d, "cells"), 96))
