"""Queries of window-like operators, top-k selections and back-walks."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import branches as B
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


@functools.cache
def _local_folder() -> str:
    """Only for sessions without a shared folder, as in tests; removed at exit."""
    path = tempfile.mkdtemp(prefix="trackloom-")
    atexit.register(shutil.rmtree, path, True)
    return path


def kept(spark):
    """Write a table to the shared folder and read it again: cuts the lineage of iterative plans."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()

    def keep(df):
        path = f"{base.rstrip('/')}/trackloom-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


@query("wi1_prefix_sums", "WITH n AS (SELECT event_id, module_index, COUNT(*) AS n FROM cells GROUP BY event_id, module_index) SELECT event_id, module_index, n, CAST(SUM(n) OVER (PARTITION BY event_id ORDER BY module_index) AS BIGINT) AS inclusive, CAST(SUM(n) OVER (PARTITION BY event_id ORDER BY module_index) - n AS BIGINT) AS exclusive FROM n")
def wi1(spark, d):
    n = table(spark, d, "cells").groupBy("event_id", "module_index").agg(F.count("*").alias("n"))
    return B.prefix_sums(n, "event_id", "module_index", "n")


@query("wi2_branch_counter", "SELECT * FROM (SELECT seed_id, link_id, step, CAST(ROW_NUMBER() OVER (PARTITION BY seed_id ORDER BY link_id) AS BIGINT) AS branch FROM candidate_links) AS b WHERE branch <= 10")
def wi2(spark, d):
    return B.per_seed_limit(table(spark, d, "candidate_links"), 10).select("seed_id", "link_id", "step", "branch")


_HOLES = """WITH a AS (SELECT *, SUM(is_hole) OVER (PARTITION BY seed_id ORDER BY step) AS n_holes, SUM(1 - is_hole) OVER (PARTITION BY seed_id ORDER BY step) AS island FROM candidate_links),
    h AS (SELECT seed_id, link_id, step, CAST(n_holes AS BIGINT) AS n_holes, CAST(SUM(is_hole) OVER (PARTITION BY seed_id, island ORDER BY step) AS BIGINT) AS n_consecutive FROM a)"""


@query("wi3_consecutive_holes", _HOLES + "SELECT seed_id, link_id, step, n_holes, n_consecutive FROM h")
def wi3(spark, d):
    return B.consecutive_holes(table(spark, d, "candidate_links")).select("seed_id", "link_id", "step", "n_holes", "n_consecutive")


@query("fi12_hole_limits", _HOLES + ", g AS (SELECT *, MAX(CASE WHEN n_holes > 3 OR n_consecutive > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seed_id ORDER BY step) AS bad FROM h) SELECT seed_id, link_id, step + 1 - n_holes AS length FROM g WHERE bad = 0")
def fi12(spark, d):
    return B.hole_limits(table(spark, d, "candidate_links"), 3, 1).select("seed_id", "link_id", "length")


@query("wi5_track_triplets", "SELECT * FROM (SELECT track_id, pos, meas_id AS first, LEAD(meas_id, 1) OVER (PARTITION BY track_id ORDER BY pos) AS second, LEAD(meas_id, 2) OVER (PARTITION BY track_id ORDER BY pos) AS third FROM track_links) AS t WHERE third IS NOT NULL")
def wi5(spark, d):
    return B.triplets_on_track(table(spark, d, "track_links"))


@query("wi7_first_smoothed", "SELECT track_id, MIN(pos) AS pos, ARG_MIN(meas_id, pos) AS meas_id FROM track_links WHERE meas_id % 10 <> 0 GROUP BY track_id")
def wi7(spark, d):
    return B.first_smoothed(table(spark, d, "track_links").withColumn("is_smoothed", F.col("meas_id") % 10 != 0))


_CAND = "cand AS (SELECT track_id, meas_id % 20 AS surface, meas_id, CAST((track_id * 31 + meas_id * 17) % 797 AS DOUBLE) / 16e0 AS chi2 FROM (SELECT DISTINCT track_id, meas_id FROM track_links) AS l)"


def _candidates(spark, d):
    rows = table(spark, d, "track_links").select("track_id", "meas_id").distinct()
    return rows.select("track_id", (F.col("meas_id") % 20).alias("surface"), "meas_id", (((F.col("track_id") * 31 + F.col("meas_id") * 17) % 797).cast("double") / 16).alias("chi2"))


@query("so5_best_branches", f"WITH {_CAND}, r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY track_id, surface ORDER BY chi2, meas_id) AS BIGINT) AS rank FROM cand WHERE chi2 <= 30e0) SELECT track_id, surface, meas_id, chi2, rank FROM r WHERE rank <= 1")
def so5(spark, d):
    return B.best_per_surface(_candidates(spark, d), ["track_id", "surface"], 30.0, 1)


@query("so10_optimal_measurement", f"WITH {_CAND}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, surface ORDER BY chi2, meas_id) AS rn FROM cand) SELECT track_id, surface, meas_id, chi2 FROM r WHERE rn = 1")
def so10(spark, d):
    return B.optimal_measurement(_candidates(spark, d), ["track_id", "surface"])


@query("jo7_measurement_candidates", f"WITH {_CAND} SELECT t.track_id, c.meas_id, c.chi2 FROM tracks t JOIN cand c ON t.track_id = c.track_id AND t.event_id % 20 = c.surface WHERE c.chi2 <= 30e0")
def jo7(spark, d):
    t = table(spark, d, "tracks").select("track_id", (F.col("event_id") % 20).alias("surface"))
    return t.join(_candidates(spark, d), ["track_id", "surface"]).where("chi2 <= 30").select("track_id", "meas_id", "chi2")


@query("jo6_measurement_ranges", "WITH n AS (SELECT event_id, module_index, COUNT(*) AS n FROM cells GROUP BY event_id, module_index) SELECT event_id, module_index, n, CAST(SUM(n) OVER (PARTITION BY event_id ORDER BY module_index) - n AS BIGINT) AS start, CAST(SUM(n) OVER (PARTITION BY event_id ORDER BY module_index) AS BIGINT) AS stop FROM n")
def jo6(spark, d):
    return B.measurement_ranges(table(spark, d, "cells"), "event_id", "module_index")


@query("se3_adjacent_unique", "SELECT line_no, module_index FROM (SELECT line_no, module_index, LAG(module_index) OVER (PARTITION BY event_id ORDER BY line_no) AS before FROM raw_cells) AS r WHERE before IS NULL OR before <> module_index")
def se3(spark, d):
    return sanity.adjacent_unique(table(spark, d, "raw_cells"), "event_id", "line_no", "module_index").select("line_no", "module_index")


@query("se4_event_union", "SELECT event_id, cell_id FROM cells WHERE event_id % 2 = 0 UNION ALL SELECT event_id, cell_id FROM cells WHERE event_id % 2 = 1")
def se4(spark, d):
    c = table(spark, d, "cells").select("event_id", "cell_id")
    return c.where("event_id % 2 = 0").unionByName(c.where("event_id % 2 = 1"))


@query("al17_back_walk", """WITH tips AS (SELECT link_id FROM candidate_links WHERE link_id NOT IN (SELECT previous_id FROM candidate_links WHERE previous_id IS NOT NULL)),
    walk(tip_id, link_id, back) AS (SELECT link_id, link_id, CAST(0 AS BIGINT) FROM tips UNION ALL SELECT w.tip_id, c.previous_id, w.back + 1 FROM walk w JOIN candidate_links c ON w.link_id = c.link_id WHERE c.previous_id IS NOT NULL)
    SELECT tip_id, link_id, back FROM walk""", True)
def al17(spark, d):
    return B.back_walk(table(spark, d, "candidate_links"))


@query("so8_last_measurement", "SELECT track_id, MAX(pos) AS n, ARG_MAX(meas_id, pos) AS last FROM track_links GROUP BY track_id")
def so8(spark, d):
    return table(spark, d, "track_links").groupBy("track_id").agg(F.max("pos").alias("n"), F.max_by("meas_id", "pos").alias("last"))


_ENDS = "SELECT track_id, meas_id % 3 AS m, pos FROM track_links"


@query("al18_duplicate_tips", f"""WITH chains AS (SELECT track_id AS tip_id, LIST(m ORDER BY pos DESC) AS chain FROM ({_ENDS}) AS e GROUP BY track_id),
    c AS (SELECT tip_id, chain, LEN(chain) AS n, pval, ndf FROM chains JOIN tracks ON tip_id = track_id)
    SELECT DISTINCT a.tip_id FROM c a JOIN c b ON a.chain[1] = b.chain[1] AND a.n <= b.n AND b.chain[1:a.n] = a.chain AND (b.pval > a.pval OR (b.pval = a.pval AND b.tip_id < a.tip_id))
    WHERE a.n > 2 AND a.ndf > 5""")
def al18(spark, d):
    links = table(spark, d, "track_links")
    n = links.groupBy("track_id").agg(F.max("pos").alias("n"))
    walks = links.join(n, "track_id").select(F.col("track_id").alias("tip_id"), (F.col("meas_id") % 3).alias("meas_id"), (F.col("n") - F.col("pos")).alias("back"))
    return B.duplicate_tips(walks, table(spark, d, "tracks").select(F.col("track_id").alias("tip_id"), "pval", "ndf"), min_length=2)


@query("so7_sort_keys", "SELECT particle_id, CASE WHEN process = 0 THEN 1e4 ELSE 0e0 END + ABS(1e0 + vz / 200e0 - 1.5707963267948966e0) AS sort_key FROM particles")
def so7(spark, d):
    theta = 1.0 + F.col("vz") / 200.0
    return table(spark, d, "particles").select("particle_id", B.divergence_key(theta, F.col("process") != 0).alias("sort_key"))
