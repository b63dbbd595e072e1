"""Queries of truth matching and tracking performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusterize as C
from ..operators import truth as T
from .bridge import duck, table
from .clusters import _LABELLED

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


_CONTRIB = """WITH contrib AS (SELECT track_id, particle_id, COUNT(*) AS n_hits FROM track_links JOIN meas_particle USING (meas_id) GROUP BY track_id, particle_id),
    ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY n_hits DESC, particle_id) AS BIGINT) AS rank FROM contrib),
    sized AS (SELECT track_id, COUNT(*) AS n_meas FROM track_links GROUP BY track_id),
    truth AS (SELECT particle_id, COUNT(*) AS n_truth FROM meas_particle GROUP BY particle_id),
    found AS (SELECT track_id, particle_id, n_hits, n_meas, n_truth, CAST(n_hits AS DOUBLE) / n_meas AS purity, CAST(n_hits AS DOUBLE) / n_truth AS completeness FROM ranked JOIN sized USING (track_id) JOIN truth USING (particle_id) WHERE rank = 1)"""
# sinh(1.0) ** 2 and sinh(3.0) ** 2
_ACCEPTED = """, accepted AS (SELECT particle_id, n_truth AS n_meas FROM particles JOIN truth USING (particle_id) WHERE charge <> 0 AND px * px + py * py >= 0.25e0 AND ABS(vz) <= 500e0 AND vx * vx + vy * vy <= 40000e0
    AND pz * pz <= (px * px + py * py) * 100.35781774372317e0 AND n_truth >= 3)"""


def _inputs(spark, d):
    return table(spark, d, "track_links"), table(spark, d, "meas_particle")


@query("ag8_contributing_particles", _CONTRIB + "SELECT track_id, particle_id, n_hits, rank FROM ranked")
def ag8(spark, d):
    return T.contributions(*_inputs(spark, d))


@query("ag9_track_matching", _CONTRIB + "SELECT track_id, particle_id, n_hits, n_meas, n_truth, purity, completeness, purity >= 0.5e0 AND completeness >= 0.5e0 AS matched FROM found")
def ag9(spark, d):
    return T.matched_tracks(*_inputs(spark, d))


@query("ag10_seed_matching", _CONTRIB + "SELECT track_id, particle_id, n_hits, n_meas, purity > 0.125e0 AS matched FROM found")
def ag10(spark, d):
    return T.matched_tracks(*_inputs(spark, d), ratio=0.125, double_matching=False, strict=True).select("track_id", "particle_id", "n_hits", "n_meas", "matched")


_RATED = _CONTRIB + _ACCEPTED + """, matched AS (SELECT *, purity >= 0.2e0 AS ok FROM found),
    good AS (SELECT particle_id, COUNT(*) AS n_matched FROM matched WHERE ok GROUP BY particle_id),
    bad AS (SELECT c.particle_id, COUNT(*) AS n_fake FROM contrib c JOIN matched m ON c.track_id = m.track_id WHERE NOT ok GROUP BY c.particle_id),
    per_particle AS (SELECT particle_id, n_meas, COALESCE(n_matched, 0) AS n_matched, COALESCE(n_fake, 0) AS n_fake, GREATEST(COALESCE(n_matched, 0) - 1, 0) AS n_duplicate
        FROM accepted LEFT JOIN good USING (particle_id) LEFT JOIN bad USING (particle_id))"""


def _rated(spark, d):
    links, mp = _inputs(spark, d)
    return T.accepted_particles(table(spark, d, "particles"), mp), T.matched_tracks(links, mp, ratio=0.2, double_matching=False), links, mp


@query("ag9_particle_counters", _RATED + "SELECT particle_id, n_meas, n_matched, n_fake, n_duplicate FROM per_particle")
def ag9_counters(spark, d):
    return T.per_particle(*_rated(spark, d))


@query("ag9_rates", _RATED + """, t AS (SELECT COUNT(*) AS n_truth, CAST(SUM(CASE WHEN n_matched > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_found, CAST(SUM(n_duplicate) AS BIGINT) AS n_duplicate FROM per_particle),
    r AS (SELECT CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_fake FROM matched), n AS (SELECT COUNT(DISTINCT track_id) AS n_tracks FROM track_links)
    SELECT n_truth, n_found, n_duplicate, n_fake, n_tracks, CAST(n_found AS DOUBLE) / n_truth AS efficiency, CAST(n_duplicate AS DOUBLE) / n_found AS duplicate_rate, CAST(n_fake AS DOUBLE) / n_tracks AS fake_rate FROM t, r, n""")
def ag9_rates(spark, d):
    return T.rates(*_rated(spark, d))


@query("ag11_nseed_report", _RATED + """, lens AS (SELECT n_meas AS length, COUNT(*) AS n_seeds, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_matched FROM matched GROUP BY n_meas)
    SELECT length, n_seeds, n_matched, CAST(n_matched AS DOUBLE) / n_seeds AS precision_ FROM lens""")
def ag11(spark, d):
    found = _rated(spark, d)[1]
    out = found.groupBy(F.col("n_meas").alias("length")).agg(F.count("*").alias("n_seeds"), F.count_if("matched").alias("n_matched"))
    return out.withColumn("precision_", F.col("n_matched") / F.col("n_seeds"))


@query("ag11_nseed_totals", _RATED + """, s AS (SELECT CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_true, CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_false FROM matched),
    t AS (SELECT CAST(SUM(CASE WHEN n_matched > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_matched, CAST(SUM(CASE WHEN n_matched > 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_unmatched FROM per_particle)
    SELECT n_true, n_false, n_matched, n_unmatched, CAST(n_true AS DOUBLE) / (n_true + n_false) AS precision_, CAST(n_false AS DOUBLE) / (n_true + n_false) AS fake_rate,
    CAST(n_matched AS DOUBLE) / (n_matched + n_unmatched) AS recall FROM s, t""")
def ag11_totals(spark, d):
    accepted, found, *_ = _rated(spark, d)
    return T.nseed_report(accepted, found)


@query("ag12_exact_matcher", _CONTRIB + "SELECT track_id, MIN(particle_id) AS particle_id FROM contrib JOIN sized USING (track_id) WHERE n_hits = n_meas GROUP BY track_id")
def ag12_exact(spark, d):
    return T.exact_matcher(*_inputs(spark, d))


@query("ag12_stepped_matcher", _CONTRIB + """, able AS (SELECT track_id, particle_id, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY n_hits DESC, particle_id) AS rn FROM contrib JOIN sized USING (track_id) WHERE n_hits > 0.3e0 * n_meas AND n_hits <= n_meas)
    SELECT track_id, particle_id FROM able WHERE rn = 1""")
def ag12_stepped(spark, d):
    return T.stepped_matcher(*_inputs(spark, d), 0.3)


@query("fi6_particle_acceptance", _CONTRIB + _ACCEPTED + "SELECT particle_id, n_meas FROM accepted")
def fi6(spark, d):
    return T.accepted_particles(table(spark, d, "particles"), table(spark, d, "meas_particle")).select("particle_id", "n_meas")


@query("fi7_charged_eta_pt_cut", "SELECT particle_id FROM particles WHERE charge <> 0 AND px * px + py * py > 1e0 AND pz * pz < (px * px + py * py) * 13.154123014192036e0")
def fi7(spark, d):
    import math

    pt2 = F.col("px") * F.col("px") + F.col("py") * F.col("py")
    return table(spark, d, "particles").where((F.col("charge") != 0) & (pt2 > 1.0) & (F.col("pz") * F.col("pz") < pt2 * math.sinh(2.0) ** 2)).select("particle_id")


@query("jo8_track_states", """SELECT t.track_id, l.pos, l.meas_id, CASE WHEN l.meas_id % 5 = 0 THEN 'track_state' ELSE 'measurement' END AS type, t.pval FROM tracks t JOIN track_links l USING (track_id)""")
def jo8(spark, d):
    # a tagged link leads to a state or straight to a measurement: two left joins and a coalesce
    links = table(spark, d, "track_links").withColumn("type", F.when(F.col("meas_id") % 5 == 0, "track_state").otherwise("measurement"))
    state = links.where("type = 'track_state'").select("track_id", "pos", F.col("meas_id").alias("state_meas"))
    rows = links.join(state, ["track_id", "pos"], "left").withColumn("meas_id", F.coalesce("state_meas", "meas_id"))
    return rows.join(table(spark, d, "tracks"), "track_id").select("track_id", "pos", "meas_id", "type", "pval")


@query("jo9_truth_join", """SELECT m.meas_id, m.particle_id, p.charge, h.hit_id, h.event_id FROM meas_particle m JOIN particles p USING (particle_id) JOIN hits h USING (particle_id) WHERE h.hit_id % 50 = m.meas_id % 50""")
def jo9(spark, d):
    mp = table(spark, d, "meas_particle").withColumn("slot", F.col("meas_id") % 50)
    hits = table(spark, d, "hits").select("hit_id", "event_id", "particle_id", (F.col("hit_id") % 50).alias("slot"))
    return mp.join(table(spark, d, "particles").select("particle_id", "charge"), "particle_id").join(hits, ["particle_id", "slot"]).select("meas_id", "particle_id", "charge", "hit_id", "event_id")


_TRUTH_CELLS = "SELECT event_id, module_index, channel0, channel1, 1 + (channel0 * 7 + channel1) % 150 AS particle_id FROM cells"


@query("jo10_cluster_particles", _LABELLED + f""", tc AS ({_TRUTH_CELLS}), n AS (SELECT cluster_id, particle_id, COUNT(*) AS n_cells FROM labelled JOIN tc USING (event_id, module_index, channel0, channel1) GROUP BY cluster_id, particle_id)
    SELECT cluster_id, particle_id, n_cells, CAST(ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY n_cells DESC, particle_id) AS BIGINT) AS rank FROM n""", True)
def jo10(spark, d):
    cells = table(spark, d, "cells")
    truth = cells.select("event_id", "module_index", "channel0", "channel1", (1 + (F.col("channel0") * 7 + F.col("channel1")) % 150).alias("particle_id"))
    return T.dominant_measurement(C.clusters(cells), truth)


@query("jo11_seed_particles", """WITH seeds AS (SELECT track_id AS seed_id, meas_id, pos FROM track_links WHERE pos <= 3)
    SELECT seed_id, particle_id, COUNT(*) AS n_hits FROM seeds JOIN meas_particle USING (meas_id) GROUP BY seed_id, particle_id""")
def jo11(spark, d):
    links, mp = _inputs(spark, d)
    return T.contributions(links.where("pos <= 3").withColumnRenamed("track_id", "seed_id"), mp, "seed_id").drop("rank")


@query("wi4_time_order", "SELECT event_id, particle_id, hit_id, time_ns, CAST(ROW_NUMBER() OVER (PARTITION BY event_id, particle_id ORDER BY time_ns, hit_id, tx) - 1 AS BIGINT) AS place FROM hits")
def wi4(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("event_id", "particle_id").orderBy("time_ns", "hit_id", "tx")
    return table(spark, d, "hits").select("event_id", "particle_id", "hit_id", "time_ns", (F.row_number().over(by) - 1).cast("long").alias("place"))


@query("fi13_event_trimmer", """WITH kept AS (SELECT DISTINCT meas_id FROM meas_particle JOIN particles USING (particle_id) WHERE particle_id % 3 = 0),
    renumbered AS (SELECT meas_id, CAST(ROW_NUMBER() OVER (PARTITION BY meas_id % 16 ORDER BY meas_id) - 1 AS BIGINT) AS new_id FROM kept)
    SELECT l.track_id, l.pos, new_id AS meas_id FROM track_links l JOIN renumbered USING (meas_id)""")
def fi13(spark, d):
    mp, links = table(spark, d, "meas_particle"), table(spark, d, "track_links")
    hits = mp.select((F.col("meas_id") * 1000000 + F.col("particle_id")).alias("hit_id"), "particle_id", "meas_id")
    tables = {"particles": table(spark, d, "particles"), "hits": hits.drop("meas_id"), "hit_map": hits.select("hit_id", "meas_id"), "measurements": mp.select("meas_id").distinct().withColumn("event_id", F.col("meas_id") % 16), "links": links}
    return T.trim_events(tables, table(spark, d, "particles").where("particle_id % 3 = 0"))["links"].select("track_id", "pos", "meas_id")
