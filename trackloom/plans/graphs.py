"""Queries of graph seeding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import graphseed as G
from .bridge import duck, table
from .windows import kept

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle, recursive)
        return f

    return keep


CFG = G.GraphConfig()
_REACH = CFG.outer_radius * CFG.tau_region
# a cluster width for most space points, so that the slope windows count
_WIDTH = "CASE WHEN spacepoint_id % 3 = 0 THEN 0e0 ELSE 0.2e0 + (spacepoint_id % 5) * 0.03125e0 END"


def _wrap(phi: str) -> str:
    return f"({phi} - FLOOR(({phi} + {math.pi!r}) / {2 * math.pi!r}) * {2 * math.pi!r})"


_NODES = f"""WITH radial AS (SELECT event_id, spacepoint_id, x, y, z, SQRT(x * x + y * y) AS r, ATAN2(y, x) AS phi, {_WIDTH} AS w FROM spacepoints),
    nodes AS (SELECT *, CAST(LEAST(GREATEST(FLOOR((ASINH(z / r) + 3e0) / 0.375e0), 0), 15) AS BIGINT) AS eta_bin,
      CAST(((CAST(FLOOR((phi + {math.pi!r}) / {2 * math.pi!r} * 64) AS BIGINT) % 64) + 64) % 64 AS BIGINT) AS phi_bin, CAST(FLOOR((r - 20) / 24) AS BIGINT) AS layer,
      CASE WHEN w > 0 THEN 6.7e0 * (w - 0.2e0) ELSE 0e0 END AS tau_min, CASE WHEN w > 0 THEN 1.6e0 + 0.15e0 / (w + 0.2e0) + 6.1e0 * (w - 0.2e0) ELSE 36e0 END AS tau_max FROM radial)"""


def _nodes(spark, d):
    return G.nodes(table(spark, d, "spacepoints").withColumn("width", F.expr(_WIDTH)), CFG)


def _pairs(spark):
    return spark.range(5).select(F.col("id").alias("layer1"), (F.col("id") + 1).alias("layer2"))


def _micro(c, name):
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(name)


@query("al9_graph_nodes", _NODES + """SELECT spacepoint_id, eta_bin, phi_bin, layer, CAST(FLOOR(tau_min * 1e6 + 0.5e0) AS BIGINT) AS tau_min_u,
    CAST(FLOOR(tau_max * 1e6 + 0.5e0) AS BIGINT) AS tau_max_u FROM nodes""")
def al9(spark, d):
    return _nodes(spark, d).select("spacepoint_id", "eta_bin", "phi_bin", "layer", _micro("tau_min", "tau_min_u"), _micro("tau_max", "tau_max_u"))


@query("pr21_bin_histogram", _NODES + "SELECT event_id, eta_bin, phi_bin, COUNT(*) AS n FROM nodes GROUP BY event_id, eta_bin, phi_bin")
def pr21(spark, d):
    return _nodes(spark, d).groupBy("event_id", "eta_bin", "phi_bin").agg(F.count("*").alias("n"))


_TABLE = ((0.1, 0.9), (0.3, -1.0), (-1.0, 2.5))


@query("pr21_tau_table", f"""WITH w AS (SELECT spacepoint_id, {_WIDTH} AS w FROM spacepoints), b AS (SELECT spacepoint_id, w, CAST(FLOOR(w * 10e0) AS BIGINT) - 1 AS bin FROM w)
    SELECT spacepoint_id, CASE WHEN w > 0 AND bin = 0 THEN 0.1e0 WHEN w > 0 AND bin = 1 THEN 0.3e0 ELSE 0e0 END AS tau_min,
    CASE WHEN w > 0 AND bin = 0 THEN 0.9e0 WHEN w > 0 AND bin = 2 THEN 2.5e0 ELSE 36e0 END AS tau_max FROM b""")
def pr21_table(spark, d):
    low, high = G.tau_window(F.expr(_WIDTH), G.GraphConfig(tau_table=_TABLE, tau_inverse_bin=10.0))
    return table(spark, d, "spacepoints").select("spacepoint_id", low.alias("tau_min"), high.alias("tau_max"))


_EDGES = _NODES + f""", extent AS (SELECT event_id, layer, MIN(r) AS lo, MAX(r) AS hi FROM nodes GROUP BY event_id, layer),
    windows AS (SELECT a.event_id, a.layer AS layer1, b.layer AS layer2, b.hi - a.lo AS apart FROM extent a JOIN extent b ON a.event_id = b.event_id AND b.layer = a.layer + 1 AND a.layer BETWEEN 0 AND 4),
    deltas AS (SELECT *, CASE WHEN apart < 60e0 THEN 0.002e0 + 4.33e-4 * apart ELSE 0.015e0 + 2.2e-4 * apart END AS delta FROM windows),
    pairs AS (SELECT w.event_id, w.delta, a.spacepoint_id AS node1, b.spacepoint_id AS node2, a.r AS r1, b.r AS r2, a.phi AS phi1, b.phi AS phi2, a.z AS z1, b.r - a.r AS dr, (b.z - a.z) / (b.r - a.r) AS tau,
        {_wrap("(b.phi - a.phi)")} AS dphi, GREATEST(a.tau_min, b.tau_min) AS tau_low, LEAST(a.tau_max, b.tau_max) AS tau_high
      FROM deltas w JOIN nodes a ON a.event_id = w.event_id AND a.layer = w.layer1 JOIN nodes b ON b.event_id = w.event_id AND b.layer = w.layer2 WHERE b.r - a.r >= 2e0),
    passed AS (SELECT *, dphi / dr AS curv FROM pairs WHERE ABS(tau) BETWEEN tau_low AND tau_high AND z1 - r1 * tau BETWEEN -160e0 AND 160e0
      AND z1 - r1 * tau + 350e0 * tau BETWEEN {-160 - _REACH!r} AND {160 + _REACH!r} AND ABS(dphi) <= delta AND r1 * r2 * (ABS(dphi / dr) - 3.75e-4) <= 0e0),
    edges AS MATERIALIZED (SELECT event_id, node1, node2, curv, SQRT(1e0 + tau * tau) - tau AS exp_eta, phi2 + curv * r2 AS phi_out, phi1 + curv * r1 AS phi_in,
      event_id * 4294967296 + ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY node1, node2) AS edge_id FROM passed)"""


def _edges(spark, d):
    return G.numbered(G.make_edges(_nodes(spark, d), _pairs(spark), CFG))


@query("jo13_graph_edges", _EDGES + "SELECT event_id, edge_id, node1, node2 FROM edges")
def jo13(spark, d):
    return _edges(spark, d).select("event_id", "edge_id", "node1", "node2")


_LINKS = _EDGES + f""", close AS (SELECT a.event_id, a.edge_id, b.edge_id AS next_id, ROW_NUMBER() OVER (PARTITION BY a.edge_id ORDER BY ABS(a.curv - b.curv), b.edge_id) AS rank
      FROM edges a JOIN edges b ON a.event_id = b.event_id AND a.node2 = b.node1
      WHERE ABS(b.exp_eta - a.exp_eta) <= 0.01e0 * a.exp_eta AND ABS({_wrap("(a.phi_out - b.phi_in)")}) <= 0.012e0 AND ABS(a.curv - b.curv) <= 0.001e0),
    links AS MATERIALIZED (SELECT event_id, edge_id, next_id FROM close WHERE rank <= 10)"""


def _links(spark, d):
    return G.link_edges(_edges(spark, d), CFG)


@query("jo14_edge_links", _LINKS + "SELECT edge_id, next_id FROM links")
def jo14(spark, d):
    return _links(spark, d).select("edge_id", "next_id")


@query("al10_compressed_graph", _LINKS + ", used AS (SELECT edge_id FROM links UNION SELECT next_id FROM links) SELECT edge_id, CAST(RANK() OVER (ORDER BY edge_id) - 1 AS BIGINT) AS index FROM used")
def al10(spark, d):
    return G.compress(_links(spark, d), kept(spark))


# on a graph without cycles the automaton's level is the number of edges on the longest path from an edge
_LEVELS = _LINKS + """, walk(edge_id, head, n) AS (SELECT edge_id, edge_id, 1 FROM edges UNION SELECT w.edge_id, l.next_id, w.n + 1 FROM walk w JOIN links l ON w.head = l.edge_id WHERE w.n < 16),
    lv AS MATERIALIZED (SELECT edge_id, CAST(MAX(n) AS BIGINT) AS level FROM walk GROUP BY edge_id)"""


def _levels(spark, d):
    keep = kept(spark)
    edges = keep(_edges(spark, d))
    links = keep(G.link_edges(edges, CFG))
    return links, G.levels(edges, links, CFG.rounds)


@query("al11_automaton_levels", _LEVELS + "SELECT edge_id, level FROM lv", True)
def al11(spark, d):
    return _levels(spark, d)[1]


_STARTS = _LEVELS + ", starts AS (SELECT edge_id, level FROM lv WHERE level >= 3 AND edge_id NOT IN (SELECT next_id FROM links))"


@query("al12_path_starts", _STARTS + "SELECT edge_id, level FROM starts", True)
def al12(spark, d):
    links, lv = _levels(spark, d)
    return G.termini(lv, links, CFG.min_level)


_PATHS = _STARTS + """, step AS (SELECT l.edge_id, MIN(l.next_id) AS next_id FROM links l JOIN lv a ON l.edge_id = a.edge_id JOIN lv b ON l.next_id = b.edge_id WHERE b.level = a.level - 1 GROUP BY l.edge_id),
    path(path_id, depth, edge_id) AS (SELECT edge_id, CAST(0 AS BIGINT), edge_id FROM starts UNION ALL SELECT p.path_id, p.depth + 1, s.next_id FROM path p JOIN step s ON p.edge_id = s.edge_id)"""


def _paths(spark, d):
    return G.walk(_links(spark, d), CFG.min_level, CFG.rounds)


@query("al12_path_walk", _PATHS + "SELECT path_id, depth, edge_id FROM path", True)
def al12_walk(spark, d):
    return _paths(spark, d).select("path_id", "depth", "edge_id")


# paths count by how often their start's number is divisible by 2, 3 and 5, besides their length
_QUALITY = "COUNT(*) * 10 + CASE WHEN path_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN path_id % 3 = 0 THEN 12 ELSE 0 END + CASE WHEN path_id % 5 = 0 THEN 21 ELSE 0 END"


def _bidding() -> str:
    """The rounds one after another: highest bids, winners of all their edges, and who shares an edge with them."""
    out = f""", quality AS (SELECT path_id, {_QUALITY} AS quality FROM path GROUP BY path_id),
    leaf AS (SELECT path_id, quality, edge_id FROM (SELECT p.path_id, p.edge_id, q.quality, ROW_NUMBER() OVER (PARTITION BY p.path_id ORDER BY depth DESC) AS n FROM path p JOIN quality q USING (path_id)) AS l WHERE n = 1),
    best AS (SELECT path_id FROM (SELECT path_id, ROW_NUMBER() OVER (PARTITION BY edge_id ORDER BY quality DESC, path_id DESC) AS n FROM leaf) AS b WHERE n = 1),
    open0 AS MATERIALIZED (SELECT p.path_id, p.edge_id, q.quality FROM path p JOIN quality q USING (path_id) WHERE p.path_id IN (SELECT path_id FROM best))"""
    for i in range(CFG.bidding_rounds):
        out += f""", ranked{i} AS (SELECT path_id, ROW_NUMBER() OVER (PARTITION BY edge_id ORDER BY quality DESC, path_id DESC) AS n FROM open{i}),
    win{i} AS MATERIALIZED (SELECT path_id FROM ranked{i} GROUP BY path_id HAVING MAX(n) = 1),
    open{i + 1} AS MATERIALIZED (SELECT * FROM open{i} WHERE path_id NOT IN (SELECT b.path_id FROM open{i} a JOIN open{i} b ON a.edge_id = b.edge_id WHERE a.path_id IN (SELECT path_id FROM win{i})))"""
    wins = " UNION ALL ".join(f"SELECT path_id, TRUE AS accepted FROM win{i}" for i in range(CFG.bidding_rounds))
    return out + f", left_over AS MATERIALIZED ({wins} UNION ALL SELECT DISTINCT path_id, FALSE AS accepted FROM open{CFG.bidding_rounds})"


_BIDS = _PATHS + _bidding()


def _quality(paths):
    return paths.groupBy("path_id").agg(F.expr(_QUALITY).alias("quality"))


@query("al14_path_bidding", _BIDS + "SELECT path_id, accepted FROM left_over", True)
def al14(spark, d):
    keep = kept(spark)
    paths = keep(_paths(spark, d))
    return G.bid(paths, _quality(paths), CFG.bidding_rounds, keep)


@query("al15_hit_bids", _BIDS + """, path_points AS (SELECT path_id, node1 AS sp FROM path JOIN edges USING (edge_id) WHERE depth = 0 UNION ALL SELECT path_id, node2 FROM path JOIN edges USING (edge_id)),
    bids AS (SELECT h.path_id, ROW_NUMBER() OVER (PARTITION BY sp ORDER BY quality DESC, h.path_id DESC) AS n FROM path_points h JOIN quality USING (path_id) WHERE h.path_id IN (SELECT path_id FROM left_over))
    SELECT path_id, SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS n_best FROM bids GROUP BY path_id HAVING SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END) >= 0.49e0 * COUNT(*)""", True)
def al15(spark, d):
    keep = kept(spark)
    edges = keep(_edges(spark, d))
    paths = keep(G.walk(G.link_edges(edges, CFG), CFG.min_level, CFG.rounds))
    quality = keep(_quality(paths))
    left = G.bid(paths, quality, CFG.bidding_rounds, keep)
    hits = G.path_hits(paths, edges).join(left, "path_id", "left_semi")
    return G.hit_bids(hits, quality, CFG.hit_share)


@query("al13_segment_fit")
def al13(spark, d):
    keep = kept(spark)
    points = keep(_nodes(spark, d))
    edges = keep(G.numbered(G.make_edges(points, _pairs(spark), CFG)))
    hits = G.path_hits(G.walk(G.link_edges(edges, CFG), CFG.min_level, CFG.rounds), edges)
    return G.segment_quality(hits, points)


@query("al16_graph_seeding")
def al16(spark, d):
    return G.graph_seeds(table(spark, d, "spacepoints"), _pairs(spark), kept(spark), CFG)
