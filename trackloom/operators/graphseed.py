"""Graph seeding: binned nodes, edges between layer pairs, edge links, levels, paths, bidding and seeds.

The event is the unit of work: ids of edges hold the event's number, joins are on the event, and levels
and paths are found by a kernel over whole events.  Where a parallel search would leave the order open,
ids give a total order, so results don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.batches import by_groups


@dataclass(frozen=True)
class GraphConfig:
    """Lengths in mm.  The numbers are the fixed default values of the cuts."""

    eta_bins: int = 16
    eta_min: float = -3.0
    eta_max: float = 3.0
    phi_bins: int = 64
    # slope |dz / dr| that a cluster's width allows
    tau_min_slope: float = 6.7
    tau_offset: float = 0.2
    tau_max_min: float = 1.6
    tau_max_correction: float = 0.15
    tau_max_slope: float = 6.1
    tau_max: float = 36.0
    #: (smallest, largest) slope for widths of (i + 1) / inverse bin width on, instead of the lines above; -1: none.
    tau_table: tuple[tuple[float, float], ...] = ()
    tau_inverse_bin: float = 0.0
    # edges
    min_delta_r: float = 2.0
    min_z0: float = -160.0
    max_z0: float = 160.0
    outer_radius: float = 350.0
    tau_region: float = 45.0
    max_kappa: float = 3.75e-4
    low_kappa_d0: float = 0.0
    high_kappa_d0: float = 0.0
    steep_tau: float = 4.0
    min_delta_phi: float = 0.015
    delta_phi_slope: float = 2.2e-4
    min_delta_phi_near: float = 0.002
    delta_phi_slope_near: float = 4.33e-4
    near_delta_r: float = 60.0
    # links
    max_phi_difference: float = 0.012
    max_curv_difference: float = 0.001
    max_tau_ratio: float = 0.01
    max_links: int = 10
    # paths and seeds
    rounds: int = 15
    min_level: int = 3
    bidding_rounds: int = 5
    hit_share: float = 0.49
    dropout: bool = True
    dropout_difference: float = 0.007
    dropout_curvature: float = 0.03
    tight_cot: float = 1.0


def wrapped(phi: Column) -> Column:
    """The angle within [-pi, pi)."""
    return phi - F.floor((phi + math.pi) / (2 * math.pi)) * (2 * math.pi)


def eta_index(z: Column, r: Column, cfg: GraphConfig) -> Column:
    """Bin of the pseudorapidity, the first and last for all beyond."""
    at = F.floor((F.asinh(z / F.nullif(r, F.lit(0.0))) - cfg.eta_min) / ((cfg.eta_max - cfg.eta_min) / cfg.eta_bins)).cast("long")
    return F.least(F.greatest(at, F.lit(0)), F.lit(cfg.eta_bins - 1))


def phi_index(phi: Column, bins: int) -> Column:
    return F.pmod(F.floor((phi + math.pi) / (2 * math.pi) * bins).cast("long"), F.lit(bins))


def tau_window(width: Column, cfg: GraphConfig) -> tuple[Column, Column]:
    """Smallest and largest slope |dz / dr| of a track through a cluster of this width; all up to ``tau_max`` without one."""
    none = F.lit(0.0), F.lit(cfg.tau_max)
    if cfg.tau_table:
        at = (F.floor(width * cfg.tau_inverse_bin) - 1).cast("int")
        known = (width > 0) & (at >= 0) & (at < len(cfg.tau_table))
        sides = (F.get(F.array(*(F.lit(float(row[i])) for row in cfg.tau_table)), at) for i in (0, 1))
        return tuple(F.when(known & (side >= 0), side).otherwise(rest) for side, rest in zip(sides, none, strict=True))
    beyond = width - cfg.tau_offset
    low = beyond * cfg.tau_min_slope
    high = cfg.tau_max_min + cfg.tau_max_correction / (width + cfg.tau_offset) + beyond * cfg.tau_max_slope
    return tuple(F.when(width > 0, side).otherwise(rest) for side, rest in zip((low, high), none, strict=True))


def layer_filter(measurements: DataFrame, layers: DataFrame, max_width: float) -> DataFrame:
    """Measurements of known layers, without wide clusters in the barrel."""
    return measurements.join(layers, "module_index").where((~F.col("is_barrel")) | (F.col("width") <= max_width))


def nodes(spacepoints: DataFrame, cfg: GraphConfig | None = None) -> DataFrame:
    """Space points with radius, angle, bins, layer and tau window; ``width`` (0: unknown) may be absent."""
    cfg = cfg or GraphConfig()
    if "width" not in spacepoints.columns:
        spacepoints = spacepoints.withColumn("width", F.lit(0.0))
    out = spacepoints.withColumns({"r": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "phi": F.atan2("y", "x")})
    low, high = tau_window(F.col("width"), cfg)
    return out.withColumns(
        {
            "eta_bin": eta_index(F.col("z"), F.col("r"), cfg), "phi_bin": phi_index(F.col("phi"), cfg.phi_bins),
            "layer": F.floor((F.col("r") - 20) / 24).cast("long"), "tau_min": low, "tau_max": high,
        }
    )


def phi_windows(points: DataFrame, layer_pairs: DataFrame, cfg: GraphConfig) -> DataFrame:
    """event_id, layer1, layer2, delta_phi: how far two nodes of a layer pair may be apart in angle."""
    extent = points.groupBy("event_id", "layer").agg(F.min("r").alias("r_min"), F.max("r").alias("r_max"))
    inner = extent.select("event_id", F.col("layer").alias("layer1"), F.col("r_min").alias("from_r"))
    outer = extent.select("event_id", F.col("layer").alias("layer2"), F.col("r_max").alias("to_r"))
    apart = F.col("to_r") - F.col("from_r")
    near = cfg.min_delta_phi_near + apart * cfg.delta_phi_slope_near
    delta = F.when(apart < cfg.near_delta_r, near).otherwise(cfg.min_delta_phi + apart * cfg.delta_phi_slope)
    return inner.join(layer_pairs, "layer1").join(outer, ["event_id", "layer2"]).select("event_id", "layer1", "layer2", delta.alias("delta_phi"))


def make_edges(points: DataFrame, layer_pairs: DataFrame, cfg: GraphConfig | None = None) -> DataFrame:
    """Edges from an inner to an outer node of a listed layer pair that one track from the beam can have made.

    The pair table is a configuration and small.  An inner node looks up the angle bins that its window
    touches, so the join is an equi-join on (event, layer, bin).  ``exp_eta``, ``curv``, and the angles
    ``phi_out`` and ``phi_in`` that the edge extrapolates from its ends to the beam serve to match edges.
    """
    cfg = cfg or GraphConfig()
    both = ("phi", "r", "z", "tau_min", "tau_max")
    width = 2 * math.pi / cfg.phi_bins
    bins = F.sequence(*(F.floor((F.col("phi1") + s * F.col("delta_phi") + math.pi) / width) for s in (-1, 1)))
    inner = points.select("event_id", F.col("spacepoint_id").alias("node1"), F.col("layer").alias("layer1"), *(F.col(c).alias(f"{c}1") for c in both))
    inner = inner.join(phi_windows(points, layer_pairs, cfg), ["event_id", "layer1"])
    inner = inner.withColumn("phi_bin", F.explode(F.array_distinct(F.transform(bins, lambda b: F.pmod(b, F.lit(cfg.phi_bins))))))
    outer = points.select("event_id", F.col("spacepoint_id").alias("node2"), F.col("layer").alias("layer2"), "phi_bin", *(F.col(c).alias(f"{c}2") for c in both))
    pairs = inner.join(outer, ["event_id", "layer2", "phi_bin"]).withColumn("dr", F.col("r2") - F.col("r1")).where(F.col("dr") >= cfg.min_delta_r)
    rise = F.nullif("dr", F.lit(0.0))  # conditions of a join may be tested in any order
    pairs = pairs.withColumn("tau", (F.col("z2") - F.col("z1")) / rise).withColumn("z0", F.col("z1") - F.col("r1") * F.col("tau"))
    steep = F.abs("tau")
    pairs = pairs.where(steep.between(F.greatest("tau_min1", "tau_min2"), F.least("tau_max1", "tau_max2")) & F.col("z0").between(cfg.min_z0, cfg.max_z0))
    reach = cfg.outer_radius * cfg.tau_region
    pairs = pairs.where((F.col("z0") + F.col("tau") * cfg.outer_radius).between(cfg.min_z0 - reach, cfg.max_z0 + reach))
    pairs = pairs.withColumn("dphi", wrapped(F.col("phi2") - F.col("phi1"))).where(F.abs("dphi") <= F.col("delta_phi")).withColumn("curv", F.col("dphi") / rise)
    d0 = F.when(steep < cfg.steep_tau, cfg.low_kappa_d0).otherwise(cfg.high_kappa_d0)
    pairs = pairs.where(F.col("r1") * F.col("r2") * (F.abs("curv") - cfg.max_kappa) <= d0)
    return pairs.select(
        "event_id", "node1", "node2", "curv", (F.sqrt(1 + F.col("tau") * F.col("tau")) - F.col("tau")).alias("exp_eta"),
        (F.col("phi2") + F.col("curv") * F.col("r2")).alias("phi_out"), (F.col("phi1") + F.col("curv") * F.col("r1")).alias("phi_in"),
    )


def numbered(edges: DataFrame) -> DataFrame:
    """edge_id: the event's number and the edge's place in it by its nodes, the same in any partitioning."""
    at = F.row_number().over(Window.partitionBy("event_id").orderBy("node1", "node2"))
    return edges.withColumn("edge_id", F.shiftleft("event_id", 32) + at)


def link_edges(edges: DataFrame, cfg: GraphConfig | None = None) -> DataFrame:
    """(event_id, edge_id, next_id): edges that start where another ends and continue it, the ``max_links`` closest in curvature."""
    cfg = cfg or GraphConfig()
    first = edges.select("event_id", "edge_id", F.col("node2").alias("node"), F.col("curv").alias("c1"), F.col("exp_eta").alias("e1"), F.col("phi_out").alias("p1"))
    then = edges.select("event_id", F.col("edge_id").alias("next_id"), F.col("node1").alias("node"), F.col("curv").alias("c2"), F.col("exp_eta").alias("e2"), F.col("phi_in").alias("p2"))
    apart = F.abs(F.col("c1") - F.col("c2"))
    close = first.join(then, ["event_id", "node"]).where(apart <= cfg.max_curv_difference)
    close = close.where((F.abs(F.col("e2") - F.col("e1")) <= cfg.max_tau_ratio * F.col("e1")) & (F.abs(wrapped(F.col("p1") - F.col("p2"))) <= cfg.max_phi_difference))
    by = Window.partitionBy("event_id", "edge_id").orderBy(apart, "next_id")
    return close.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= cfg.max_links).select("event_id", "edge_id", "next_id")


def compress(links: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges that have a link, numbered densely in the order of their ids.

    Ranges of ids are numbered each for itself; a range starts after the sizes of those before it (one
    row per range), so no task sees all edges.
    """
    keep = keep or (lambda df: df)
    used = links.select("edge_id").unionByName(links.select(F.col("next_id").alias("edge_id"))).distinct()
    ranged = keep(used.repartitionByRange("edge_id").withColumn("part", F.spark_partition_id()))
    size = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = size.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    local = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("edge_id")) - 1)
    return local.join(before, "part").select("edge_id", (F.col("before") + F.col("at")).cast("long").alias("index"))


def _levels(src: np.ndarray, dst: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Levels of ``n`` edges after synchronous rounds, in which an edge rises if a next one has its level."""
    level = np.ones(n, np.int64)
    for _ in range(rounds):
        rise = np.zeros(n, bool)
        rise[src[level[src] == level[dst]]] = True
        if not rise.any():
            break
        level += rise
    return level


def _graph(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all edges with a link, and the places of both ends of every link among them."""
    a, b = (table.column(c).to_numpy() for c in ("edge_id", "next_id"))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    return ids, at[: len(a)], at[len(a) :]


def levels(edges: DataFrame, links: DataFrame, rounds: int = 15) -> DataFrame:
    """Cellular automaton: all edges start at level 1; in a round an edge rises by one if a next edge has its level.

    Rounds are synchronous; they end when no edge rises, after ``rounds`` at most.
    """

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, src, dst = _graph(table)
        return pa.table({"edge_id": ids, "level": _levels(src, dst, len(ids), rounds)})

    risen = by_groups(links.select("event_id", "edge_id", "next_id"), ["event_id"], ["edge_id"], kernel, "edge_id long, level long")
    return edges.select("edge_id").join(risen, "edge_id", "left").select("edge_id", F.coalesce("level", F.lit(1).cast("long")).alias("level"))


def termini(levelled: DataFrame, links: DataFrame, min_level: int) -> DataFrame:
    """Edges of at least ``min_level`` that no link leads to: the starts of paths."""
    return levelled.where(F.col("level") >= min_level).join(links.select(F.col("next_id").alias("edge_id")), "edge_id", "left_anti")


def walk(links: DataFrame, min_level: int = 3, rounds: int = 15) -> DataFrame:
    """(event_id, path_id, depth, edge_id): from every start the next edge of level one lower, the smallest id of several.

    Starts are the edges of at least ``min_level`` that no link leads to; a path has its start's id.
    """

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, src, dst = _graph(table)
        level = _levels(src, dst, len(ids), rounds)
        down = level[dst] == level[src] - 1
        step = np.full(len(ids), len(ids))
        np.minimum.at(step, src[down], dst[down])  # places are in the order of ids
        led = np.zeros(len(ids), bool)
        led[dst] = True
        path = front = np.flatnonzero(~led & (level >= min_level))
        found = []
        while len(front):
            found.append((path, np.full(len(path), len(found)), front))
            after = step[front]
            path, front = path[after < len(ids)], after[after < len(ids)]
        path, depth, edge = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pa.table({"event_id": ids[path] >> 32, "path_id": ids[path], "depth": depth.astype(np.int64), "edge_id": ids[edge]})

    kind = "event_id long, path_id long, depth long, edge_id long"
    return by_groups(links.select("event_id", "edge_id", "next_id"), ["event_id"], ["edge_id"], kernel, kind)


def bid(paths: DataFrame, quality: DataFrame, rounds: int = 5, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(path_id, accepted): paths that no better one rejects, with ties to the larger path_id.

    First the paths that end in one edge bid on it and the best goes on.  Then in each round every
    undecided path bids on all its edges; a path that has the highest bid on all of them is accepted, and
    paths that share an edge with an accepted one are rejected.  What is undecided at the end stays.
    """
    keep = keep or (lambda df: df)
    rows = paths.join(quality, "path_id").select("path_id", "depth", "edge_id", "quality")
    leaf = rows.groupBy("path_id", "quality").agg(F.max_by("edge_id", "depth").alias("leaf"))
    best = leaf.groupBy("leaf").agg(F.max(F.struct("quality", "path_id")).alias("best")).select("best.path_id")
    open_ = keep(rows.join(best, "path_id", "left_semi").drop("depth"))
    done = None
    for _ in range(rounds):
        top = open_.groupBy("edge_id").agg(F.max(F.struct("quality", "path_id")).alias("best"))
        won = F.min((F.col("best.path_id") == F.col("path_id")).cast("int")).alias("all_won")
        wins = keep(open_.join(top, "edge_id").groupBy("path_id").agg(won).where("all_won = 1").select("path_id"))
        taken = open_.join(wins, "path_id").select("edge_id").distinct()
        losers = open_.join(taken, "edge_id").select("path_id").distinct()
        done = wins if done is None else done.unionByName(wins)
        open_ = keep(open_.join(losers, "path_id", "left_anti"))
        if open_.isEmpty():
            break
    accepted = done.withColumn("accepted", F.lit(True))
    return accepted.unionByName(open_.select("path_id").distinct().withColumn("accepted", F.lit(False)))


def path_hits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, pos, spacepoint_id): the inner node of the first edge, then the outer node of every edge."""
    rows = paths.join(edges.select("edge_id", "node1", "node2"), "edge_id")
    first = rows.where("depth = 0").select("path_id", F.lit(0).cast("long").alias("pos"), F.col("node1").alias("spacepoint_id"))
    return first.unionByName(rows.select("path_id", (F.col("depth") + 1).alias("pos"), F.col("node2").alias("spacepoint_id")))


def segment_quality(hits: DataFrame, points: DataFrame) -> DataFrame:
    """(path_id, n_hits, quality) of hit chains by the small filter."""
    from ..kernels.segments import quality

    rows = hits.join(points.select("spacepoint_id", "x", "y", "z"), "spacepoint_id")

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        size = np.diff(np.concatenate((starts, [table.num_rows])))
        n, m = len(starts), int(size.max(initial=1))
        row, col = np.repeat(np.arange(n), size), np.arange(table.num_rows) - np.repeat(starts, size)
        x, y, z = (table.column(c).to_numpy() for c in "xyz")

        def spread(v: np.ndarray) -> np.ndarray:
            out = np.zeros((n, m))
            out[row, col] = v
            return out

        has = spread(np.ones(table.num_rows)) > 0
        q = quality(spread(np.hypot(x, y)), spread(np.arctan2(y, x)), spread(z), has)
        return pa.table({"path_id": table.column("path_id").to_numpy()[starts], "n_hits": size.astype(np.int64), "quality": q})

    return by_groups(rows.select("path_id", "pos", "x", "y", "z"), ["path_id"], ["pos"], kernel, "path_id long, n_hits long, quality double")


def hit_bids(hits: DataFrame, quality: DataFrame, share: float = 0.49) -> DataFrame:
    """path_id, n_best: paths that are the best (ties: the larger path_id) at ``share`` of their hits or more."""
    rows = hits.join(quality.select("path_id", "quality"), "path_id")
    top = rows.groupBy("spacepoint_id").agg(F.max(F.struct("quality", "path_id")).alias("best"))
    best = F.count_if(F.col("best.path_id") == F.col("path_id")).alias("n_best")
    counts = rows.join(top, "spacepoint_id").groupBy("path_id").agg(best, F.count("*").alias("n"))
    return counts.where(F.col("n_best") >= F.col("n") * share).select("path_id", "n_best")


def _with_curvature(rows: DataFrame) -> DataFrame:
    """``k`` and ``t`` of the points a, m, c (inner, middle, outer) of every row.

    k is the signed 1 / m curvature of the circle through them, from the line that the conformal map around
    the middle point makes of it; t the slope of the outer part.  Both are zero where there is no circle.
    """
    rows = rows.withColumns({p + q: F.col(f"{p}.{q}") for p in "amc" for q in "xyz"})
    rows = rows.withColumns({"r": F.expr("SQRT(mx * mx + my * my)"), "outer": F.expr("SQRT(cx * cx + cy * cy)")})
    for p in "ac":
        rows = rows.withColumns({"dx": F.col(f"{p}x") - F.col("mx"), "dy": F.col(f"{p}y") - F.col("my")})
        rows = rows.withColumn("size", F.expr("NULLIF((dx * dx + dy * dy) * r, 0e0)"))
        rows = rows.withColumns({f"u{p}": F.expr("(dx * mx + dy * my) / size"), f"v{p}": F.expr("(dy * mx - dx * my) / size")})
    rows = rows.withColumn("line", F.expr("(va - vc) / NULLIF(ua - uc, 0e0)"))
    curvature = F.expr("COALESCE(1000e0 * (vc - line * uc) / SQRT(1e0 + line * line), 0e0)")
    return rows.withColumns({"k": curvature, "t": F.expr("COALESCE(CASE WHEN line IS NOT NULL THEN (cz - mz) / NULLIF(outer - r, 0e0) END, 0e0)")})


def convert_seeds(hits: DataFrame, points: DataFrame, chosen: DataFrame, cfg: GraphConfig | None = None) -> DataFrame:
    """Three-point seeds (path_id, bottom_id, middle_id, top_id) of the chosen paths (path_id, n_best).

    The first hit, a middle one and the last give one seed.  With ``dropout`` three choices (either middle,
    or the second hit as the bottom) are compared in curvature: of choices that agree one is taken, and one
    that doesn't is taken as well; short central paths that aren't the best at nearly all hits are left out.
    """
    cfg = cfg or GraphConfig()
    at = F.struct("pos", "spacepoint_id", "x", "y", "z")
    rows = hits.join(chosen, "path_id").join(points.select("spacepoint_id", "x", "y", "z"), "spacepoint_id")
    rows = rows.groupBy("path_id", "n_best").agg(F.sort_array(F.collect_list(at)).alias("h"), F.count("*").alias("n")).where("n >= 3")
    half = F.floor((F.col("n") - 1) / 2)
    inner, later = (F.greatest(F.col("n") - k - half, F.lit(1)).cast("int") for k in (2, 1))
    places = {"first": F.lit(0), "second": F.lit(1), "inner": inner, "later": later, "last": (F.col("n") - 1).cast("int")}
    rows = rows.withColumns({name: F.get("h", i) for name, i in places.items()}).drop("h")
    choices = [("first", "inner", "last"), ("first", "later", "last"), ("second", "later", "last")]
    rows = rows.select("path_id", "n_best", "n", F.inline(F.array(*(F.struct(F.lit(i).alias("choice"), *(F.col(p).alias(q) for p, q in zip(s, "amc", strict=True))) for i, s in enumerate(choices)))))
    seed = F.struct(*(F.col(f"{p}.spacepoint_id").alias(name) for p, name in zip("amc", ("bottom_id", "middle_id", "top_id"), strict=True)))
    if not cfg.dropout:
        return rows.where("choice = 0").select("path_id", seed.alias("s")).select("path_id", "s.*")
    # one row a choice for the geometry, then one row a path again
    rows = _with_curvature(rows).select("path_id", "n_best", "n", "choice", "k", "t", seed.alias("s"))
    of = lambda c, i: F.max(F.when(F.col("choice") == i, F.col(c))).alias(f"{c}{i}")
    rows = rows.groupBy("path_id", "n_best", "n").agg(*(of(c, i) for c in "kts" for i in range(3)))
    seeds = [F.col(f"s{i}") for i in range(3)]
    central = F.abs(F.col("t0") + F.col("t1") + F.col("t2")) < 3 * cfg.tight_cot
    rows = rows.where(~((F.col("n_best") < F.col("n") - 1) & central & (F.col("n") < 5)))
    like = lambda i, j: F.abs(F.col(f"k{i}") - F.col(f"k{j}")) < cfg.dropout_difference
    rows = rows.withColumns({"like01": like(0, 1), "like12": like(1, 2), "like02": like(0, 2)})
    none = ~(F.col("like01") | F.col("like12") | F.col("like02"))
    every = (F.abs(F.col("k0") + F.col("k1") + F.col("k2")) < 3 * cfg.dropout_curvature) | (central & none)
    # a choice goes if it agrees with exactly the one of two others that represents it
    only = lambda *on: F.expr(" AND ".join(c if c in on else f"NOT {c}" for c in ("like01", "like12", "like02")))
    takes = [
        ~(only("like12", "like02") | only("like01", "like12")) | every,
        only("like02") | only("like01", "like12"),
        only("like12") | only("like12", "like02") | only("like01") | every,
    ]
    taken = F.array_compact(F.array(*(F.when(take, seed) for take, seed in zip(takes, seeds, strict=True))))
    return rows.select("path_id", F.inline(taken))


def graph_seeds(spacepoints: DataFrame, layer_pairs: DataFrame, keep: Callable[[DataFrame], DataFrame], cfg: GraphConfig | None = None) -> DataFrame:
    """Space points to seeds: nodes, edges, links, paths, fit, bids for edges and hits, conversion."""
    cfg = cfg or GraphConfig()
    points = keep(nodes(spacepoints, cfg))
    edges = keep(numbered(make_edges(points, layer_pairs, cfg)))
    paths = keep(walk(link_edges(edges, cfg), cfg.min_level, cfg.rounds))
    hits = keep(path_hits(paths, edges))
    quality = keep(segment_quality(hits, points))
    left = bid(paths, quality, cfg.bidding_rounds, keep)
    hits, quality = (df.join(left, "path_id", "left_semi") for df in (hits, quality))
    return convert_seeds(hits, points, hit_bids(hits, quality, cfg.hit_share), cfg)
