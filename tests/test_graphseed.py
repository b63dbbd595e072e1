"""Graph seeding against plain versions of its steps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.kernels.tripletfit import fit  # noqa: F401  the kernels import without a session
from trackloom.operators import analytics, branches, graphseed, sanity
from trackloom.operators.fitting import normal
from trackloom.plans.windows import kept
from trackloom.workers import with_workers

SP = "event_id long, spacepoint_id long, x double, y double, z double, width double"


def points(seed, tracks=15, events=2):
    rng = random.Random(seed)
    rows = []
    for event in range(events):
        for t in range(tracks):
            phi, k, cot, z0 = rng.uniform(-3.1, 3.1), rng.uniform(-5e-4, 5e-4), rng.uniform(-2, 2), rng.uniform(-200, 200)
            for layer in range(6):
                r = 32.0 + 24 * layer + rng.uniform(0, 4)
                a = phi + k * r + rng.gauss(0, 3e-4)
                width = rng.choice([0.0, 0.2 + abs(cot) * 0.12 + rng.uniform(-0.02, 0.05)])
                rows.append((event, event * 10000 + t * 10 + layer, r * math.cos(a), r * math.sin(a), z0 + cot * r + rng.gauss(0, 0.05), width))
    return rows


def plain_edges(rows, cfg):
    def window(w):
        if w <= 0:
            return 0.0, cfg.tau_max
        return cfg.tau_min_slope * (w - cfg.tau_offset), cfg.tau_max_min + cfg.tau_max_correction / (w + cfg.tau_offset) + cfg.tau_max_slope * (w - cfg.tau_offset)

    radius = {}
    for e, _, x, y, _, _ in rows:
        r = math.hypot(x, y)
        radius.setdefault((e, math.floor((r - 20) / 24)), []).append(r)
    out = {}
    for e1, id1, x1, y1, z1, w1 in rows:
        for e2, id2, x2, y2, z2, w2 in rows:
            r1, r2 = math.hypot(x1, y1), math.hypot(x2, y2)
            l1, l2 = (math.floor((r - 20) / 24) for r in (r1, r2))
            if e1 != e2 or l2 != l1 + 1 or not 0 <= l1 <= 4 or r2 - r1 < cfg.min_delta_r:
                continue
            tau = (z2 - z1) / (r2 - r1)
            z0 = z1 - r1 * tau
            apart = max(radius[e1, l2]) - min(radius[e1, l1])
            delta = cfg.min_delta_phi_near + apart * cfg.delta_phi_slope_near if apart < cfg.near_delta_r else cfg.min_delta_phi + apart * cfg.delta_phi_slope
            dphi = (math.atan2(y2, x2) - math.atan2(y1, x1) + math.pi) % (2 * math.pi) - math.pi
            curv = dphi / (r2 - r1)
            (lo1, hi1), (lo2, hi2) = window(w1), window(w2)
            outer = z0 + cfg.outer_radius * tau
            reach = cfg.outer_radius * cfg.tau_region
            if max(lo1, lo2) <= abs(tau) <= min(hi1, hi2) and cfg.min_z0 <= z0 <= cfg.max_z0 and cfg.min_z0 - reach <= outer <= cfg.max_z0 + reach:
                if abs(dphi) <= delta and r1 * r2 * (abs(curv) - cfg.max_kappa) <= (cfg.low_kappa_d0 if abs(tau) < cfg.steep_tau else cfg.high_kappa_d0):
                    out[id1, id2] = (curv, math.sqrt(1 + tau * tau) - tau, math.atan2(y2, x2) + curv * r2, math.atan2(y1, x1) + curv * r1)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_edges_and_links_against_plain_loops(spark, seed):
    cfg = graphseed.GraphConfig(max_tau_ratio=0.05)
    rows = points(seed)
    nodes = graphseed.nodes(spark.createDataFrame(rows, SP), cfg)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(5)], "layer1 long, layer2 long")
    edges = graphseed.numbered(graphseed.make_edges(nodes, pairs, cfg))
    got = {(r.node1, r.node2): r for r in edges.collect()}
    want = plain_edges(rows, cfg)
    assert set(got) == set(want) and len(want) > 50
    assert all(np.allclose((got[k].curv, got[k].exp_eta, got[k].phi_out, got[k].phi_in), v) for k, v in want.items())
    name = {r.edge_id: k for k, r in got.items()}
    links = {(name[r.edge_id], name[r.next_id]) for r in graphseed.link_edges(edges, cfg).collect()}
    wanted = set()
    for a, (c1, e1, out1, _) in want.items():
        near = []
        for b, (c2, e2, _, in2) in want.items():
            turn = (out1 - in2 + math.pi) % (2 * math.pi) - math.pi
            if a[1] == b[0] and abs(e2 / e1 - 1) <= cfg.max_tau_ratio and abs(turn) <= cfg.max_phi_difference and abs(c1 - c2) <= cfg.max_curv_difference:
                near.append((abs(c1 - c2), b))
        wanted |= {(a, b) for _, b in sorted(near)[: cfg.max_links]}
    assert links == wanted and links


def test_slope_windows_from_a_table(spark):
    cfg = graphseed.GraphConfig(tau_table=((0.5, 1.0), (-1.0, 2.0), (0.7, -1.0)), tau_inverse_bin=10.0)
    df = spark.createDataFrame([(w,) for w in (0.0, 0.05, 0.15, 0.25, 0.35, 0.45)], "w double")
    low, high = graphseed.tau_window(F.col("w"), cfg)
    assert [tuple(r) for r in df.select(low, high).collect()] == [(0.0, 36.0), (0.0, 36.0), (0.5, 1.0), (0.0, 2.0), (0.7, 36.0), (0.0, 36.0)]


def test_levels_paths_and_bids_against_plain_loops(spark):
    rng = random.Random(3)
    links = set()
    for event in (0, 5):
        ids = [(event << 32) + i for i in range(1, 60)]
        for i, a in enumerate(ids[:-8]):
            links |= {(event, a, b) for b in rng.sample(ids[i + 1 : i + 8], rng.randint(0, 2))}
    df = spark.createDataFrame(sorted(links), "event_id long, edge_id long, next_id long")
    edges = df.select("edge_id").union(df.select("next_id")).distinct()
    after = {}
    for _, a, b in links:
        after.setdefault(a, set()).add(b)
    every = set(after) | {b for _, _, b in links}

    def longest(a):
        return 1 + max((longest(b) for b in after.get(a, ())), default=0)

    level = {a: min(longest(a), 16) for a in every}
    assert {r.edge_id: r.level for r in graphseed.levels(edges, df, 15).collect()} == level
    led = {b for _, _, b in links}
    paths = {}
    for a in every - led:
        if level[a] >= 3:
            chain = [a]
            while nxt := [b for b in after.get(chain[-1], ()) if level[b] == level[chain[-1]] - 1]:
                chain.append(min(nxt))
            paths[a] = chain
    rows = graphseed.walk(df, 3, 15)
    got = {}
    for r in rows.orderBy("path_id", "depth").collect():
        got.setdefault(r.path_id, []).append(r.edge_id)
    assert got == paths and paths
    quality = {p: rng.randrange(4) for p in paths}
    left = graphseed.bid(rows, spark.createDataFrame(list(quality.items()), "path_id long, quality int"), 5, kept(with_workers(spark))).collect()
    best = {}
    for p, chain in paths.items():
        best[chain[-1]] = max(best.get(chain[-1], (-1, -1)), (quality[p], p))
    open_ = {p for _, p in best.values()}
    accepted = set()
    for _ in range(5):
        top = {}
        for p in open_:
            for e in paths[p]:
                top[e] = max(top.get(e, (-1, -1)), (quality[p], p))
        wins = {p for p in open_ if all(top[e][1] == p for e in paths[p])}
        taken = {e for p in wins for e in paths[p]}
        accepted |= wins
        open_ = {p for p in open_ if not taken & set(paths[p])}
    assert {r.path_id for r in left if r.accepted} == accepted and {r.path_id for r in left if not r.accepted} == open_


@pytest.mark.parametrize("dropout", [True, False])
def test_seeds_of_paths_against_a_plain_version(spark, dropout):
    rng = random.Random(8)
    cfg = graphseed.GraphConfig(dropout=dropout)
    pts, hits, chosen = {}, [], []
    for path in range(60):
        n = rng.randint(3, 7)
        phi, k, cot = rng.uniform(-3, 3), rng.uniform(-3e-4, 3e-4), rng.uniform(-2, 2)
        for pos in range(n):
            r = 30.0 + 20 * pos
            a = phi + k * r + rng.gauss(0, 3e-5 * rng.choice([0.1, 1, 5]))
            pts[path * 10 + pos] = (r * math.cos(a), r * math.sin(a), cot * r)
            hits.append((path, pos, path * 10 + pos))
        chosen.append((path, rng.randint(n // 2, n)))

    def shape(a, m, c):
        (ax, ay, _), (mx, my, mz), (cx, cy, cz) = a, m, c
        r = math.hypot(mx, my)
        line = []
        for x, y in ((ax, ay), (cx, cy)):
            dx, dy = x - mx, y - my
            d = dx * dx + dy * dy
            if not d:
                return 0.0, 0.0
            line.append(((dx * mx + dy * my) / r / d, (dy * mx - dx * my) / r / d))
        (u0, v0), (u1, v1) = line
        if u0 == u1:
            return 0.0, 0.0
        s = (v0 - v1) / (u0 - u1)
        return 1000 * (v1 - s * u1) / math.sqrt(1 + s * s), (cz - mz) / (math.hypot(cx, cy) - r)

    want = []
    for path, best in chosen:
        ids = [s for p, _, s in hits if p == path]
        n = len(ids)
        half = (n - 1) // 2
        inner, later = max(n - 2 - half, 1), max(n - 1 - half, 1)
        tries = [(ids[0], ids[inner], ids[-1]), (ids[0], ids[later], ids[-1]), (ids[1], ids[later], ids[-1])]
        if not dropout:
            want.append((path, *tries[0]))
            continue
        (k0, t0), (k1, t1), (k2, t2) = (shape(*(pts[i] for i in t)) for t in tries)
        central = abs(t0 + t1 + t2) < 3 * cfg.tight_cot
        if best < n - 1 and central and n < 5:
            continue
        like = (abs(k0 - k1) < cfg.dropout_difference, abs(k1 - k2) < cfg.dropout_difference, abs(k0 - k2) < cfg.dropout_difference)
        every = abs(k0 + k1 + k2) < 3 * cfg.dropout_curvature or (central and not any(like))
        if like not in ((False, True, True), (True, True, False)) or every:
            want.append((path, *tries[0]))
        if like in ((False, False, True), (True, True, False)):
            want.append((path, *tries[1]))
        if like in ((False, True, False), (False, True, True), (True, False, False)) or every:
            want.append((path, *tries[2]))
    out = graphseed.convert_seeds(
        spark.createDataFrame(hits, "path_id long, pos long, spacepoint_id long"),
        spark.createDataFrame([(i, *p) for i, p in pts.items()], "spacepoint_id long, x double, y double, z double"),
        spark.createDataFrame(chosen, "path_id long, n_best long"), cfg,
    )
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and want


@pytest.mark.parametrize("partitions", [2, 5])
def test_seeds_do_not_depend_on_partitions(spark, partitions):
    sp = spark.createDataFrame(points(7), SP).repartition(partitions)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(5)], "layer1 long, layer2 long")
    found = sorted(map(tuple, graphseed.graph_seeds(sp, pairs, kept(with_workers(spark)), graphseed.GraphConfig(max_tau_ratio=0.05)).collect()))
    again = sorted(map(tuple, graphseed.graph_seeds(sp.repartition(3), pairs, kept(with_workers(spark)), graphseed.GraphConfig(max_tau_ratio=0.05)).collect()))
    assert found == again and found


def test_tips_whose_measurements_end_another(spark):
    rng = random.Random(2)
    chains = {t: [rng.randrange(2) for _ in range(rng.randint(3, 9))] for t in range(120)}
    prob = {t: rng.choice([0.1, 0.5, 0.9]) for t in chains}
    ndf = {t: rng.choice([4, 8]) for t in chains}
    walks = [(t, m, back) for t, c in chains.items() for back, m in enumerate(c)]
    want = {
        a for a, c in chains.items() if len(c) > 5 and ndf[a] > 5
        and any(b != a and len(d) > 5 and d[: len(c)] == c and (prob[b] > prob[a] or (prob[b] == prob[a] and b < a)) for b, d in chains.items())
    }
    tips = spark.createDataFrame([(t, prob[t], ndf[t]) for t in chains], "tip_id long, pval double, ndf long")
    got = branches.duplicate_tips(spark.createDataFrame(walks, "tip_id long, meas_id long, back long"), tips)
    assert {r.tip_id for r in got.collect()} == want and want


def test_gaussian_fits_find_the_width(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, s in ((1, 0.1), (2, 0.25)) for v in rng.normal(0.02, s, 6000)] + [(3, 0.5)]
    got = {r.g: r for r in analytics.gaussian_fit(spark.createDataFrame(rows, "g int, v double"), ["g"], F.col("v")).collect()}
    assert abs(got[1].sigma - 0.1) < 0.004 and abs(got[2].sigma - 0.25) < 0.01 and abs(got[1].mean - 0.02) < 0.005
    assert 0.5 < got[1].sigma_error / (0.1 / math.sqrt(12000)) < 2 and got[3].sigma is None


def test_skyline_over_partitions(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(30), rng.randrange(30), rng.random().__round__(2)) for i in range(3000)]
    worse = lambda m, n: n[0] != m[0] and n[1] <= m[1] and n[2] <= m[2] and n[3] >= m[3]
    want = {m[0] for m in rows if not any(worse(m, n) for n in rows)}
    df = spark.createDataFrame(rows, "id long, a long, b long, c double").repartition(6)
    assert {r.id for r in analytics.pareto(df, "id", ["a", "b"], ["c"]).collect()} == want


def test_bins_close_once_they_are_full(spark):
    cells = [(e, m, i) for e in range(3) for m in range(20) for i in range((m * 7 + e) % 11)]
    bins = sanity.packed_modules(spark.createDataFrame(cells, "event_id long, module_index int, channel0 int"), 16)
    got = sorted(map(tuple, bins.collect()))
    want = []
    for e in range(3):
        held, nth, modules = 0, 0, 0
        for m in range(20):
            n = (m * 7 + e) % 11
            if n:
                held, modules = held + n, modules + 1
                if held >= 16:
                    want.append((e, nth, modules, held))
                    held, nth, modules = 0, nth + 1, 0
        if modules:
            want.append((e, nth, modules, held))
    assert got == want
    stats = {r.event_id: r for r in sanity.packing_statistics(bins).collect()}
    assert stats[0].n_cells == sum(w[3] for w in want if w[0] == 0) and stats[0].inefficiency == stats[0].n_bins * stats[0].largest / stats[0].n_cells


def test_normal_numbers_of_keys(spark):
    df = spark.range(20000).select(normal(3, "id").alias("v"), (F.col("id") % 3).alias("g"))
    v = df.toPandas()["v"]
    assert abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.03 and abs((v**4).mean() - 3) < 0.3
    assert df.repartition(7).agg(F.sum("v")).first()[0] == pytest.approx(v.sum())
