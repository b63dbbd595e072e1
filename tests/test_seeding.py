"""Doublets and triplets of whole events: one shuffle, blocks of any size, plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from trackloom.kernels import batches
from trackloom.kernels import doublets as kernel
from trackloom.operators import seeding
from trackloom.plans import bridge
from trackloom.plans.registry import QUERIES

SCHEMA = "event_id long, spacepoint_id long, x double, y double, z double"


def tracks(events=3, many=12, seed=5):
    rng, rows = random.Random(seed), []
    for event in range(events):
        for _ in range(many):
            phi, cot, z0, bend = rng.uniform(-math.pi, math.pi), rng.uniform(-1, 1), rng.uniform(-50, 50), rng.uniform(-2e-4, 2e-4)
            for layer in range(7):
                r = 32 + 24 * layer + rng.random()
                rows.append((event, 1000 * event + len(rows), r * math.cos(phi + bend * r), r * math.sin(phi + bend * r), z0 + cot * r))
    rng.shuffle(rows)
    return rows


def plain_doublets(rows, cfg):
    """All pairs of an event whose phi bins are neighbours, by the cuts as they are usually written."""
    phi_axis, _ = seeding.axes(cfg)
    big, out = cfg.min_helix_radius, set()
    cell = lambda x, y: math.floor((math.atan2(y, x) + math.pi) / (2 * math.pi) * phi_axis.bins) % phi_axis.bins
    for e, m, mx, my, mz in rows:
        for e2, o, ox, oy, oz in rows:
            if e != e2 or (cell(mx, my) - cell(ox, oy) + 1) % phi_axis.bins > 2:
                continue
            mr, r = math.hypot(mx, my), math.hypot(ox, oy)
            dr, dz = abs(mr - r), (mz - oz) * (1 if mr > r else -1)
            if not cfg.delta_r_min < dr < cfg.delta_r_max or abs(dz) >= min(cfg.cot_theta_max * dr, cfg.delta_z_max):
                continue
            if not cfg.collision_min < mz - mr * dz / dr < cfg.collision_max:
                continue
            d = math.hypot(mx - ox, my - oy)
            q = math.sqrt(big * big - d * d / 4)
            centres = [math.hypot((mx + ox) / 2 + s * q * (my - oy) / d, (my + oy) / 2 - s * q * (mx - ox) / d) for s in (1, -1)]
            if min(centres) > big - cfg.impact_max:
                out.add((e, m, o, mr > r))
    return out


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pairs_and_triplets_are_never_shuffled(spark):
    points, cfg, flt = spark.createDataFrame(tracks(), SCHEMA), seeding.SeedConfig(), seeding.FilterConfig()
    assert exchanges(seeding.doublets(points, cfg)) == 1
    assert exchanges(seeding.triplets(points, cfg)) == 1
    assert exchanges(seeding.weighted(seeding.triplets(points, cfg, flt), flt)) == 1
    assert exchanges(seeding.seeds(points)) == 2  # what has passed all cuts, by middle point


#: Shuffles after that of the positions: seeds are ordered by middle point.
SHUFFLES = {
    "jo4_triplets": 0,
    "al6_seed_finding": 1,
    "fi5_triplet_weights": 0,
    "jo5_compatible_tops": 0,
    "al8_track_parameters": 1,
    "fi4_triplet_geometry": 0,
    "so4_seeds_per_middle": 1,
    "sk4_seed_lines": 2,  # and the seeds by event
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_queries_shuffle_positions_once(spark, tmp_path, name):
    columns = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double"
    spark.createDataFrame([(1, 1, 1, 1, 1.0)], columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    # the numbers of the points, the positions by event
    assert exchanges(QUERIES[name](spark, str(tmp_path))) == 2 + SHUFFLES[name]


def test_doublets_against_all_pairs(spark):
    rows, cfg = tracks(), seeding.SeedConfig()
    points = spark.createDataFrame([*rows, (None, 1, 40.0, 1.0, 0.0), (None, 2, 80.0, 2.0, 0.0), (0, 3, None, 1.0, 1.0)], SCHEMA)
    found = [tuple(r) for r in seeding.doublets(points, cfg).collect()]
    assert len(found) == len(set(found)) > 100
    assert set(found) == {(e, m, o, b) for e, m, o, b in plain_doublets(rows, cfg)}


def test_empty_points(spark):
    points = spark.createDataFrame([], SCHEMA)
    assert seeding.doublets(points, seeding.SeedConfig()).count() == 0
    assert seeding.seeds(points).count() == 0


def grouped(rows, cfg):
    phi_axis, z_axis = seeding.axes(cfg)
    xs = np.array([r[2:] for r in rows])
    p = dict(zip("xyz", xs.T, strict=True)) | {"r": np.hypot(xs[:, 0], xs[:, 1]), "var_r": np.full(len(rows), 0.01), "var_z": np.full(len(rows), 0.01)}
    p["phi_bin"] = np.floor((np.arctan2(p["y"], p["x"]) + math.pi) / (2 * math.pi) * phi_axis.bins).astype(int) % phi_axis.bins
    p["z_bin"] = np.clip(np.trunc((p["z"] - z_axis.low) / (z_axis.high - z_axis.low) * z_axis.bins).astype(int), 0, z_axis.bins - 1)
    event = np.array([r[0] for r in rows])
    order = np.lexsort((p["phi_bin"], p["z_bin"], event))
    return {k: v[order] for k, v in p.items()}, event[order]


@pytest.mark.parametrize("block", [1, 37, 1000])
def test_blocks_change_nothing(monkeypatch, block):
    cfg, flt = seeding.SeedConfig(), seeding.FilterConfig()
    p, event = grouped(tracks(many=30), cfg)
    bins = tuple(a.bins for a in seeding.axes(cfg))

    def run():
        out = []
        for f in kernel.triplets(p, event, bins, cfg):
            n = kernel.compatible_tops(f["side"], f["curvature"], f["t"], p["r"][f["t"]], flt)
            out += zip(f["b"].tolist(), f["m"].tolist(), f["t"].tolist(), f["curvature"].tolist(), n.tolist(), strict=True)
        return sorted(out)

    want = run()
    monkeypatch.setattr(kernel, "BLOCK", block)
    assert run() == want and len(want) > 50


@pytest.mark.parametrize(("phi", "z", "neighbours"), [(78, 1, 1), (5, 4, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1), (4, 5, 2)])
def test_neighbouring_bins_once(phi, z, neighbours):
    """Bins of a neighbourhood are those of the axes, each once, however few there are."""
    cfg = seeding.SeedConfig(neighbours=neighbours, delta_r_min=-1.0, delta_r_max=1e9, collision_min=-1e9, collision_max=1e9, delta_z_max=1e9, impact_max=1e9)
    cells = [(e, a, b) for e in range(2) for b in range(z) for a in range(phi)]
    n = len(cells)
    p = {c: np.zeros(n) for c in ("x", "y", "z", "var_r", "var_z")} | {"r": np.arange(n) * 1.0}
    p |= {"phi_bin": np.array([c[1] for c in cells]), "z_bin": np.array([c[2] for c in cells])}
    group = np.array([c[0] for c in cells])
    got = [(int(m), int(o)) for ms, os in kernel.pairs(p, group, (phi, z), cfg) for m, o in zip(ms, os, strict=True)]
    ring = lambda a, b: min((a - b) % phi, (b - a) % phi)
    want = {(i, j) for i, a in enumerate(cells) for j, b in enumerate(cells) if i != j and a[0] == b[0] and ring(a[1], b[1]) <= neighbours and abs(a[2] - b[2]) <= neighbours}
    assert len(got) == len(set(got)) and set(got) - {(i, i) for i in range(n)} == want


def test_compatible_tops_against_plain_version():
    rng, flt = np.random.default_rng(3), seeding.FilterConfig()
    n = 400
    side, curvature = np.sort(rng.integers(0, 40, n)), rng.choice(np.arange(-5, 6) * 1e-5, n) + rng.choice([0, 1e-6], n)
    t_id, t_r = rng.permutation(n), rng.uniform(80, 110, n)
    want = []
    for i in range(n):
        near = [j for j in np.argsort(t_id) if j != i and side[j] == side[i] and abs(t_r[j] - t_r[i]) >= flt.delta_r_min and curvature[i] - flt.delta_inv_diameter <= curvature[j] <= curvature[i] + flt.delta_inv_diameter]
        want.append(0 if not near else 2 if any(abs(t_r[j] - t_r[near[0]]) >= flt.delta_r_min for j in near) else 1)
    assert kernel.compatible_tops(side, curvature, t_id, t_r, flt).tolist() == want
    assert set(want) == {0, 1, 2}

#: Bytes of shuffles that a point may take (lines and positions), and a seed (the order by middle point).
BYTES = {
    "al6_seed_finding": (25, 32),
    "so4_seeds_per_middle": (25, 32),
    "al8_track_parameters": (25, 42),
    "fi5_triplet_weights": (25, 0),
    "jo5_compatible_tops": (25, 0),
    "fi4_triplet_geometry": (25, 0),
}


def lines(orders, seed=11):
    rng, rows = random.Random(seed), []
    for order in range(orders):
        rows += [(order, layer, rng.randrange(20_000), rng.randrange(1_000), round(rng.uniform(900, 105_000), 2)) for layer in range(1, rng.randrange(2, 8))]
    return rows


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"


def shuffled(spark, run):
    """Bytes that ``run`` writes for shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, quantiles, jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("name", sorted(BYTES))
def test_bytes_shuffled_by_a_query(spark, tmp_path, name):
    """Lines are shuffled packed, without coordinates; seeds with what their order needs."""
    rows, out = lines(6_000), []
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    written = shuffled(spark, lambda: out.append(QUERIES[name](spark, str(tmp_path)).localCheckpoint().count()))
    point, seed = BYTES[name]
    assert 10 * len(rows) < written < point * len(rows) + seed * out[0]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 211])
def test_every_partition_gets_one_part(spark, n):
    names = batches.part_names(n).tolist()
    at = spark.createDataFrame([(x,) for x in names], "part int").repartition(n, "part").select("part", F.spark_partition_id()).collect()
    assert dict(map(tuple, at)) == dict(zip(names, range(n), strict=True))


#: Queries whose shuffles are measured on many partitions.
SPREAD = ["fi5_triplet_weights", "jo5_compatible_tops", "fi4_triplet_geometry"]


@pytest.mark.parametrize("name", SPREAD)
def test_bytes_shuffled_on_many_partitions(spark, tmp_path, name):
    """Blocks of lines stay as large as partitions allow: rows over 16 partitions take few bytes more than over 4."""
    rows, few = lines(6_000), spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = []
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        written = shuffled(spark, lambda: found.extend(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert 10 * len(rows) < written < BYTES[name][0] * len(rows)
    assert found and sorted(found) == sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))


def view_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, LINES).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    want = [tuple(r) for r in bridge.table(spark, str(tmp_path), "spacepoints").collect()]
    return [tuple(r) for r in bridge.points_by_event(spark, str(tmp_path)).collect()], want


def test_points_by_event_are_those_of_the_view(spark, tmp_path):
    """Also where one base lies in several events, a part of its lines makes no point, and columns hold nulls."""
    rows = [*lines(400), *[(k, ln, p, s, 1.5) for k in (100, 101) for ln in (1, 2) for p in (7, 1_000_007) for s in (5, 3, 4)]]
    # order 99 and line 11 have the base of order 100 and line 1, in another event
    rows += [(99, 11, 7, 9, 1.0), (99, 11, 7, None, 2.0), (100, 1, 7, 2, None), (100, 1, 7, 2, float("nan"))]
    rows += [(None, 1, 7, 1, 1.0), (100, None, 7, 1, 1.0), (100, 1, None, 1, 1.0), (-3, 1, 7, 1, 1.0)]
    still = next(k for k in range(1, 10_000) if (k * 7919) % 401 == 200)  # no point comes from it
    rows += [(still, 11, 7, 1, 1.0), (still + 1, 1, 7, 2, 1.0), (still + 1, 1, 7, 0, 1.0)]
    got, want = view_of(spark, tmp_path, rows)
    key = lambda r: (r[0], r[1], r[2:])
    assert sorted(got, key=key) == sorted((r for r in want if None not in r), key=key)
    assert len({r[0] for r in got}) > 4 and any(r[1] % 100 > 6 for r in got)


def test_events_stay_together(spark, tmp_path):
    spark.createDataFrame(lines(2_000), LINES).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = bridge.points_by_event(spark, str(tmp_path)).withColumn("at", F.spark_partition_id())
    assert found.groupBy("event_id").agg(F.countDistinct("at").alias("n")).where("n > 1").count() == 0
    assert found.select("at").distinct().count() > 1


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_packed_blocks_give_all_rows_back(monkeypatch, size):
    monkeypatch.setattr(batches, "PACKED", size)
    rng = random.Random(size)
    schema = pa.schema([("a", pa.int64()), ("b", pa.float64()), ("c", pa.int32())])
    rows = [(rng.choice([None, rng.randrange(-9, 9)]), rng.choice([None, math.nan, -0.0, 1e300]), rng.choice([None, i])) for i in range(300)]
    given = [pa.record_batch([*(pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)), pa.array([abs(r[0] or 0) for r in part], pa.int32())], [*schema.names, "part"]) for part in (rows[i : i + 40] for i in range(0, 300, 40))]
    blocks = list(batches.packed(iter([*given, given[0].slice(0, 0)]), schema))
    back = [r for b in batches.unpacked(iter(blocks), schema) for r in b.to_pylist()]
    assert sorted(map(repr, back)) == sorted(repr(dict(zip(schema.names, r, strict=True))) for r in rows)
    for b in blocks:  # a block holds rows of its part alone
        for part, block in zip(b.column("part").to_pylist(), b.column("block"), strict=True):
            inside = pa.ipc.read_record_batch(pa.ipc.read_message(block.as_buffer()), schema)
            assert {abs(x or 0) for x in inside.column("a").to_pylist()} == {part}
    assert list(batches.packed(iter([]), schema)) == [] == list(batches.packed(iter([given[0].slice(0, 0)]), schema))
