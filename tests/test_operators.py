import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import ambiguity, clusterize, fitting, sanity, seeding
from trackloom.sources import events, sinks

CELLS = "event_id long, module_index int, channel0 int, channel1 int, activation long, cell_id long"


def modules(spark):
    return spark.createDataFrame([(0, 7, 0, 0.0, 0.0)], "module_index int, geometry_id long, design_id int, shift0 double, shift1 double")


def designs(spark):
    return spark.createDataFrame([(0, 1.0, 1.0, -0.5, -0.5)], "design_id int, pitch0 double, pitch1 double, min0 double, min1 double")


def test_nine_cells_make_four_measurements(spark):
    nine = [(1, 0, 1), (8, 4, 2), (10, 4, 3), (9, 5, 4), (10, 5, 5), (12, 12, 6), (3, 13, 7), (11, 13, 8), (4, 14, 9)]
    cells = spark.createDataFrame([(0, 0, a, b, w, i) for i, (a, b, w) in enumerate(nine)], CELLS)
    found = clusterize.measurements(clusterize.clusters(cells), modules(spark), designs(spark)).orderBy("cluster_id").collect()
    assert [r.n_cells for r in found] == [1, 4, 2, 2]
    assert found[0].loc0 == 1.0 and found[0].loc1 == 0.0 and found[0].var0 == pytest.approx(1 / 12)
    weights = np.array([2, 3, 4, 5])
    assert found[1].loc0 == pytest.approx((weights * [8, 10, 9, 10]).sum() / 14)
    numbered = {r.cell_id: r.cluster_index for r in clusterize.numbered_clusters(clusterize.clusters(cells)).collect()}
    assert [numbered[i] for i in (0, 1, 5, 6)] == [0, 1, 2, 3]


def test_components_by_edges_and_by_kernel_agree(spark):
    cells = fitting.generate_cells(spark, 2, modules=12, size=25).cache()
    label = {(r.event_id, r.cell_id): r.cluster_id for r in clusterize.clusters(cells).collect()}
    parent = {k: k for k in label}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for r in clusterize.adjacency(cells).collect():
        a, b = root((r.event_id, r.a)), root((r.event_id, r.b))
        parent[max(a, b)] = min(a, b)
    assert all(root(k)[1] == v for k, v in label.items())


def test_unknown_module_is_an_error(spark):
    cells = spark.createDataFrame([(0, 9, 1, 1, 1, 1)], CELLS)
    with pytest.raises(Exception, match="unknown module 9"):
        clusterize.resolve_modules(cells, modules(spark)).collect()


def test_empty_cells(spark):
    assert clusterize.measurements(clusterize.clusters(spark.createDataFrame([], CELLS)), modules(spark), designs(spark)).count() == 0


CASES = [
    [(36.6706, 10.6472, 104.131), (94.2191, 29.6699, 113.628), (149.805, 47.9518, 122.979), (218.514, 70.3049, 134.029)],
    [(36.301, 13.1197, 106.83), (93.9366, 33.7101, 120.978), (149.192, 52.0562, 134.678), (218.398, 73.1025, 151.979)],
]


@pytest.mark.parametrize("case", CASES)
def test_one_muon_gives_one_seed(spark, case):
    cfg = seeding.SeedConfig(delta_r_max=100.0, max_pt_scattering=0.5)
    points = spark.createDataFrame([(0, i, *p) for i, p in enumerate(case)], "event_id long, spacepoint_id long, x double, y double, z double")
    found = seeding.seeds(points, cfg)
    assert found.count() == 1
    assert seeding.track_parameters(found, points).count() == 1


@pytest.mark.parametrize("q", [-1, 1])
def test_parameters_of_a_helix(spark, q):
    b = 2 * seeding.TESLA
    radius = 1.0 / b  # transverse momentum 1 GeV
    points = []
    for i, s in enumerate((50.0, 100.0, 150.0)):
        arc = s / math.sqrt(2)
        turn = -q * arc / radius
        points.append((0, i, radius * math.sin(abs(turn)), math.copysign(radius * (1 - math.cos(turn)), turn), arc))
    sp = spark.createDataFrame(points, "event_id long, spacepoint_id long, x double, y double, z double")
    seed = spark.createDataFrame([(0, 0, 1, 2, 0.0)], "event_id long, bottom_id long, middle_id long, top_id long, quality double")
    out = seeding.initial_covariance(seeding.track_parameters(seed, sp, (0.0, 0.0, b))).collect()[0]
    assert abs(1 / out.qop) == pytest.approx(math.sqrt(2), abs=2e-4)
    assert math.copysign(1, out.qop) == q
    assert out.theta == pytest.approx(math.pi / 4, abs=1e-3) and out.cov_loc0 == 1.0 and out.cov_qop > 0


def test_spacepoints_on_planes(spark):
    m = spark.createDataFrame([(0, 0, 20, 7.0, 2.0, 2), (0, 1, 180, 10.0, 15.0, 2), (0, 2, 20, 1.0, 1.0, 1)], "event_id long, measurement_id long, surface_link long, loc0 double, loc1 double, dimensions int")
    planes = spark.range(20, 181, 20).select(F.col("id").alias("surface_link"), F.col("id").cast("double").alias("cx"), *(F.lit(0.0).alias(c) for c in ("cy", "cz", "rot_xu", "rot_xv", "rot_yv", "rot_zu")), F.lit(1.0).alias("rot_yu"), F.lit(1.0).alias("rot_zv"))
    assert sorted((r.x, r.y, r.z) for r in seeding.form_spacepoints(m, planes).collect()) == [(20.0, 7.0, 2.0), (180.0, 10.0, 15.0)]


RESOLVER = [
    ([(0.23, [5, 1, 11, 3]), (0.85, [12, 10, 9, 8, 7, 6]), (0.42, [4, 2, 13])], 3, [0, 1, 2]),
    ([(0.23, [5, 1, 11, 3]), (0.85, [12, 10, 9, 8, 7, 6]), (0.42, [4, 2, 13])], 5, [1]),
    ([(0.12, [5, 14, 1, 11, 18, 16, 3]), (0.53, [3, 6, 5, 13])], 3, [0]),
    ([(0.8, [1, 3, 5, 11]), (0.9, [3, 5, 6, 13])], 3, [1]),
    ([(0.2, [5, 1, 11, 3]), (0.5, [6, 2]), (0.4, [3, 21, 12, 6, 19, 14]), (0.1, [13, 16, 2, 7, 11]), (0.3, [1, 7, 8]), (0.6, [1, 3, 11, 22])], 3, [2, 3]),
    ([(0.2, [1, 2, 1, 1]), (0.5, [3, 2, 1]), (0.4, [2, 4, 5, 7, 2]), (0.1, [6, 6, 6, 6])], 3, [1, 3]),
    ([(0.2, [7, 3, 5, 7, 7, 7, 2]), (0.5, [2]), (0.4, [8, 9, 7, 2, 3, 4, 3, 7]), (0.1, [8, 9, 0, 8, 1, 4, 6]), (0.9, [10, 3, 2])], 3, [0, 3]),
]


@pytest.mark.parametrize(("tracks", "least", "kept"), RESOLVER)
def test_resolver_patterns(tracks, least, kept):
    assert ambiguity.resolve_event(list(range(len(tracks))), [p for p, _ in tracks], [m for _, m in tracks], min_meas=least) == kept


def plain_resolver(ids, pvals, meas, min_meas, max_shared):
    """Recounts everything after each eviction."""
    alive = [i for i in range(len(ids)) if len(meas[i]) >= min_meas]
    while True:
        owners = {}
        for i in alive:
            for m in set(meas[i]):
                owners[m] = owners.get(m, 0) + 1
        shared = {i: sum(owners[m] > 1 for m in meas[i]) for i in alive}
        if not alive or max(shared.values()) < max_shared:
            return sorted(alive)
        worst = min(alive, key=lambda i: (-shared[i] / len(meas[i]), pvals[i], -ids[i]))
        alive.remove(worst)


@pytest.mark.parametrize("seed", range(6))
def test_resolver_against_a_plain_one(seed):
    rng = random.Random(seed)
    n = 250
    meas = [rng.sample(range(600), rng.randint(1, 20)) for _ in range(n)]
    if seed % 2:
        meas = [m + [m[0]] * rng.randint(0, 2) for m in meas]
    pvals = [rng.random() for _ in range(n)]
    assert ambiguity.resolve_event(list(range(n)), pvals, meas, min_meas=3, max_shared=1 + seed % 3) == plain_resolver(list(range(n)), pvals, meas, 3, 1 + seed % 3)


def test_resolution_leaves_no_shared_measurement(spark):
    rng = random.Random(4)
    tracks = [(t % 3, t, rng.random()) for t in range(200)]
    links = [(t, rng.randrange(150) + 1000 * (t % 3), k) for t in range(200) for k in range(rng.randint(1, 7))]
    kept = {r.track_id for r in ambiguity.greedy_resolution(spark.createDataFrame(tracks, "event_id long, track_id long, pval double"), spark.createDataFrame(links, "track_id long, meas_id long, pos int")).collect()}
    owners = {}
    for t, m, _ in links:
        if t in kept:
            owners.setdefault(m, set()).add(t)
    assert kept and all(len(o) == 1 for o in owners.values())


def test_contiguous_and_ordered(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 1, 2, 2, 3])] + [(1, i, v) for i, v in enumerate([1, 2, 1])], "g long, i long, v long")
    assert {r.g: r.contiguous for r in sanity.contiguous_on(df, "g", "i", "v").collect()} == {0: True, 1: False}
    assert {r.g: r.ordered for r in sanity.ordered_on(df, "g", "i", F.col("v")).collect()} == {0: True, 1: False}


MOCK = {
    "cells": "geometry_id,measurement_id,channel0,channel1,timestamp,value,further\n1224979236083738112,0,1,0,0,0.5,x\n1224979236083738112,0,1,0,3,0.25,x\n18446744073709551615,1,1,1,0,1.5,x\n",
    "hits": "particle_id,geometry_id,tx,ty,tz,tt,tpx,tpy,tpz,te,deltapx,deltapy,deltapz,deltae,index\n4503599644147712,5,1,2,3,0,0,0,0,0,0,0,0,0,3\n4503599660924928,5,4,5,6,0,0,0,0,0,0,0,0,0,1\n",
    "measurement-simhit-map": "measurement_id,hit_id\n0,0\n1,1\n",
    "measurements": "measurement_id,geometry_id,local_key,local0,local1,phi,theta,time,var_local0,var_local1,var_phi,var_theta,var_time\n0,5,,4.25,11.75,0,0,0,0.0025,0.0025,0,0,0\n1,5,6,2.5,-17.25,0,0,0,0.0025,0.0025,0,0,0\n2,4,4,2.5,-17.25,0,0,0,0.0025,0.0025,0,0,0\n",
    "particles_initial": "particle_id,particle_type,process,vx,vy,vz,vt,px,py,pz,m,q\n4503599644147712,-321,0,0,0,0,0,0,0,1,0.5,-1\n4503599660924928,211,0,0,0,0,0,0,0,1,0.14,1\n",
}


@pytest.fixture
def folder(tmp_path):
    for kind, text in MOCK.items():
        for event in (0, 12):
            (tmp_path / f"event{event:09d}-{kind}.csv").write_text(text)
    return str(tmp_path)


def test_event_files(spark, folder):
    cells = events.read_cells(spark, folder).collect()
    assert len(cells) == 4 and {r.event_id for r in cells} == {0, 12}
    assert sorted((r.geometry_id, r.value, r.timestamp, r.n_merged) for r in cells if r.event_id == 12) == [(-1, 1.5, 0.0, 1), (1224979236083738112, 0.75, 0.0, 2)]
    assert events.read_cells(spark, folder, dedup=False).count() == 6
    m = {r.row: (r.dimensions, r.subspace, r.new_row) for r in events.read_measurements(spark, folder, sort=True).where("event_id = 0").collect()}
    assert m == {0: (0, [0, 1], 2), 1: (2, [0, 1], 1), 2: (1, [1, 0], 0)}
    sp = events.read_spacepoints(spark, folder).where("event_id = 12").orderBy("spacepoint_id").collect()
    assert [(r.spacepoint_id, r.x, r.measurement_1) for r in sp] == [(0, 1.0, 0), (1, 4.0, 1)]
    lists = events.read_particle_measurements(spark, folder).where("event_id = 0").collect()
    assert {r.particle_id: r.meas_ids for r in lists} == {4503599644147712: [0], 4503599660924928: [1]}


def test_hit_without_particle_is_an_error(spark, folder):
    from pathlib import Path

    Path(folder, "event000000012-particles_initial.csv").write_text(MOCK["particles_initial"].rsplit("\n", 2)[0] + "\n")
    with pytest.raises(Exception, match="hit without particle"):
        events.read_particle_measurements(spark, folder).collect()


def test_digitization_round_trip(spark, tmp_path):
    axis = {"bins": 4, "type": "equidistant", "min": -1.0, "max": 1.0}
    config = {"entries": [{"volume": 1, "layer": 0, "sensitive": 0, "value": {"geometric": {"segmentation": {"binningdata": [axis, {**axis, "edges": [0.0, 1.0, 3.0], "bins": 2}]}}}}, {"volume": 2, "value": {"geometric": {"segmentation": {"binningdata": [axis]}}, "shift": [0.5, 0.25]}}]}
    (tmp_path / "a.json").write_text(json.dumps(config))
    rows = events.read_digitization(spark, str(tmp_path / "a.json")).orderBy("volume").collect()
    assert rows[0].edges0 == [-1.0, -0.5, 0.0, 0.5, 1.0] and rows[0].edges1 == [0.0, 1.0, 3.0] and [r.dimensions for r in rows] == [2, 1]
    text = sinks.digitization_json(events.read_digitization(spark, str(tmp_path / "a.json"))).collect()[0].json
    (tmp_path / "b.json").write_text(text)
    again = events.read_digitization(spark, str(tmp_path / "b.json")).orderBy("volume").collect()
    assert [(r.edges0, r.edges1) for r in again] == [(r.edges0, r.edges1) for r in rows]
    shifts = events.read_conditions(spark, str(tmp_path / "a.json")).orderBy("volume").collect()
    assert [(r.shift0, r.shift1) for r in shifts] == [(0.0, 0.0), (0.5, 0.25)]


def test_most_specific_entry(spark):
    m = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 2), (3, 1, 2, 1)], "geometry_id long, volume long, layer long, sensitive long")
    c = spark.createDataFrame([(1, 0, 0, "v"), (1, 1, 0, "l"), (1, 1, 2, "s")], "volume long, layer long, sensitive long, kind string")
    assert {r.geometry_id: r.kind for r in events.most_specific(m, c).collect()} == {1: "l", 2: "s", 3: "v"}
    with pytest.raises(Exception, match="no entry for module"):
        events.most_specific(m, c.where("volume = 9")).collect()


def test_seed_geometry_shares_vertices(spark, tmp_path):
    s = spark.createDataFrame([(0, 10, 20, 30), (0, 10, 20, 40)], "event_id long, bottom_id long, middle_id long, top_id long")
    assert [r.line for r in sinks.seed_lines(s).orderBy("top_id").collect()] == ["l 1 2 3", "l 1 2 4"]
    cells = spark.createDataFrame([(3, 5, 1, 2, 0.0, 1.5)], "event_id long, geometry_id long, channel0 int, channel1 int, timestamp double, value double")
    sinks.write_cells(cells, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0]
    assert (back.geometry_id, back.measurement_id, back.value, back.event_id) == ("5", "0", "1.5", 3)


def test_grid_field_is_clamped(spark):
    grid = spark.createDataFrame([(i, j, k, float(i), float(j), float(i + j + k)) for i in range(2) for j in range(2) for k in range(2)], "i int, j int, k int, bx double, by double, bz double")
    points = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 9.0, -9.0, 1.0)], "spacepoint_id long, x double, y double, z double")
    got = {r.spacepoint_id: (r.bx, r.by, r.bz) for r in events.grid_field(points, grid, origin=(0.0,) * 3, step=(1.0,) * 3, size=(2, 2, 2)).collect()}
    assert got == {0: (0.5, 0.5, 1.5), 1: (1.0, 0.0, 2.0)}


@pytest.mark.parametrize("seed", range(3))
def test_parallel_resolution_equals_the_greedy_one(spark, seed):
    from trackloom.plans.windows import kept

    rng = random.Random(seed)
    tracks = spark.createDataFrame([(t % 4, t, rng.random()) for t in range(240)], "event_id long, track_id long, pval double")
    links = spark.createDataFrame([(t, rng.randrange(250) + 1000 * (t % 4), k) for t in range(240) for k in range(rng.randint(1, 8))], "track_id long, meas_id long, pos int")
    a = {r.track_id for r in ambiguity.greedy_resolution(tracks, links, max_shared=1).collect()}
    b = {r.track_id for r in ambiguity.parallel_resolution(tracks, links, kept(spark)).collect()}
    assert a == b and a


def test_triplet_fit_of_simulated_tracks(spark):
    planes = [20.0 * i for i in range(9)]
    bz = 2 * seeding.TESLA
    truth = fitting.simulate(spark, 10, 50, planes, bz=bz, p=0.5).cache()
    fit = fitting.triplet_fit(truth, bz=bz).toPandas().merge(truth.where("plane = 0").toPandas(), on=["event_id", "track_id"])
    pull = (fit["qop"] - fit["t_qop"]) / np.sqrt(fit["var_qop"])
    assert abs(pull.mean()) < 0.15 and 0.9 < pull.std() < 1.1
    assert (fit["ndf"] == 13).all() and 0.4 < fit["pval"].mean() < 0.6


def test_graph_seeding_finds_tracks(spark):
    from trackloom.operators import graphseed
    from trackloom.plans.windows import kept
    from trackloom.workers import with_workers

    rng = random.Random(1)
    points = []
    for t in range(12):
        phi, k, cot = rng.uniform(-3, 3), rng.uniform(-2e-4, 2e-4), rng.uniform(-1, 1)
        for layer in range(6):
            r = 32.0 + 24 * layer
            points.append((0, t * 10 + layer, r * math.cos(phi + k * r), r * math.sin(phi + k * r), cot * r))
    sp = spark.createDataFrame(points, "event_id long, spacepoint_id long, x double, y double, z double")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(5)], "layer1 long, layer2 long")
    found = graphseed.graph_seeds(sp, pairs, kept(with_workers(spark))).collect()
    good = {r.bottom_id // 10 for r in found if r.bottom_id // 10 == r.middle_id // 10 == r.top_id // 10}
    assert len(good) >= 10 and len(found) <= 30


def test_cut_search_runs_once_and_keeps_the_best():
    from trackloom.plans import optimise

    calls = []

    def run(config):
        calls.append(config)
        return {"time": config["a"], "efficiency": config["b"] - config["a"] / 10}

    space = {"a": [1, 2, 3], "b": [1, 2]}
    found = optimise.search(optimise.grid(space), run)
    found = optimise.search(optimise.sampled(space, 20), run, found)
    assert len(calls) == 6 and optimise.best_set(found, ["time"], ["efficiency"]) == [(("a", 1), ("b", 2))]
