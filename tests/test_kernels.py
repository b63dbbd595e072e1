import math

import numpy as np
import pytest

from trackloom.functions.chi2 import upper_tail
from trackloom.kernels import kalman as K
from trackloom.kernels.search import FindingConfig
from trackloom.kernels.union import components
from trackloom.operators import fitting as F


@pytest.mark.parametrize(("chi2", "ndf", "p"), [(0, 0.1, 1), (0, 1, 1), (0, 10, 1), (-1, 12, 0), (-194, 12, 0), (3, -17.4, 0), (27, 0, 0), (3, 5, 0.69998584), (17.4, 6.26, 0.0094291369)])
def test_upper_tail(chi2, ndf, p):
    assert upper_tail(np.array([chi2]), np.array([ndf]))[0] == pytest.approx(p, abs=1e-7)


@pytest.mark.parametrize("n", [2, 4, 20, 60])
def test_upper_tail_closed_form(n):
    x = np.linspace(0.1, 120, 60)
    want = np.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(n // 2))
    assert np.allclose(upper_tail(x, np.full_like(x, n)), want, rtol=1e-10, atol=1e-14)


def test_transport_back_and_forth_and_circle():
    vec = np.array([[1.0, 2, 0.3, 1.2, -0.5, 0], [0, 0, -0.2, 1.6, 1.0, 0]])
    bz = 2 * 2.99792458e-4
    out, ok = K.transport(vec, np.array([80.0, 80.0]), bz)
    back, _ = K.transport(out, np.array([-80.0, -80.0]), bz)
    assert ok.all() and np.allclose(back, vec)
    r = np.sin(vec[:, 3]) / (vec[:, 4] * bz)
    for v, o, radius in zip(vec, out, r, strict=True):  # both points lie on the circle of radius pT / B
        centre = np.array([radius * np.sin(v[2]), v[0] - radius * np.cos(v[2])])
        assert np.hypot(80 - centre[0], o[0] - centre[1]) == pytest.approx(abs(radius))


def test_gain_update_is_the_weighted_mean():
    vec, cov = np.array([[0.0, 0, 0, 1.5, 1, 0]]), np.diag([4.0, 9, 1, 1, 1, 1])[None]
    out, c, _, ok = K.gain_update(vec, cov, np.array([[2.0, 3.0]]), np.array([[4.0, 1.0]]), np.array([2]))
    assert ok[0] and np.allclose(out[0, :2], [1.0, 2.7]) and np.allclose(np.diag(c[0])[:2], [2.0, 0.9])
    out, _, _, _ = K.gain_update(vec, cov, np.array([[2.0, 3.0]]), np.array([[4.0, 1.0]]), np.array([1]))
    assert np.allclose(out[0, :2], [1.0, 0.0])


def test_two_smoothers_agree():
    rng = np.random.default_rng(3)
    n, m, bz = 5, 6, 2 * 2.99792458e-4
    x = np.broadcast_to(np.arange(m) * 20.0, (n, m))
    vec = np.column_stack((rng.uniform(-5, 5, (n, 2)), rng.uniform(-0.1, 0.1, n), np.pi / 2 + rng.uniform(-0.1, 0.1, n), np.full(n, 1.0), np.zeros(n)))
    truth = [vec]
    for _ in range(m - 1):
        truth.append(K.transport(truth[-1], np.full(n, 20.0), bz)[0])
    meas = np.stack([t[:, :2] for t in truth], 1) + rng.normal(0, 0.05, (n, m, 2))
    var, dim, has = np.full((n, m, 2), 0.0025), np.full((n, m), 2), np.ones((n, m), bool)
    cov0 = np.broadcast_to(np.diag(F.SIGMA**2) * 100, (n, 6, 6))
    pred, pcov, jac = np.empty((n, m, 6)), np.empty((n, m, 6, 6)), np.empty((n, m, 6, 6))
    v, c = vec.copy(), cov0.copy()
    for t in range(m):
        pred[:, t], pcov[:, t] = v, c
        v, c, _, _ = K.gain_update(v, c, meas[:, t], var[:, t], dim[:, t])
        for j in range(6):
            step = np.eye(6)[j] * K._STEP[j]
            jac[:, t, :, j] = (K.transport(v + step, np.full(n, 20.0), bz)[0] - K.transport(v - step, np.full(n, 20.0), bz)[0]) / (2 * K._STEP[j])
        v, c, _ = K.propagate(v, c, np.full(n, 20.0), bz)
    smoothed, scov = K.mbf_smooth(pred, pcov, jac, meas, var, dim, has)
    out = K.fit(x, meas, var, dim, has, vec, np.broadcast_to(np.diag(F.SIGMA**2), (n, 6, 6)), bz)
    assert np.allclose(smoothed[:, 0, :4], out["smoothed"][:, 0, :4], atol=0.02)
    assert (np.einsum("nmii->nmi", scov)[:, :, :4] > 0).all()


def test_components_against_flood_fill():
    rng = np.random.default_rng(1)
    cells = sorted({(int(g), int(a), int(b)) for g, a, b in zip(rng.integers(0, 4, 700), rng.integers(0, 25, 700), rng.integers(0, 25, 700), strict=True)})
    g, a, b = (np.array(v) for v in zip(*cells, strict=True))
    got = components(g, a, b)
    at = {c: i for i, c in enumerate(cells)}
    want = {}
    for i, c in enumerate(cells):
        if i in want:
            continue
        todo = [c]
        while todo:
            k, u, v = todo.pop()
            j = at[k, u, v]
            if j in want:
                continue
            want[j] = i
            todo += [(k, u + du, v + dv) for du in (-1, 0, 1) for dv in (-1, 0, 1) if (k, u + du, v + dv) in at]
    assert [want[i] for i in range(len(cells))] == got.tolist()


def test_fit_of_simulated_tracks(spark):
    planes = [20.0 * i for i in range(9)]
    bz = 2 * 2.99792458e-4
    truth = F.simulate(spark, 20, 50, planes, bz=bz).cache()
    seeds = F.smeared_seeds(truth)
    fit = F.fit_tracks(truth, seeds, bz=bz).toPandas().merge(truth.where("plane = 0").toPandas(), on=["event_id", "track_id"])
    assert (fit["fit_outcome"] == K.SUCCESS).all() and (fit["ndf"] == 13).all()
    for name in ("loc0", "loc1", "phi", "theta", "qop"):
        pull = (fit[name] - fit[f"t_{name}"]) / np.sqrt(fit[f"var_{name}"])
        assert abs(pull.mean()) < 0.12 and 0.9 < pull.std() < 1.1, name
    assert 0.4 < fit["pval"].mean() < 0.6


def test_finding_recovers_simulated_tracks(spark):
    planes = [20.0 * i for i in range(9)]
    bz = 2 * 2.99792458e-4
    truth = F.simulate(spark, 4, 8, planes, bz=bz).cache()
    seeds = F.smeared_seeds(truth, scale=0.02).withColumnRenamed("track_id", "seed_id").selectExpr("*", "0 AS plane")
    for cfg in (FindingConfig(), FindingConfig(progressive=True)):
        found = F.find_tracks(truth, seeds, planes, bz=bz, cfg=cfg).toPandas()
        n = 0
        for (_, seed), g in found.groupby(["event_id", "seed_id"]):
            n += set(g["meas_id"]) == {i * 8 + seed for i in range(9)}
        assert n >= 30


def test_holes_and_short_tracks_in_finding(spark):
    planes = [20.0 * i for i in range(9)]
    truth = F.simulate(spark, 1, 1, planes, bz=0.0).cache()
    seeds = F.smeared_seeds(truth, scale=0.0).withColumnRenamed("track_id", "seed_id").selectExpr("*", "0 AS plane")
    one_gap = F.find_tracks(truth.where("plane <> 4"), seeds, planes, bz=0.0).toPandas()
    two_gaps = F.find_tracks(truth.where("plane NOT IN (4, 5)"), seeds, planes, bz=0.0).toPandas()
    short = F.find_tracks(truth.where("plane < 2"), seeds, planes, bz=0.0).toPandas()
    assert len(one_gap) == 8 and len(two_gaps) == 4 and len(short) == 0


def test_small_matrices():
    from trackloom.functions import matrices

    cov = np.array([[4.0, 1.0], [1.0, -0.005]])[None]
    assert matrices.inflate(cov, 10.0).tolist() == [[[40.0, 0.0], [0.0, -0.05]]]
    fixed, ok = matrices.regularize(cov)
    assert ok.tolist() == [True] and fixed[0, 1, 1] == 0.005 and not matrices.regularize(cov * 10)[1][0]
    h = matrices.projector((1, 0), 6)
    assert (h @ np.arange(6)).tolist() == [1, 0] and (h.T @ np.array([5.0, 7.0])).tolist() == [7, 5, 0, 0, 0, 0]
