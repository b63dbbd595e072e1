"""Kalman filtering of many tracks at once on planes perpendicular to x, in a constant field along z.

A state is (loc0 = y, loc1 = z, phi, theta, q/p, time) on a plane x = const.  All arrays have the tracks
as first axis.  The transport is the analytic helix: sin(phi) changes by k dx with k = -(q/p) B / sin(theta).
"""

from __future__ import annotations

import numpy as np

LOC0, LOC1, PHI, THETA, QOP, TIME = range(6)
SUCCESS, NON_POSITIVE_NDF, NOT_ALL_FITTED, NOT_ALL_SMOOTHED = 1, 2, 3, 4
_STEP = np.array([1e-4, 1e-4, 1e-6, 1e-6, 1e-6, 1e-4])


def transport(vec: np.ndarray, dx: np.ndarray, bz: float) -> tuple[np.ndarray, np.ndarray]:
    """States after ``dx`` along x, and whether the helix reaches that far."""
    out = vec.copy()
    phi, theta = vec[:, PHI], vec[:, THETA]
    k = -vec[:, QOP] * bz / np.sin(theta)
    s0 = np.sin(phi)
    s1 = s0 + k * dx
    ok = (np.abs(s1) < 1) & (np.cos(phi) > 0)
    s1 = np.where(ok, s1, 0.0)
    phi1 = np.arcsin(s1)
    c0, c1 = np.cos(phi), np.cos(phi1)
    ds = s1 - s0
    arc = np.where(np.abs(ds) > 1e-9, dx * (phi1 - phi) / np.where(ds == 0, 1, ds), dx / c0)
    out[:, LOC0] += dx * (s0 + s1) / (c0 + c1)
    out[:, LOC1] += arc / np.tan(theta)
    out[:, PHI] = phi1
    return out, ok


def propagate(vec: np.ndarray, cov: np.ndarray, dx: np.ndarray, bz: float, scatter: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States and covariances after ``dx``; ``scatter`` is the variance of the angles added per plane at 1 GeV."""
    out, ok = transport(vec, dx, bz)
    jac = np.empty((len(vec), 6, 6))
    for j in range(6):
        up, down = vec.copy(), vec.copy()
        up[:, j] += _STEP[j]
        down[:, j] -= _STEP[j]
        jac[:, :, j] = (transport(up, dx, bz)[0] - transport(down, dx, bz)[0]) / (2 * _STEP[j])
    cov = np.einsum("nij,njk,nlk->nil", jac, cov, jac)
    if scatter:
        noise = scatter * out[:, QOP] ** 2
        cov[:, PHI, PHI] += noise / np.sin(out[:, THETA]) ** 2
        cov[:, THETA, THETA] += noise
    return out, cov, ok


def normalise(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles in their ranges; false at the poles and for states that aren't finite or have no momentum."""
    out = vec.copy()
    theta = np.mod(out[:, THETA], 2 * np.pi)
    over = theta > np.pi
    out[:, PHI] = np.mod(out[:, PHI] + np.where(over, np.pi, 0) + np.pi, 2 * np.pi) - np.pi
    out[:, THETA] = np.where(over, 2 * np.pi - theta, theta)
    ok = np.isfinite(out).all(1) & (out[:, QOP] != 0) & (out[:, THETA] > 0) & (out[:, THETA] < np.pi)
    return out, ok


def masked_inverse(m: np.ndarray, dim: np.ndarray) -> np.ndarray:
    """Inverses of 2 x 2 matrices; with one dimension only of the first element."""
    out = np.zeros_like(m)
    det = m[:, 0, 0] * m[:, 1, 1] - m[:, 0, 1] * m[:, 1, 0]
    two = dim == 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 0, 0] = np.where(two, m[:, 1, 1] / det, 1 / m[:, 0, 0])
        out[:, 1, 1] = np.where(two, m[:, 0, 0] / det, 0)
        out[:, 0, 1] = np.where(two, -m[:, 0, 1] / det, 0)
        out[:, 1, 0] = np.where(two, -m[:, 1, 0] / det, 0)
    return out


def _observe(vec: np.ndarray, cov: np.ndarray, meas: np.ndarray, var: np.ndarray, dim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals, P H^T and the measurement covariance; a second coordinate of one-dimensional rows counts nothing."""
    use = np.stack((np.ones(len(vec)), (dim == 2).astype(float)), 1)
    res = (meas - vec[:, :2]) * use
    pht = cov[:, :, :2] * use[:, None, :]
    v = np.zeros((len(vec), 2, 2))
    v[:, 0, 0], v[:, 1, 1] = var[:, 0], np.where(dim == 2, var[:, 1], 1.0)
    return res, pht, v


def predicted_chi2(vec: np.ndarray, cov: np.ndarray, meas: np.ndarray, var: np.ndarray, dim: np.ndarray) -> np.ndarray:
    res, pht, v = _observe(vec, cov, meas, var, dim)
    r = pht[:, :2, :] + v
    return np.einsum("ni,nij,nj->n", res, masked_inverse(r, dim), res)


def gain_update(vec: np.ndarray, cov: np.ndarray, meas: np.ndarray, var: np.ndarray, dim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filtered states, covariances (Joseph form), chi2 of the filtered residual, and whether all is well."""
    res, pht, v = _observe(vec, cov, meas, var, dim)
    k = np.einsum("nij,njk->nik", pht, masked_inverse(pht[:, :2, :] + v, dim))
    new, ok = normalise(vec + np.einsum("nij,nj->ni", k, res))
    kh = np.zeros_like(cov)
    kh[:, :, :2] = k
    a = np.eye(6) - kh
    cov2 = np.einsum("nij,njk,nlk->nil", a, cov, a) + np.einsum("nij,njk,nlk->nil", k, v, k)
    diag = np.einsum("nii->ni", cov2)
    ok &= (diag >= -0.01).all(1)
    i = np.arange(6)
    cov2[:, i, i] = np.abs(diag)
    left, _, _ = _observe(new, cov2, meas, var, dim)
    r = v - np.einsum("nij,njk->nik", k[:, :2, :], v)
    chi2 = np.einsum("ni,nij,nj->n", left, masked_inverse(r, dim), left)
    return new, cov2, chi2, ok


def smooth(f_vec: np.ndarray, f_cov: np.ndarray, b_vec: np.ndarray, b_cov: np.ndarray, meas: np.ndarray, var: np.ndarray, dim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Information-weighted mean of the forward filtered and the backward predicted state, and its chi2."""
    fi, bi = np.linalg.inv(f_cov), np.linalg.inv(b_cov)
    cov = np.linalg.inv(fi + bi)
    turn = np.zeros_like(f_vec)
    turn[:, PHI] = 2 * np.pi * np.round((f_vec[:, PHI] - b_vec[:, PHI]) / (2 * np.pi))
    vec = np.einsum("nij,nj->ni", cov, np.einsum("nij,nj->ni", fi, f_vec) + np.einsum("nij,nj->ni", bi, b_vec + turn))
    vec, ok = normalise(vec)
    res, pht, v = _observe(vec, cov, meas, var, dim)
    chi2 = np.einsum("ni,nij,nj->n", res, masked_inverse(v - pht[:, :2, :], dim), res)
    return vec, cov, chi2, ok & np.isfinite(chi2) & (chi2 >= -10)


def mbf_smooth(pred: np.ndarray, pred_cov: np.ndarray, jac: np.ndarray, meas: np.ndarray, var: np.ndarray, dim: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Modified Bryson-Frazier smoothing from stored predictions [n, m, 6] and transports to the next plane [n, m, 6, 6].

    Two backward accumulators replace the inversion of state covariances.
    """
    n, m, _ = pred.shape
    small, big = np.zeros((n, 6)), np.zeros((n, 6, 6))
    out, cov_out = pred.copy(), pred_cov.copy()
    for t in range(m - 1, -1, -1):
        if t < m - 1:
            small = np.einsum("nji,nj->ni", jac[:, t], small)
            big = np.einsum("nji,njk,nkl->nil", jac[:, t], big, jac[:, t])
        p = pred_cov[:, t]
        res, pht, v = _observe(pred[:, t], p, meas[:, t], var[:, t], dim[:, t])
        si = masked_inverse(pht[:, :2, :] + v, dim[:, t]) * has[:, t, None, None]
        use = np.stack((np.ones(n), (dim[:, t] == 2).astype(float)), 1)
        h = np.zeros((n, 2, 6))
        h[:, 0, 0], h[:, 1, 1] = use[:, 0], use[:, 1]
        k = np.einsum("nij,njk->nik", pht, si)
        c = np.eye(6) - np.einsum("nij,njk->nik", k, h)
        small = np.einsum("nji,nj->ni", c, small) - np.einsum("nji,njk,nk->ni", h, si, res)
        big = np.einsum("nji,njk,nkl->nil", c, big, c) + np.einsum("nji,njk,nkl->nil", h, si, h)
        out[:, t] = pred[:, t] - np.einsum("nij,nj->ni", p, small)
        cov_out[:, t] = p - np.einsum("nij,njk,nkl->nil", p, big, p)
    return out, cov_out


def fit(x: np.ndarray, meas: np.ndarray, var: np.ndarray, dim: np.ndarray, has: np.ndarray, seed: np.ndarray, cov: np.ndarray, bz: float, *, inflation: float = 1e3, scatter: float = 0.0, iterations: int = 1) -> dict[str, np.ndarray]:
    """Forward filter, backward filter and smoothing of tracks with up to m states.

    ``x`` [n, m] are the planes in order, ``has`` marks states with a measurement (else a hole); ``seed`` lies on
    the first plane.  Returns smoothed states, chi2, ndf = sum of dimensions - 5 and the outcome.
    """
    n, m = x.shape
    seed = seed.copy()
    eye = np.eye(6)
    for _ in range(iterations):
        vec, c = seed, np.einsum("nii->ni", cov)[:, :, None] * eye * inflation
        f_vec, f_cov = np.empty((n, m, 6)), np.empty((n, m, 6, 6))
        good = np.ones(n, bool)
        used = has.any(1)
        for t in range(m):
            if t:
                vec, c, ok = propagate(vec, c, x[:, t] - x[:, t - 1], bz, scatter)
                good &= ok
            new, c2, _, ok = gain_update(vec, c, meas[:, t], var[:, t], dim[:, t])
            on = has[:, t]
            good &= ok | ~on
            vec, c = np.where(on[:, None], new, vec), np.where(on[:, None, None], c2, c)
            f_vec[:, t], f_cov[:, t] = vec, c
        s_vec, s_cov = f_vec.copy(), f_cov.copy()
        back_chi2 = np.zeros((n, m))
        smoothed = np.ones(n, bool)
        vec, c = f_vec[:, -1], np.einsum("nii->ni", f_cov[:, -1])[:, :, None] * eye * inflation
        for t in range(m - 1, -1, -1):
            if t < m - 1:
                vec, c, ok = propagate(vec, c, x[:, t] - x[:, t + 1], bz, scatter)
                good &= ok
                sv, sc, _, ok = smooth(f_vec[:, t], f_cov[:, t], vec, c, meas[:, t], var[:, t], dim[:, t])
                smoothed &= ok
                s_vec[:, t], s_cov[:, t] = sv, sc
            new, c2, chi2, ok = gain_update(vec, c, meas[:, t], var[:, t], dim[:, t])
            on = has[:, t]
            good &= ok | ~on
            back_chi2[:, t] = np.where(on, chi2, 0)
            vec, c = np.where(on[:, None], new, vec), np.where(on[:, None, None], c2, c)
        seed = s_vec[:, 0]
    ndf = (dim * has).sum(1) - 5
    outcome = np.where(~good | ~used, NOT_ALL_FITTED, np.where(~smoothed, NOT_ALL_SMOOTHED, np.where(ndf <= 0, NON_POSITIVE_NDF, SUCCESS)))
    return {"smoothed": s_vec, "smoothed_cov": s_cov, "filtered": f_vec, "chi2": back_chi2.sum(1), "ndf": ndf, "outcome": outcome, "n_holes": (~has).sum(1)}
