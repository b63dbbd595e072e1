"""Global triplet fit: curvature from the kinks of consecutive hit triplets.

A triplet's kinks are linear in the signed curvature k: bending kink = turn of the direction in the x-y
plane - k * (mean arc), polar kink = change of the slope in z.  Their covariance has multiple scattering at
the middle hit and the hits' own uncertainties, which couple neighbouring triplets.
"""

from __future__ import annotations

import numpy as np


def _kinks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinks without a field [n, 2 (m - 2)] and their slopes in k, of hits [n, m, 3]."""
    d = np.diff(p, axis=1)
    phi = np.arctan2(d[..., 1], d[..., 0])
    length = np.hypot(d[..., 0], d[..., 1])
    turn = (np.diff(phi, axis=1) + np.pi) % (2 * np.pi) - np.pi
    slope = np.arctan2(d[..., 2], length)
    arc = (length[:, 1:] + length[:, :-1]) / 2
    return np.concatenate((turn, np.diff(slope, axis=1)), 1), np.concatenate((-arc, np.zeros_like(arc)), 1)


def fit(p: np.ndarray, var: np.ndarray, scatter: float = 0.0) -> dict[str, np.ndarray]:
    """Curvature, its variance, chi2 and ndf of tracks with hits ``p`` [n, m, 3] and variances [n, m, 3].

    ``scatter`` is the variance of a scattering angle in a plane.
    """
    n, m, _ = p.shape
    kink, rho = _kinks(p)
    jac = np.empty((n, kink.shape[1], m * 3))
    step = 1e-4
    for i in range(m):
        for c in range(3):
            up, down = p.copy(), p.copy()
            up[:, i, c] += step
            down[:, i, c] -= step
            jac[:, :, i * 3 + c] = (_kinks(up)[0] - _kinks(down)[0]) / (2 * step)
    cov = np.einsum("nij,nj,nkj->nik", jac, var.reshape(n, -1), jac)
    slope = np.arctan2(np.diff(p[..., 2], axis=1), np.hypot(np.diff(p[..., 0], axis=1), np.diff(p[..., 1], axis=1)))[:, 1:]
    noise = np.concatenate((scatter / np.cos(slope) ** 2, np.full_like(slope, scatter)), 1)
    i = np.arange(kink.shape[1])
    cov[:, i, i] += noise + 1e-18
    weight = np.linalg.inv(cov)
    rw = np.einsum("ni,nij->nj", rho, weight)
    info = (rw * rho).sum(1)
    k = -(rw * kink).sum(1) / info
    left = kink + k[:, None] * rho
    return {"curvature": k, "var": 1 / info, "chi2": np.einsum("ni,nij,nj->n", left, weight, left), "ndf": np.full(n, 2 * (m - 2) - 1)}
