"""Quality of hit chains: a small Kalman filter along the radius, for many chains at once.

Bending: (phi, dphi/dr, curvature); along the beam: (z, dz/dr).  A hit adds ``reward`` minus its chi2 times
``weight`` to the quality of its chain.
"""

from __future__ import annotations

import numpy as np


def _filter(r: np.ndarray, value: np.ndarray, has: np.ndarray, order: int, var: np.ndarray, start: np.ndarray) -> np.ndarray:
    """chi2 of every hit against the prediction from those before it."""
    n, m = r.shape
    x = np.zeros((n, order))
    x[:, 0] = value[:, 0]
    p = np.broadcast_to(np.diag(start), (n, order, order)).copy()
    chi2 = np.zeros((n, m))
    h = np.eye(order)[0]
    for t in range(m):
        on = has[:, t]
        if t:
            d = np.where(on, r[:, t] - r[:, t - 1], 0)
            f = np.broadcast_to(np.eye(order), (n, order, order)).copy()
            f[:, 0, 1] = d
            if order == 3:
                f[:, 0, 2], f[:, 1, 2] = d * d / 2, d
            x = np.einsum("nij,nj->ni", f, x)
            p = np.einsum("nij,njk,nlk->nil", f, p, f)
        left = value[:, t] - x[:, 0]
        s = p[:, 0, 0] + var[:, t]
        chi2[:, t] = np.where(on, left * left / s, 0)
        k = p[:, :, 0] / s[:, None] * on[:, None]
        x = x + k * left[:, None]
        p = p - np.einsum("ni,nj->nij", k, np.einsum("i,nij->nj", h, p))
    return chi2


def quality(r: np.ndarray, phi: np.ndarray, z: np.ndarray, has: np.ndarray, *, sigma_phi: float = 0.1, sigma_z: float = 1.0, reward: float = 14.0, weight: float = 1.0, most: float = 25.0) -> np.ndarray:
    """Quality of chains [n, m], hits in order of radius and ``has`` marking real ones; ``sigma_phi`` is a length."""
    turn = np.cumsum(np.concatenate((np.zeros((len(r), 1)), (np.diff(phi, axis=1) + np.pi) % (2 * np.pi) - np.pi), 1), 1) + phi[:, :1]
    bend = _filter(r, turn, has, 3, (sigma_phi / np.maximum(r, 1e-9)) ** 2, np.array([1e-2, 1e-4, 1e-8]))
    beam = _filter(r, z, has, 2, np.full_like(r, sigma_z**2), np.array([1e2, 1e2]))
    chi2 = np.minimum(bend + beam, most)
    return ((reward - weight * chi2) * has).sum(1)
