"""Combinatorial track finding on ordered planes, breadth first over the planes of one event."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.chi2 import upper_tail
from .kalman import gain_update, predicted_chi2, propagate


@dataclass(frozen=True)
class FindingConfig:
    max_branches_per_seed: int = 10
    max_branches_per_surface: int = 1
    min_length: int = 3
    max_length: int = 100
    max_holes: int = 3
    max_consecutive_holes: int = 1
    chi2_max: float = 30.0
    min_pt: float = 0.0
    duplicate_length: int = 5
    progressive: bool = False
    edge_chi2: float = 1.0


@dataclass
class Branch:
    seed: int
    vec: np.ndarray
    cov: np.ndarray
    meas: tuple[int, ...] = ()
    holes: int = 0
    in_a_row: int = 0
    chi2: float = 0.0
    ndf: int = 0


def find(planes: list[float], hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], seeds: np.ndarray, cov: np.ndarray, start: np.ndarray, bz: float, cfg: FindingConfig | None = None) -> list[Branch]:
    """Branches of at least ``min_length`` measurements.

    ``hits`` holds per plane ids, positions [k, 2], variances [k, 2] and dimensions; ``start`` the plane of each
    seed.  On a plane a branch continues with its best measurements up to ``chi2_max``; without one it gets a
    hole.  Branches of a seed are numbered in the order they are made, those beyond the limit go.
    """
    cfg = cfg or FindingConfig()
    live: list[Branch] = []
    done: list[Branch] = []
    at: list[float] = []
    for p, x in enumerate(planes):
        joining = [Branch(i, seeds[i].copy(), cov[i].copy()) for i in np.flatnonzero(start == p)]
        if live:
            vec, c, ok = propagate(np.stack([b.vec for b in live]), np.stack([b.cov for b in live]), np.full(len(live), x) - np.array(at), bz)
            moved = []
            for i, b in enumerate(live):
                if ok[i]:
                    b.vec, b.cov = vec[i], c[i]
                    moved.append(b)
                else:
                    done.append(b)
            live = moved
        live += joining
        ids, pos, var, dim = hits[p]
        new: list[Branch] = []
        if live and len(ids):
            n, k = len(live), len(ids)
            chi2 = predicted_chi2(np.repeat(np.stack([b.vec for b in live]), k, 0), np.repeat(np.stack([b.cov for b in live]), k, 0), np.tile(pos, (n, 1)), np.tile(var, (n, 1)), np.tile(dim, n)).reshape(n, k)
        for i, b in enumerate(live):
            row = chi2[i] if len(ids) else np.empty(0)
            keep = 1 if cfg.progressive else cfg.max_branches_per_surface
            order = [j for j in np.lexsort((ids, row)) if 0 <= row[j] <= cfg.chi2_max][:keep]
            for j in order:
                v2, c2, _, ok = gain_update(b.vec[None], b.cov[None], pos[j : j + 1], var[j : j + 1], dim[j : j + 1])
                if ok[0] and np.sin(v2[0, 3]) / max(abs(v2[0, 4]), 1e-300) >= cfg.min_pt:
                    new.append(Branch(b.seed, v2[0], c2[0], (*b.meas, int(ids[j])), b.holes, 0, b.chi2 + float(row[j]), b.ndf + int(dim[j])))
            if not order:
                b.holes, b.in_a_row = b.holes + 1, b.in_a_row + 1
                if b.holes > cfg.max_holes or b.in_a_row > cfg.max_consecutive_holes:
                    b.holes, b.in_a_row = b.holes - b.in_a_row, 0
                    done.append(b)
                else:
                    new.append(b)
        new = _without_duplicates(new, cfg) if p >= cfg.duplicate_length and not cfg.progressive else new
        count: dict[int, int] = {}
        live = []
        for b in new:
            count[b.seed] = count.get(b.seed, 0) + 1
            if count[b.seed] <= cfg.max_branches_per_seed:
                (done if len(b.meas) >= cfg.max_length else live).append(b)
        at = [x] * len(live)
    done += live
    return [b for b in done if len(b.meas) >= cfg.min_length]


def _without_duplicates(branches: list[Branch], cfg: FindingConfig) -> list[Branch]:
    """Of branches that end with the same measurements only the one of largest p-value goes on (ties: the first)."""
    best: dict[tuple, tuple[float, int]] = {}
    keys: list[tuple | None] = []
    for i, b in enumerate(branches):
        tail = b.meas[-cfg.duplicate_length :]
        if len(b.meas) <= cfg.duplicate_length or b.ndf <= 5 or b.in_a_row:
            keys.append(None)
            continue
        keys.append(tail)
        p = float(upper_tail(np.array([b.chi2]), np.array([b.ndf - 5.0]))[0])
        if tail not in best or p > best[tail][0]:
            best[tail] = (p, i)
    return [b for i, b in enumerate(branches) if keys[i] is None or best[keys[i]][1] == i]
