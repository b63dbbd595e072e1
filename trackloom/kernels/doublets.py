"""Doublets and triplets of space points, for many whole events at a time.

Points come sorted by event, z bin and phi bin.  A middle point looks up its own and the neighbouring bins by
position; pairs are worked on in blocks of at most ``BLOCK``, so memory doesn't grow with an event's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 500_000


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts add up to ``BLOCK`` at most; a row above that is a range of its own."""
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield first, last
        first = last


def _expand(low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the position of every element of the ranges that begin at ``low``."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]


def _compatible(p: dict[str, np.ndarray], m: np.ndarray, o: np.ndarray, cfg) -> np.ndarray:
    """The doublet cut between middle and other; without transverse distance in x or y the helix cut passes.

    The two circles of the smallest radius R through both points have their centres at
    mid +- q n, q^2 = R^2 - d^2 / 4, n the normal of the chord of length d.  As |mid|^2 - d^2 / 4 = m . o and
    mid . n = (m x o) / d, the nearer centre is at the squared distance m . o + R^2 - 2 (q / d) |m x o|.
    """
    big, rise = cfg.min_helix_radius, p["r"][m] - p["r"][o]
    dr, dz = np.abs(rise), np.sign(rise) * (p["z"][m] - p["z"][o])
    origin = p["z"][m] * dr - p["r"][m] * dz
    mx, my, ox, oy = p["x"][m], p["y"][m], p["x"][o], p["y"][o]
    d2 = (ox - mx) * (ox - mx) + (oy - my) * (oy - my)
    centre = mx * ox + my * oy + big * big - 2.0 * np.sqrt(big * big / d2 - 0.25) * np.abs(mx * oy - ox * my)
    straight = (mx == ox) | (my == oy)
    return (
        (np.abs(dz) < cfg.cot_theta_max * dr) & (origin > cfg.collision_min * dr) & (origin < cfg.collision_max * dr) & (np.abs(dz) < cfg.delta_z_max)
        & (straight | ~(centre <= (big - cfg.impact_max) ** 2))
    )


def pairs(p: dict[str, np.ndarray], group: np.ndarray, bins: tuple[int, int], cfg) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Middle and other point of the doublets, all of a middle point in one block and next to each other.

    ``p``: x, y, z, r, var_r, var_z, phi_bin, z_bin; ``group``: the number of a point's event; ``bins``: of phi and z.
    """
    n_phi, n_z = bins
    n = cfg.neighbours
    turns = range(n_phi) if 2 * n + 1 >= n_phi else range(-n, n + 1)  # wrap-around bins once
    code = (group * n_z + p["z_bin"]) * n_phi + p["phi_bin"]
    lows, counts = [], []
    for rise in range(-n, n + 1):
        z_bin = p["z_bin"] + rise
        for turn in turns:
            cell = (group * n_z + z_bin) * n_phi + (p["phi_bin"] + turn) % n_phi
            low = np.searchsorted(code, cell, "left")
            lows.append(low)
            counts.append(np.where((z_bin >= 0) & (z_bin < n_z), np.searchsorted(code, cell, "right") - low, 0))
    # a row per middle and bin, those of a middle next to each other
    lows, counts = np.stack(lows, 1), np.stack(counts, 1)
    for first, last in _blocks(counts.sum(1)):
        row, o = _expand(lows[first:last].ravel(), counts[first:last].ravel())
        m = row // lows.shape[1] + first
        dr = np.abs(p["r"][m] - p["r"][o])
        near = (dr < cfg.delta_r_max) & (dr > cfg.delta_r_min)
        m, o = m[near], o[near]
        with np.errstate(all="ignore"):
            good = _compatible(p, m, o, cfg)
        yield m[good], o[good]


def _lines(p: dict[str, np.ndarray], m: np.ndarray, o: np.ndarray) -> dict[str, np.ndarray]:
    """Inverse distance, cot theta, error, and the conformal u and v of doublets."""
    dx, dy = p["x"][o] - p["x"][m], p["y"][o] - p["y"][m]
    inv = 1.0 / np.sqrt(dx * dx + dy * dy)
    cot = np.sign(p["r"][m] - p["r"][o]) * (p["z"][m] - p["z"][o]) * inv
    mx, my, mr = p["x"][m], p["y"][m], p["r"][m]
    return {
        "inv": inv,
        "cot": cot,
        "er": ((p["var_z"][m] + p["var_z"][o]) + cot * cot * (p["var_r"][m] + p["var_r"][o])) * inv * inv,
        "u": (dx * mx + dy * my) / mr * inv * inv,
        "v": (dy * mx - dx * my) / mr * inv * inv,
    }


def z_at_axis(p: dict[str, np.ndarray], m: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Where the line through a doublet meets the axis."""
    return p["z"][m] - p["r"][m] * _lines(p, m, o)["cot"]


def triplets(p: dict[str, np.ndarray], group: np.ndarray, bins: tuple[int, int], cfg) -> Iterator[dict[str, np.ndarray]]:
    """Doublets of one middle point that lie on a common helix: the points b, m and t, curvature and impact.

    ``side`` numbers the pair of bottom and middle; all triplets of one are next to each other in one block.
    """
    for m, o in pairs(p, group, bins, cfg):
        with np.errstate(all="ignore"):
            line = _lines(p, m, o)
        bottom = p["r"][m] > p["r"][o]
        b, t = np.flatnonzero(bottom), np.flatnonzero(~bottom)
        low = np.searchsorted(m[t], m[b], "left")
        counts = np.searchsorted(m[t], m[b], "right") - low
        for first, last in _blocks(counts):
            row, at = _expand(low[first:last], counts[first:last])
            bs, ts = b[first:last][row], t[at]
            with np.errstate(all="ignore"):
                good, curvature, impact = _common({k: v[bs] for k, v in line.items()}, {k: v[ts] for k, v in line.items()}, {k: p[k][m[bs]] for k in ("r", "var_r", "var_z")}, cfg)
            bs, ts = bs[good], ts[good]
            yield {"b": o[bs], "m": m[bs], "t": o[ts], "side": row[good], "curvature": curvature[good], "impact": impact[good]}


def _common(b: dict[str, np.ndarray], t: dict[str, np.ndarray], m: dict[str, np.ndarray], cfg) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes agree within errors and scattering, the helix is wide enough, and the impact parameter small enough.

    The line v = a u + b through both points is written without division: a = dv / du and b = bn / du.
    """
    s2_cut, high = cfg.sigma_scattering**2, (cfg.highland / cfg.max_pt_scattering) ** 2
    error2 = t["er"] + b["er"] + 2.0 * (b["cot"] * t["cot"] * m["var_r"] + m["var_z"]) * b["inv"] * t["inv"]
    dcot = b["cot"] - t["cot"]
    dcot2 = dcot * dcot
    excess = dcot2 + error2 - 2.0 * np.abs(dcot) * np.sqrt(error2)
    du, dv = t["u"] - b["u"], t["v"] - b["v"]
    s2, bn = du * du + dv * dv, b["v"] * du - dv * b["u"]
    off = np.abs((dv - bn * m["r"]) * m["r"])
    rise = 1.0 + b["cot"] * b["cot"]
    # scattering of the curvature's momentum, but at most that of max_pt_scattering: pT^2 = B^2 s2 / (4 bn^2)
    slow = cfg.b_z**2 * s2 <= 4 * cfg.max_pt_scattering**2 * bn * bn
    scatter = np.where(slow, excess * s2 <= 4.0 * bn * bn * (cfg.pt2_per_radius * s2_cut) * rise, excess <= high * s2_cut * rise)
    good = (du != 0) & (s2 >= bn * bn * cfg.min_helix_diameter2) & (off <= cfg.impact_max * np.abs(du))
    good &= (dcot2 - error2 <= 0) | ((excess <= cfg.max_scattering2 * s2_cut * rise) & scatter)
    return good, bn / np.sqrt(s2) * np.sign(du), off / np.abs(du)


def compatible_tops(side: np.ndarray, curvature: np.ndarray, t_id: np.ndarray, t_r: np.ndarray, flt) -> np.ndarray:
    """0, 1 or 2: other tops on the same curve of the same bottom and middle (``side``).

    Tops count in the order of their ids; the first always does, a second one if it is at least
    ``delta_r_min`` from the first in radius.  That needs the first and whether any other is far enough.
    """
    out = np.zeros(len(side), np.int64)
    order = np.lexsort((curvature, side))
    key = side[order] + 1j * curvature[order]  # complex numbers are ordered by side, then curvature
    low = np.searchsorted(key, side + 1j * (curvature - flt.delta_inv_diameter), "left")
    counts = np.searchsorted(key, side + 1j * (curvature + flt.delta_inv_diameter), "right") - low
    for first, last in _blocks(counts):
        row, at = _expand(low[first:last], counts[first:last])
        row, other = row + first, order[at]
        far = (t_id[row] != t_id[other]) & (np.abs(t_r[row] - t_r[other]) >= flt.delta_r_min)
        row, other = row[far], other[far]
        by_id = np.lexsort((t_id[other], row))
        row, r = row[by_id], t_r[other[by_id]]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        many = np.diff(starts, append=len(row))
        out[row[starts]] = 1
        out[row[np.abs(r - np.repeat(r[starts], many)) >= flt.delta_r_min]] = 2
    return out
