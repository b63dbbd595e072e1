"""Connected cells, for all modules of a batch at once."""

from __future__ import annotations

import numpy as np


def settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label reachable over edges (a, b), by hooking and pointer jumping."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
        if (labels == before).all():
            return labels
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def touching(group: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cells of one group whose channels differ by at most 1 each (every pair once)."""
    if not len(group):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = c0.astype(np.int64) - int(c0.min()) + 1, c1.astype(np.int64) - int(c1.min()) + 1
    wide, high = int(y.max()) + 2, int(x.max()) + 2
    key = (group.astype(np.int64) * high + x) * wide + y
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    left, right = [], []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.searchsorted(sorted_, sorted_ + step)
        hit = (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == sorted_ + step)
        left.append(order[np.flatnonzero(hit)])
        right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def components(group: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """For every cell the first row of its component."""
    a, b = touching(group, c0, c1)
    return settle(np.arange(len(group)), a, b)
