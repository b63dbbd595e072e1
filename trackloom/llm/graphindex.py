"""A robust-pruned directed graph over vectors, with beam search, in numpy.

Points are inserted in growing batches: a greedy beam search from the entry point proposes
neighbours, pruning with a relaxed distance keeps diverse edges, and reverse edges are pruned in the
same way.  All searches of a batch advance together.
"""

from __future__ import annotations

import numpy as np


class GraphIndex:
    def __init__(self, vectors: np.ndarray, *, degree: int = 32, beam: int = 64, alpha: float = 1.2, links: np.ndarray | None = None, entry: int | None = None):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(self.x)
        if links is not None:
            self.links, self.entry = links, int(entry or 0)
            return
        self.links = np.full((n, degree), -1, np.int32)
        self.entry = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate(([self.entry], order[order != self.entry]))
        done = 1
        while done < n:
            batch = order[done : done + min(max(1, done), 1024)]
            self._insert(batch)
            done += len(batch)
        for at in range(0, n, 1024):  # the early points see the whole graph in a second pass
            self._insert(order[at : at + 1024])

    def _distance(self, q: np.ndarray, q_sq: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of every row's query to its ids; -1 is infinitely far."""
        dots = np.matmul(self.x[ids], q[:, :, None])[:, :, 0]
        return np.where(ids >= 0, np.maximum(self.sq[ids] + q_sq[:, None] - 2 * dots, 0), np.inf)

    def _minus_product(self, q: np.ndarray, q_sq: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Inner products of every row's query with its ids, negated: a "distance" to rank by."""
        return np.where(ids >= 0, -np.matmul(self.x[ids], q[:, :, None])[:, :, 0], np.inf)

    def search(self, q: np.ndarray, beam: int, *, product: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the ``beam`` nearest found per row, nearest first (-1: none).

        ``product``: nearest by inner product, which then is returned with a minus.
        """
        n, rows = len(self.x), len(q)
        q = np.ascontiguousarray(q, np.float32)
        q_sq = np.einsum("ij,ij->i", q, q)
        measure = self._minus_product if product else self._distance
        every = np.arange(rows)
        ids = np.full((rows, beam), -1, np.int32)
        dist = np.full((rows, beam), np.inf, np.float32)
        open_ = np.zeros((rows, beam), bool)
        ids[:, 0] = self.entry
        dist[:, 0] = measure(q, q_sq, ids[:, :1])[:, 0]
        open_[:, 0] = True
        seen = np.zeros((rows, n + 1), bool)  # the last column stands for "no neighbour"
        seen[:, n] = True
        seen[:, self.entry] = True
        live = every
        while len(live):
            # the two nearest points that haven't been expanded
            rank = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(rank, 1, axis=1)[:, :2] if beam > 2 else rank.argmin(1)[:, None]
            value = np.take_along_axis(rank, pick, 1)
            go = np.isfinite(value)
            some = go.any(1)
            live, pick, go = live[some], pick[some], go[some]
            if not len(live):
                break
            r = np.repeat(live, pick.shape[1]).reshape(pick.shape)
            open_[r[go], pick[go]] = False
            near = self.links[np.where(go, ids[r, pick], 0)]
            near = np.where(go[:, :, None], near, -1).reshape(len(live), -1)
            near = np.where(seen[live[:, None], near], -1, near)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[live[:, None], near] = True
            d = measure(q[live], q_sq[live], near)
            all_d = np.concatenate((dist[live], d), 1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            all_i = np.concatenate((ids[live], near), 1)
            all_o = np.concatenate((open_[live], near >= 0), 1)
            dist[live] = np.take_along_axis(all_d, keep, 1)
            ids[live] = np.take_along_axis(all_i, keep, 1)
            open_[live] = np.take_along_axis(all_o, keep, 1)
        by = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)

    def _prune(self, of: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Robust pruning of each row's candidates: [rows, degree] ids, -1 beyond."""
        out = np.full((len(of), self.degree), -1, np.int32)
        for at in range(0, len(of), 256):
            i, d = ids[at : at + 256], dist[at : at + 256].copy()
            by = np.argsort(d, axis=1, kind="stable")
            i, d = np.take_along_axis(i, by, 1), np.take_along_axis(d, by, 1)
            d[(i == of[at : at + 256, None]) | (i < 0)] = np.inf
            v = self.x[i]
            between = self.sq[i][:, :, None] + self.sq[i][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
            rows = np.arange(len(i))
            alive = d.copy()
            for k in range(self.degree):
                j = alive.argmin(1)
                ok = np.isfinite(alive[rows, j])
                if not ok.any():
                    break
                out[at : at + 256][ok, k] = i[rows, j][ok]
                alive[(self.alpha**2 * between[rows, j] <= d) & ok[:, None]] = np.inf
                alive[rows, j] = np.inf
        return out

    def _insert(self, batch: np.ndarray) -> None:
        for at in range(0, len(batch), 512):
            part = batch[at : at + 512]
            ids, dist = self.search(self.x[part], self.beam)
            old = self.links[part]
            ids = np.concatenate((ids, old), 1)
            dist = np.concatenate((dist, self._distance(self.x[part], self.sq[part], old)), 1)
            by = np.argsort(ids, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
            dist[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            self.links[part] = self._prune(part, ids, dist)
            self._reverse(part)

    def _reverse(self, part: np.ndarray) -> None:
        src = np.repeat(part, self.degree)
        dst = self.links[part].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, many = np.unique(dst, return_index=True, return_counts=True)
        width = int(many.max(initial=0))
        if not width:
            return
        new = np.full((len(to), width), -1, np.int32)
        new[np.repeat(np.arange(len(to)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
        ids = np.concatenate((self.links[to], new), 1)
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        room = (ids >= 0).sum(1) <= self.degree
        packed_all = -np.sort(-ids, axis=1)
        self.links[to[room]] = packed_all[room, : self.degree]
        # points by how many candidates they have, so that all of them are compared in little memory
        size = (ids >= 0).sum(1)
        over = np.flatnonzero(~room)
        over = over[np.argsort(size[over], kind="stable")]
        at = 0
        while at < len(over):
            many = max(1, min(256, (1 << 23) // int(size[over[min(at + 255, len(over) - 1)]]) ** 2))
            o = over[at : at + many]
            cand = packed_all[o][:, : size[o].max()]
            self.links[to[o]] = self._prune(to[o], cand, self._distance(self.x[to[o]], self.sq[to[o]], cand))
            at += many
