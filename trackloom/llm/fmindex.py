"""A compressed FM-index over integer sequences and repeated-interval search, in numpy.

The Burrows-Wheeler transform is kept as a Huffman-shaped wavelet tree: a symbol takes as many bits as
its frequency is worth, so the tree has about the entropy of the words, in packed bit vectors with a
running count per 64 bits.  All searches advance together, one symbol a step.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_ranks(first: np.ndarray) -> np.ndarray:
    """Rank of every suffix, by prefix doubling that sorts only what is still tied.

    ``first`` orders the symbols; the last one must be unique.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    sorted_ = first[order]
    start = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    tied = order[~(start & np.concatenate((start[1:], [True])))]
    k = 1
    while len(tied):
        key = rank[tied] * (n + 1) + np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = key // (n + 1)
        at = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
        tied = tied[~(new & np.concatenate((new[1:], [True])))]
        k *= 2
    return rank


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 64 + 1
        padded = np.zeros(blocks * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        block = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE == _ONE


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two children of every inner node, in the order of their making: leaves are 0.. and inner nodes follow.

    Both queues (leaves by count, inner nodes as they are made) rise, so the next pair is at their fronts.
    """
    m = len(counts)
    order = np.argsort(counts, kind="stable").tolist()
    weight = [*counts.tolist(), *[0] * (m - 1)]
    left, right = [0] * (m - 1), [0] * (m - 1)
    i, j = 0, m
    for made in range(m, 2 * m - 1):
        pair = []
        for _ in range(2):
            if i < m and (j >= made or weight[order[i]] <= weight[j]):
                pair.append(order[i])
                i += 1
            else:
                pair.append(j)
                j += 1
        left[made - m], right[made - m] = pair
        weight[made] = weight[pair[0]] + weight[pair[1]]
    return np.array(left, np.int64), np.array(right, np.int64)


class WaveletTree:
    """Rank queries over a sequence of integers 0.., in a Huffman-shaped tree kept level by level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        counts = np.bincount(seq, minlength=symbols)
        self.m = m = max(2, symbols)
        counts = np.pad(counts, (0, m - symbols))
        left, right = huffman(counts)
        self.child = np.concatenate((left, right))  # child b of node v: at v - m + b * (m - 1)
        nodes = 2 * m - 1
        depth, parent, side = np.zeros(nodes, np.int32), np.zeros(nodes, np.int64), np.zeros(nodes, np.uint8)
        every = np.arange(m, nodes)
        parent[left], parent[right], side[right] = every, every, 1
        level = [np.array([nodes - 1])]  # the nodes of every level, inner ones only
        while True:
            inner = level[-1]
            below = np.stack((left[inner - m], right[inner - m]), 1).ravel()
            depth[below] = len(level)
            below = below[below >= m]
            if not len(below):
                break
            level.append(below)
        self.depth = depth[:m]
        # the path of a symbol, as bits from the root: walked up from all leaves together
        self.code = np.zeros((len(level), m), bool)
        above = np.arange(m)
        for d in range(len(level), 0, -1):
            some = np.flatnonzero(self.depth >= d)
            at = above[some]
            self.code[d - 1, some] = side[at]
            above[some] = parent[at]
        self.start, self.ones = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.levels: list[Bits] = []
        cur = seq.astype(np.int64)
        node = np.full(len(cur), nodes - 1)
        for d, inner in enumerate(level):
            bit = self.code[d, cur]
            bits = Bits(bit)
            size = np.bincount(node, minlength=nodes)[inner]
            self.start[inner] = np.cumsum(size) - size
            self.ones[inner] = bits.rank(self.start[inner])
            self.levels.append(bits)
            below = np.where(bit, right[node - m], left[node - m])
            stay = below >= m
            cur, below, node = cur[stay], below[stay], node[stay]
            if d + 1 < len(level):
                place = np.zeros(nodes, np.int64)
                place[level[d + 1]] = np.arange(len(level[d + 1]))
                by = np.argsort(place[below], kind="stable")
                cur, node = cur[by], below[by]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before position ``at`` of the sequence."""
        out = np.array(at, np.int64)
        live = np.arange(len(out))
        node = np.full(len(out), 2 * self.m - 2)
        for d, bits in enumerate(self.levels):
            now = out[live]
            ones = bits.rank(self.start[node] + now) - self.ones[node]
            up = self.code[d, symbol[live]]
            out[live] = np.where(up, ones, now - ones)
            node = self.child[node - self.m + up * (self.m - 1)]
            stay = node >= self.m
            live, node = live[stay], node[stay]
            if not len(live):
                break
        return out


class FMIndex:
    """Index of weighted sequences of symbols 1..; each sequence ends with a terminator of its own.

    Of the weights (1 or more) a bit per suffix is kept, and a running sum over those that are 2 or more.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        n, m = int(lengths.sum() + len(lengths)), len(lengths)
        inside = np.ones(n, bool)
        inside[ends] = False
        self.text = np.zeros(n, np.int32)  # what is streamed against the index
        self.text[inside] = symbols
        first = self.text.astype(np.int64) + m
        first[ends] = np.arange(m)
        rank = suffix_ranks(first)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        owner = np.repeat(np.arange(m), lengths + 1)
        over = (weights - 1)[owner][order]
        self.heavy = Bits(over > 0)
        self.over = np.concatenate(([0], np.cumsum(over[over > 0])))
        counts = np.bincount(self.text, minlength=int(self.text.max(initial=0)) + 1)
        self.tree = WaveletTree(self.text[order - 1], len(counts))
        self.less = np.cumsum(counts) - counts
        self.n = n

    def twice(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the suffixes of [lo, hi) weigh 2 or more together."""
        return (hi - lo > 1) | ((hi - lo == 1) & self.heavy.get(np.minimum(lo, self.n - 1)))

    def prepend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with ``symbol`` and then a suffix of [lo, hi)."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        less = self.less[symbol]
        return less + both[: len(lo)], less + both[len(lo) :]

    def count(self, pattern: np.ndarray) -> int:
        """Total weight of the places where ``pattern`` occurs."""
        lo, hi = np.array([0]), np.array([self.n])
        for c in pattern[::-1]:
            lo, hi = self.prepend(np.array([c]), lo, hi)
            if lo[0] >= hi[0]:
                return 0
        return int(hi[0] - lo[0] + self.over[self.heavy.rank(hi)[0]] - self.over[self.heavy.rank(lo)[0]])

    def repeated(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, start, end): all intervals of ``window`` symbols or more with a weight of 2 or more.

        Streams every indexed sequence from its end to its start.  The matching statistics are
        followed only as far as they can still matter: where a match breaks at symbol f, every
        further interval must contain f, so a few symbols from f on are searched first, and ends
        that this rules out are skipped.
        """
        lengths = np.diff(np.concatenate((self.starts, [self.n]))) - 1
        seq = np.flatnonzero(lengths >= window)
        base, end = self.starts[seq], lengths[seq] - 1
        at, cand, stop, mode = end.copy(), end.copy(), np.zeros_like(end), np.zeros_like(end)
        lo, hi = np.zeros_like(end), np.full_like(end, self.n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seq):
            lo2, hi2 = self.prepend(self.text[base + at], lo, hi)
            hi2 = np.maximum(lo2, hi2)
            ok = self.twice(lo2, hi2)
            lo, hi = lo2, hi2
            failed_at = at
            at = np.where(ok, at - 1, at)
            # a probe that took in its stop symbol: look further, or search from the candidate end
            passed = ok & (mode > 0) & (at < stop)
            whole = passed & (end == cand)
            mode = np.where(whole, 0, mode)
            passed &= ~whole
            over = ok & (mode == 0) & (at < 0)
            broke = ~ok & (mode == 0)
            hit = over | (broke & (end - at >= window))
            if hit.any():
                found.append((seq[hit], at[hit] + 1, end[hit] + 1))
            cand = np.where(broke, np.minimum(end - 1, failed_at + window - 1), cand)
            cand = np.where(~ok & (mode > 0), end - 1, cand)
            stop = np.where(broke, failed_at, stop)
            again = ~ok | passed
            near = np.where(broke, stop + 3, np.where(passed & (mode == 1), stop + 15, cand))
            end2 = np.where(again, np.minimum(near, cand), end)
            mode = np.where(again, np.where(end2 < cand, np.where(broke, 1, 2), 0), mode)
            end = end2
            at = np.where(again, end, at)
            lo = np.where(again, 0, lo)
            hi = np.where(again, self.n, hi)
            live = ~over & ~(again & (cand < window - 1))
            if not live.all():
                seq, base, end, at, cand, stop, mode, lo, hi = (x[live] for x in (seq, base, end, at, cand, stop, mode, lo, hi))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
