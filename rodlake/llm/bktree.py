"""Burkhard-Keller trees over binary fingerprints, many trees at once in numpy."""

from __future__ import annotations

import numpy as np

#: Frontier pairs handled at once; bounds the memory of a search.
CHUNK = 1 << 20


class Forest:
    """One BK-tree for each unit; a child hangs under its parent by the integer Hamming distance to it.

    fp: (n, w) uint64 fingerprints; unit: (n,) ids, rows of one unit form one tree.
    """

    def __init__(self, fp: np.ndarray, unit: np.ndarray):
        self.fp, self.bits = fp, fp.shape[1] * 64 + 1
        n = len(fp)
        _, slot = np.unique(unit, return_inverse=True)
        left = np.argsort(slot, kind="stable")
        slot = slot[left]
        self.root = np.zeros(n, np.int64)
        keys, kids = [], []
        key_of = None
        while len(left):
            first = np.ones(len(left), bool)
            first[1:] = slot[1:] != slot[:-1]
            group = np.cumsum(first) - 1
            node = left[first]
            if key_of is None:
                self.root[left] = node[group]
            else:
                keys.append(key_of[first])
                kids.append(node)
            rest = ~first
            parent = node[group[rest]]
            left = left[rest]
            key_of = parent * self.bits + self.distance(left, parent)
            order = np.argsort(key_of, kind="stable")
            left, key_of = left[order], key_of[order]
            slot = key_of
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.int64)

    def neighbours(self, radius: int):
        """Yield (query, node) arrays of pairs within the radius, following only edges |key - d| <= radius."""
        stack = [(np.arange(len(self.fp))[i : i + CHUNK], self.root[i : i + CHUNK]) for i in range(0, len(self.fp), CHUNK)]
        while stack:
            query, node = stack.pop()
            if len(query) > CHUNK:
                stack.append((query[CHUNK:], node[CHUNK:]))
                query, node = query[:CHUNK], node[:CHUNK]
            d = self.distance(query, node)
            hit = (d <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            at = node * self.bits
            low = np.searchsorted(self.keys, at + np.maximum(d - radius, 0), "left")
            width = np.searchsorted(self.keys, at + np.minimum(d + radius, self.bits - 1), "right") - low
            ends = np.cumsum(width)
            begin = 0
            while begin < len(width):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
                w = width[begin:stop]
                total = int(w.sum())
                if total:
                    step = np.arange(total) - np.repeat(np.cumsum(w) - w, w)
                    stack.append((np.repeat(query[begin:stop], w), self.kids[np.repeat(low[begin:stop], w) + step]))
                begin = stop


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest root, in place: afterwards label[a] == label[b]; label stays flat."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
