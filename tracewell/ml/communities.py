"""Louvain communities of a graph that one task holds."""

from __future__ import annotations

from collections import deque

import numpy as np

LEAST_GAIN = 1e-7  # modularity that moves made at once must gain; below it fewer nodes move
FEW = 2_000  # nodes that are moved one by one
LINKS = 1 << 20  # links that are looked at together


def summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's weights."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(w[order], first) if len(key) else w


class Level:
    """The nodes 0 to n - 1 of a level: links in both directions sorted by ``src``, and the degrees ``k``, in which what a node has merged before counts. ``least``: a gain that counts, in weight."""

    def __init__(self, src: np.ndarray, to: np.ndarray, w: np.ndarray, k: np.ndarray, twice: float, least: float):
        self.src, self.to, self.w, self.k, self.twice, self.least = src, to, w, k, twice, least
        self.n = len(k)
        self.ptr = np.searchsorted(src, np.arange(self.n + 1))
        self.label = np.arange(self.n, dtype=np.int32)
        self.count()

    def count(self) -> None:
        """Degrees and sizes of the communities."""
        self.tot, self.size = np.bincount(self.label, self.k, self.n), np.bincount(self.label, minlength=self.n)

    def modularity(self) -> float:
        """Less what no move on this level changes."""
        return self.w[self.label[self.src] == self.label[self.to]].sum() / self.twice - ((self.tot / self.twice) ** 2).sum()

    def wishes(self, looked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes looked at (a mask): those that gain by a move, and the community they want (-1: to be alone)."""
        at, parts = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while at < self.n:
            end = max(at + 1, int(np.searchsorted(self.ptr, self.ptr[at] + LINKS)))
            e = np.flatnonzero(looked[self.src[self.ptr[at] : self.ptr[min(end, self.n)]]]) + self.ptr[at]
            if len(e):
                parts.append(self.wanted(e))
            at = end
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def wanted(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wishes of the nodes whose links are ``e``."""
        key, into = summed(self.src[e].astype(np.int64) * self.n + self.label[self.to[e]], self.w[e])
        a, c = key // self.n, key % self.n
        own = c == self.label[a]
        gain = into - self.k[a] * (self.tot[c] - np.where(own, self.k[a], 0.0)) / self.twice
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        node = a[first]
        stay = -self.k[node] * (self.tot[self.label[node]] - self.k[node]) / self.twice
        stay += np.add.reduceat(np.where(own, into, 0.0), first)
        gain[own] = -np.inf
        best = np.maximum.reduceat(gain, first)
        at = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(first, len(a)))))
        want = c[at[np.unique(a[at], return_index=True)[1]]]
        want[best < 0] = -1
        wants = np.maximum(best, 0.0) > stay + self.least
        return node[wants], want[wants]

    def move(self, node: np.ndarray, want: np.ndarray) -> None:
        alone = np.flatnonzero(want < 0)
        free = np.flatnonzero(self.size == 0)[: len(alone)]
        want[alone[: len(free)]] = free
        want[alone[len(free) :]] = self.label[node[alone[len(free) :]]]
        self.label[node] = want
        self.count()

    def one_by_one(self, nodes: np.ndarray) -> None:
        """Moves of single nodes, each of which gains, until neither these nodes nor neighbours of moved ones gain."""
        todo, waits = deque(nodes.tolist()), np.zeros(self.n, bool)
        waits[nodes] = True
        spare = np.flatnonzero(self.size == 0).tolist()
        while todo:
            i = todo.popleft()
            waits[i] = False
            s = slice(self.ptr[i], self.ptr[i + 1])
            near, old, k = self.to[s], self.label[i], self.k[i]
            c, into = summed(self.label[near], self.w[s])
            gain = into - k * (self.tot[c] - np.where(c == old, k, 0.0)) / self.twice
            inside = into[c == old]
            stay = (inside[0] if len(inside) else 0.0) - k * (self.tot[old] - k) / self.twice
            gain[c == old] = -np.inf
            j = int(gain.argmax())
            if max(gain[j], 0.0) <= stay + self.least:
                continue
            new = c[j] if gain[j] >= 0 else spare.pop()
            self.label[i] = new
            self.tot[old] -= k
            self.tot[new] += k
            self.size[old] -= 1
            self.size[new] += 1
            if not self.size[old]:
                spare.append(old)
            near = near[(self.label[near] != new) & ~waits[near]]
            waits[near] = True
            todo.extend(near.tolist())

    def settled(self) -> np.ndarray:
        """Labels by which no node gains by a move. Moves are made at once, by a random half of the nodes that gain so that neighbours don't swap places, and by ever smaller parts while that doesn't raise modularity;
        the last ones are made one by one. After these all nodes are looked at again.
        """
        rng, share, top, kept = np.random.default_rng(0), 0.5, self.modularity(), self.label.copy()
        looked = np.ones(self.n, bool)
        while share > 0.05:
            node, want = self.wishes(looked)
            if len(node) <= FEW:
                break
            moves = rng.random(len(node)) < share
            looked[:] = False
            looked[node] = True
            now = node[moves]
            self.move(now, want[moves])
            hit = np.zeros(self.n, bool)
            hit[now] = True
            looked[self.to[hit[self.src]]] = True
            q = self.modularity()
            if q <= top + LEAST_GAIN:
                share /= 2
            if q > top:
                top, kept = q, self.label.copy()
        self.label = kept
        self.count()
        everywhere = np.ones(self.n, bool)
        while len(node := self.wishes(everywhere)[0]):
            self.one_by_one(node)
            self.count()
        return self.label

    def merged(self, label: np.ndarray, n: int) -> Level:
        """The level above: communities as nodes."""
        out = label[self.src] != label[self.to]
        key, w = summed(label[self.src[out]].astype(np.int64) * n + label[self.to[out]], self.w[out])
        return Level((key // n).astype(np.int32), (key % n).astype(np.int32), w, np.bincount(label, self.k, n), self.twice, self.least)


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the community of each (the smallest node in it). Each pair once; a row with ``a == b`` gives a node's degree, else that is the sum of its links.

    Levels follow each other until no communities merge; then nodes are looked at again, until none gains by a move and no communities merge.
    """
    node = np.unique(np.concatenate([a, b]))
    a, b, n = np.searchsorted(node, a), np.searchsorted(node, b), len(node)
    given = a == b
    at, degree = a[given], w[given]
    a, b, w = a[~given], b[~given], w[~given]
    key, w = summed(np.concatenate([a * n + b, b * n + a]), np.tile(w, 2))
    a, b = (key // n).astype(np.int32), (key % n).astype(np.int32)
    del key
    k = np.bincount(a, w, n)
    k[at] = degree
    twice = float(k.sum())
    base = Level(a, b, w, k, twice, 1e-9 * (float(w.mean()) if len(w) else 1.0) + 1e-15 * twice)
    found = np.arange(n)
    while len(w):
        before, level = found, base
        while True:
            names, label = np.unique(level.settled(), return_inverse=True)
            label = label.astype(np.int32)
            found = label if level is base else label[found]
            if len(names) == level.n:
                break
            level = level.merged(label, len(names))
        if np.array_equal(before, found):
            break
        base.label = found.astype(np.int32)
        base.count()
    least = np.full(n, n)
    np.minimum.at(least, found, np.arange(n))
    return node, node[least[found]]
