"""Dual-tree search for inner products: ball trees, intervals of node pairs, and exact scores of leaf pairs.

A tree's rows are reordered so that each node is a run of them. For a node of anchors with centre a and radius r and a node of
candidates with centre c and radius s, all inner products lie within a.c +- (r|c| + s|a| + rs): a pair of nodes whose interval holds
nothing of use is dropped, with all its anchors at once. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

LOWEST = -(1 << 63) + 1
HIGHEST = (1 << 63) - 1
#: Types of a tree's nodes.
TYPES = (np.int64, np.int64, np.int64, np.float64, np.float64, np.int64, np.int64)
#: Whole numbers up to here are exact as doubles.
_EXACT = 1 << 53


class Tree:
    """Nodes: ``starts`` to ``ends`` of the rows, ``kids`` (two nodes, or -1), centres and radii; ``low`` and ``high`` are the least and
    greatest label below. ``load()`` gives what leaves hold, in the tree's order, when a leaf is first reached: vectors of whole
    numbers as ``rows``, their ``labels``, ``ids``, and ``no_id`` where these are null."""

    def __init__(self, nodes: tuple[np.ndarray, ...], load: Callable[[], tuple[np.ndarray, ...]]):
        self.nodes, self.load = nodes, load
        self.starts, self.ends, self.kids, self.centers, self.radii, self.low, self.high = nodes
        self.norms = np.sqrt((self.centers**2).sum(1))

    @cached_property
    def held(self) -> tuple[np.ndarray, ...]:
        return self.load()

    rows, labels, ids, no_id = (property(lambda self, i=i: self.held[i]) for i in range(4))

    @cached_property
    def largest(self) -> float:
        return float(np.abs(self.rows.astype(np.float64)).max(initial=0.0))


def build(rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, no_id: np.ndarray, leaf_rows: int) -> Tree:
    """A tree over at least one row. A node is split between two far rows, in halves where too few are nearer to one of them."""
    order, nodes, todo = np.arange(len(rows)), [], [(0, len(rows), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = order[start:end]
        x = rows[own].astype(np.float64)
        center = x.mean(0)
        apart = np.sqrt(((x - center) ** 2).sum(1))
        node = [start, end, [-1, -1], center, apart.max(initial=0.0), labels[own].min(), labels[own].max()]
        if parent >= 0:
            nodes[parent][2][side] = len(nodes)
        nodes.append(node)
        if end - start > leaf_rows:
            far = x[apart.argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            along = (x - (far + other) / 2) @ (other - far)
            order[start:end] = own[np.argsort(along, kind="stable")]
            middle = start + int((along < 0).sum())  # rows nearer to the one than to the other
            if min(middle - start, end - middle) < max(1, leaf_rows // 8):
                middle = (start + end) // 2
            todo += [(middle, end, len(nodes) - 1, 1), (start, middle, len(nodes) - 1, 0)]
    column = lambda i, kind: np.array([n[i] for n in nodes], kind)
    held = rows[order], labels[order], ids[order], no_id[order]
    return Tree(tuple(map(column, range(7), TYPES)), lambda: held)


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``; beyond a long's range, its ends. ``largest``: of two components' product."""
    if largest * a.shape[1] < _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LOWEST, HIGHEST).astype(np.int64)


def search(a: Tree, b: Tree, useful: Callable[[int, int, float, float], bool], score: Callable[[slice, slice, np.ndarray], None]) -> tuple[int, int]:
    """Visits pairs of nodes of ``a`` and ``b`` from the roots down. ``useful`` says for a pair and the interval of its inner products
    whether any could be of use; ``score`` gets the rows of leaf pairs and their inner products. Returns scored and all pairs of rows."""
    done, todo = 0, [(0, 0)]
    while todo:
        i, j = todo.pop()
        middle = float(a.centers[i] @ b.centers[j])
        reach_a, reach_b = a.norms[i] + a.radii[i], b.norms[j] + b.radii[j]
        # Rounding of the interval's ends is far below the slack.
        spread = a.radii[i] * b.norms[j] + b.radii[j] * reach_a + 1e-9 * reach_a * reach_b + 1
        if not useful(i, j, min(middle - spread, float(HIGHEST)), max(middle + spread, float(LOWEST))):
            continue
        (left, right), (lower, upper) = a.kids[i], b.kids[j]
        if left < 0 and lower < 0:
            at, of = slice(a.starts[i], a.ends[i]), slice(b.starts[j], b.ends[j])
            score(at, of, products(a.rows[at], b.rows[of], a.largest * b.largest))
            done += (at.stop - at.start) * (of.stop - of.start)
        elif lower < 0 or left >= 0 and a.radii[i] >= b.radii[j]:
            todo += [(left, j), (right, j)]
        else:  # the nearer half comes first, which raises what later pairs must reach
            near = [(float(a.centers[i] @ b.centers[k]), k) for k in (lower, upper)]
            todo += [(i, k) for _, k in sorted(near)]
    return done, int(a.ends[0] * b.ends[0])


class Best:
    """The first ``k`` hits of each group by (score down, identifier up, null identifiers last). ``least`` is the score that a hit must
    reach to matter; it starts as given and rises. Hits have a ``mark`` that comes along."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.parts, self.waiting = least.astype(np.int64), k, [], 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, mark: np.ndarray) -> None:
        if len(group):
            self.parts.append((group, score.astype(np.int64), ids, no_id, mark))
            self.waiting += len(group)
            if self.waiting > 4 * self.k * len(self.least) + 2_000:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """What is left, sorted by group and place."""
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool))
        cols = [np.concatenate(c) for c in zip(empty, *self.parts, strict=True)]
        order = np.lexsort((cols[2], cols[3], -cols[1], cols[0]))
        cols = [c[order] for c in cols]
        place = np.arange(len(order)) - np.searchsorted(cols[0], cols[0])
        last = place == self.k - 1
        self.least[cols[0][last]] = np.maximum(self.least[cols[0][last]], cols[1][last])
        cols = [c[place < self.k] for c in cols]
        self.parts, self.waiting = [tuple(cols)], 0
        return tuple(cols)


class Positives:
    """The first ``k`` rows of an anchor's label, the anchor itself among them where it scores so high. Groups are anchors' places."""

    def __init__(self, a: Tree, k: int):
        self.a, self.best = a, Best(np.full(a.ends[0], LOWEST), k)

    def visit(self, b: Tree) -> tuple[int, int]:
        a, best = self.a, self.best

        def useful(i, j, low, high):
            return a.low[i] <= b.high[j] and b.low[j] <= a.high[i] and high >= best.least[a.starts[i] : a.ends[i]].min()

        def score(at, of, s):
            r, c = np.nonzero((a.labels[at, None] == b.labels[of]) & (s >= best.least[at, None]))
            value, r, c = s[r, c], r + at.start, c + of.start
            own = (b.ids[c] == a.ids[r]) & (b.no_id[c] == a.no_id[r])
            for i in np.flatnonzero(own):
                own[i] = np.array_equal(a.rows[r[i]], b.rows[c[i]])
            best.add(r, value, b.ids[c], b.no_id[c], own)

        return search(a, b, useful, score)


class Negatives:
    """The first ``k`` rows of other labels whose score lies between a positive's ``least`` and its ``most``, tables of a row for each anchor and
    a column for each positive. Groups are their places in these tables."""

    def __init__(self, a: Tree, least: np.ndarray, most: np.ndarray, k: int):
        self.a, self.most, self.best = a, most, Best(least.ravel(), k)

    def visit(self, b: Tree) -> tuple[int, int]:
        a, best, most = self.a, self.best, self.most
        n = most.shape[1]

        def useful(i, j, low, high):
            if a.low[i] == a.high[i] == b.low[j] == b.high[j]:
                return False
            start, end = a.starts[i], a.ends[i]
            return high >= best.least[start * n : end * n].min() and low <= most[start:end].max()

        def score(at, of, s):
            least = best.least.reshape(most.shape)
            inside = (s >= least[at].min(1)[:, None]) & (s <= most[at].max(1)[:, None])
            r, c = np.nonzero(inside & (a.labels[at, None] != b.labels[of]))
            value, r, c = s[r, c], r + at.start, c + of.start
            for nth in range(n):
                fits = (value >= least[r, nth]) & (value <= most[r, nth])
                best.add(r[fits] * n + nth, value[fits], b.ids[c[fits]], b.no_id[c[fits]], np.zeros(fits.sum(), bool))

        return search(a, b, useful, score)
