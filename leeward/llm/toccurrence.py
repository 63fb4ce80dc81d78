"""Links between sets by T-occurrence search: short inverted lists are heap-merged, long ones are probed (DivideSkip)."""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np

MU = 0.0085            # fixed value: weight of a list's logarithm when lists are divided into long and short


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Index:
    """Inverted lists of sorted sets, none empty."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(items, kind="stable")
        self.items, self.first, counts = np.unique(items[order], return_index=True, return_counts=True)
        self.first = np.append(self.first, len(items))
        self.rows = rows[order]
        self.codes = np.empty(len(items), np.int64)                 # the item of every member, set by set
        self.codes[order] = np.repeat(np.arange(len(self.items)), counts)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def commonness(self) -> np.ndarray:
        """How many sets an average member of each set is in."""
        return np.add.reduceat(np.diff(self.first)[self.codes], self.starts[:-1]) / self.sizes

    def _lists(self, query: np.ndarray, least: int) -> tuple[np.ndarray, int, np.ndarray] | None:
        """Lists of the query's items, longest first, how many of them are long, and their lengths."""
        at = np.searchsorted(self.items, query)
        there = at < len(self.items)
        there[there] = self.items[at[there]] == query[there]
        at = at[there]
        if len(at) < least:
            return None
        lengths = self.first[at + 1] - self.first[at]
        by_length = np.argsort(-lengths, kind="stable")
        return at[by_length], min(least - 1, int(least / (MU * math.log2(lengths.max() + 1) + 1))), lengths[by_length]

    def merging(self, query: np.ndarray, num: int, den: int) -> float:
        """Steps that a search spends in the heap."""
        found = self._lists(query, max(1, -(-num * len(query) // den)))
        if found is None:
            return 0.0
        _, n_long, lengths = found
        return float(lengths[n_long:].sum() * (1 + math.log2(len(lengths) - n_long + 1)))

    def search(self, query: np.ndarray, num: int, den: int) -> list[int]:
        """Rows whose Jaccard similarity with ``query`` is at least num / den."""
        least = max(1, -(-num * len(query) // den))                 # occurrences that any partner has
        lists = self._lists(query, least)
        if lists is None:
            return []
        order, n_long, _ = lists
        short = [self.rows[self.first[i]:self.first[i + 1]].tolist() for i in order[n_long:]]
        found = [(row, sum(1 for _ in same)) for row, same in groupby(heapq.merge(*short))]
        found = [(row, n) for row, n in found if n >= least - n_long]
        if not found:
            return []
        rows, counts = np.array([r for r, _ in found]), np.array([n for _, n in found])
        for i in order[:n_long]:
            full = self.rows[self.first[i]:self.first[i + 1]]
            place = np.searchsorted(full, rows)
            counts = counts + ((place < len(full)) & (full[np.minimum(place, len(full) - 1)] == rows))
        union = self.sizes[rows] + len(query) - counts
        return rows[den * counts >= num * union].tolist()

    def shared(self, row: int) -> np.ndarray:
        """Sizes of the intersections of one of the sets with every set."""
        held = np.zeros(len(self.items), bool)
        held[self.codes[self.starts[row]:self.starts[row + 1]]] = True
        return np.add.reduceat(held[self.codes].astype(np.int64), self.starts[:-1])


HEAP_STEP = 300         # members counted in an array in the time of one step of the heap


def link_all(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all components of the sets; no link between components is missed.

    A set whose members are common is a hub: it is held against all sets at once, by counts. One minus the Jaccard similarity is a metric, so
    whatever is alike to a set in the hub's ball (alike to the hub) lies in the ball or in the ring around it (up to twice as far). A set of the ball may
    rest, then, unless it lies in the ring of a hub whose component it has not joined. Hubs are taken in order of how common their members are, so
    the middle of a group of near copies is found wherever it stands; where the lists are short enough, a set searches them by DivideSkip instead.
    """
    forest, links = Forest(len(sets)), []
    index = Index(sets)
    sizes, total = index.sizes, int(index.sizes.sum())
    resting = np.zeros(len(sets), bool)
    rings: list[tuple[int, np.ndarray]] = []                # hubs that let other sets rest, and their rings
    for i in np.argsort(-index.commonness(), kind="stable").tolist():
        if resting[i] and all(forest.find(hub) == forest.find(i) for hub, ring in rings if ring[i]):
            continue
        if index.merging(sets[i], num, den) * HEAP_STEP < total:
            for j in index.search(sets[i], num, den):
                if forest.join(i, j):
                    links.append((i, j))
            continue
        shared = index.shared(i)
        union = sizes + sizes[i] - shared
        ball = den * shared >= num * union
        # The distance (union - shared) / union is at most twice that of the ball.
        ring = ~ball & (den * (union - shared) <= 2 * (den - num) * union)
        for j in np.flatnonzero(ball).tolist():
            if forest.join(i, j):
                links.append((i, j))
        resting |= ball
        if ball.sum() > 1:
            rings.append((i, ring))
    return links
