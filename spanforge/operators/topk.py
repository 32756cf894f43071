"""The best k of each query, kept while a task streams through its rows."""

from __future__ import annotations

import numpy as np

BUFFER = 2_000_000


class TopK:
    """Best k (score, position) of each of n queries: higher rounded score first, then the lower position.

    Entries that cannot be among the best are dropped as they come; the rest are held in a
    buffer that is cut to k a query whenever it is full, so a task holds n * k entries and a buffer.
    """

    def __init__(self, n: int, k: int, digits: int, buffer: int = BUFFER):
        self.k, self.digits, self.buffer = k, digits, max(buffer, 2 * n * k)
        self.floor = np.full(n, -np.inf)  # rounded score of the k-th best so far, or less
        self.last = np.full(n, np.iinfo(np.int64).max)  # its position: later rows of that score are not among the best
        self.parts: list[tuple] = []
        self.size = 0

    def push(self, first: int, scores: np.ndarray, positions: np.ndarray, above: float = -np.inf) -> None:
        """scores[i, j] of query first + i and the row at positions[j]; only those above count."""
        self.push_some(np.arange(first, first + len(scores)), scores, positions, above)

    def push_some(self, queries: np.ndarray, scores: np.ndarray, positions: np.ndarray, above: float = -np.inf) -> None:
        """scores[i, j] of queries[i]."""
        rounded = np.round(scores, self.digits)
        floor = self.floor[queries]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(rounded, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        r, c = np.nonzero((rounded >= floor[:, None]) & (scores > above))
        if len(r):
            self._keep(queries[r], positions[c], scores[r, c], rounded[r, c])

    def push_found(self, queries: np.ndarray, positions: np.ndarray, scores: np.ndarray) -> None:
        """Single entries; those left out are known not to be among the best."""
        self._keep(queries, positions, scores, np.round(scores, self.digits))

    def raise_floor(self, floor: np.ndarray) -> None:
        """At least k rows of each query, pushed or to be pushed, are no worse than floor."""
        up = floor > self.floor
        self.floor[up], self.last[up] = floor[up], np.iinfo(np.int64).max

    def _keep(self, q: np.ndarray, p: np.ndarray, s: np.ndarray, w: np.ndarray) -> None:
        floor = self.floor[q]
        good = (w > floor) | ((w == floor) & (p <= self.last[q]))
        if good.all():
            self.parts.append((q, p, s, w))
        else:
            self.parts.append((q[good], p[good], s[good], w[good]))
        self.size += len(self.parts[-1][0])
        if self.size > self.buffer:
            self._cut()

    def settle(self) -> None:
        """Cut what is held to k a query, so that floors are up to date."""
        if self.parts:
            self._cut()

    def _cut(self) -> None:
        q, p, s, w = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((p, -w, q))
        q, p, s, w = q[order], p[order], s[order], w[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        last = place == self.k - 1
        self.floor[q[last]], self.last[q[last]] = w[last], p[last]
        self.parts, self.size = [(q[top], p[top], s[top], w[top])], int(top.sum())

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, score) of the best."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._cut()
        return self.parts[0][:3]
