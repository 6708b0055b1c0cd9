"""Best-fit decreasing: a segment tree indexed by remaining capacity finds the tightest open window."""

from __future__ import annotations

import numpy as np


class OpenWindows:
    """Open windows by remaining capacity; finds the least remaining capacity that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, window: int) -> None:
        if remaining == 0:
            return
        self.windows[remaining].append(window)
        node = remaining + self.leaves
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of a tightest window with at least ``need`` left, and removes it."""
        filled, node = self.filled, need + self.leaves
        while not filled[node]:
            while node & 1:  # a right child: everything below its parent is smaller or empty
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if filled[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        window = self.windows[remaining].pop()
        if not self.windows[remaining]:
            filled[node] = 0
            while node > 1 and not filled[node ^ 1]:
                node >>= 1
                filled[node] = 0
        return remaining, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of each piece; pieces are 1 to ``capacity`` long, equal ones go in their given order."""
    window = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    open_windows, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_windows.take(need)
        if found is None:
            found = capacity, made
            made += 1
        left, window[i] = found
        offset[i] = capacity - left
        open_windows.put(left - need, found[1])
    return window, offset


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest; no piece for nothing."""
    return [(start, min(capacity, n - start)) for start in range(0, n, capacity)]
