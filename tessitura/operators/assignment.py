"""Optimal assignment by shortest augmenting paths, for many square cost matrices at once: n rows in turn, at most n steps each, so
O(n^3) a matrix. Of equally good assignments the lexicographically first is given (costs that differ by less than TIE are equal)."""

from __future__ import annotations

import numpy as np

TIE = 1e-9


def _solved(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row, row prices, column prices); column 0 stands for none on the way."""
    b, n, _ = cost.shape
    u, v, row = np.zeros((b, n + 1)), np.zeros((b, n + 1)), np.zeros((b, n + 1), dtype=np.int64)
    lanes = np.arange(b)
    for i in range(1, n + 1):
        row[:, 0] = i
        at, way = np.zeros(b, dtype=np.int64), np.zeros((b, n + 1), dtype=np.int64)
        least, used = np.full((b, n + 1), np.inf), np.zeros((b, n + 1), dtype=bool)
        on = lanes
        while len(on):
            used[on, at[on]] = True
            r = row[on, at[on]]
            slack = cost[on, r - 1] - u[on, r][:, None] - v[on, 1:]
            free = ~used[on, 1:]
            better = free & (slack < least[on, 1:])
            least[on, 1:] = np.where(better, slack, least[on, 1:])
            way[on, 1:] = np.where(better, at[on][:, None], way[on, 1:])
            open_ = np.where(free, least[on, 1:], np.inf)
            to = open_.argmin(axis=1) + 1
            step = open_[np.arange(len(on)), to - 1][:, None]
            u[on[:, None], row[on]] += np.where(used[on], step, 0.0)  # rows of used columns differ; others add 0 to row 0
            v[on] -= np.where(used[on], step, 0.0)
            least[on, 1:] -= np.where(used[on, 1:], 0.0, step)
            at[on] = to
            on = on[row[on, to] != 0]
        on = lanes
        while len(on):
            back = way[on, at[on]]
            row[on, at[on]] = row[on, back]
            at[on] = back
            on = on[back != 0]
    column = np.empty((b, n), dtype=np.int64)
    column[lanes[:, None], row[:, 1:] - 1] = np.arange(n)
    return column, u[:, 1:], v[:, 1:]


def _first(tight: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The lexicographically first perfect matching in the edges `tight`, from any one."""
    n, column = len(tight), column.copy()
    for i in range(n):
        for j in np.flatnonzero(tight[i, : column[i]]).tolist():
            if j in column[:i]:
                continue
            # give j to row i, and let the row that had it find its way to the column that i leaves
            taken, start, goal = {j}, int(np.flatnonzero(column == j)[0]), int(column[i])
            path = [(start, iter(np.flatnonzero(tight[start]).tolist()))]
            came: list[int] = []
            while path and (not came or came[-1] != goal):
                to = next((c for c in path[-1][1] if c not in taken and c not in column[:i]), None)
                if to is None:
                    path.pop()
                    if came:
                        came.pop()
                    continue
                taken.add(to)
                came.append(to)
                if to != goal:
                    other = int(np.flatnonzero(column == to)[0])
                    path.append((other, iter(np.flatnonzero(tight[other]).tolist())))
            if path:
                column[i] = j
                for (r, _), c in zip(path, came, strict=True):
                    column[r] = c
                break
    return column


def assigned(cost: np.ndarray) -> np.ndarray:
    """The column of each row, of least total cost, for a stack of matrices (b, n, n) of finite numbers."""
    cost = np.asarray(cost, dtype=np.float64)
    if not cost.size:
        return np.zeros(cost.shape[:2], dtype=np.int64)
    column, u, v = _solved(cost)
    tight = cost - u[:, :, None] - v[:, None, :] <= TIE
    for k in np.flatnonzero(tight.sum(axis=(1, 2)) > cost.shape[1]):
        column[k] = _first(tight[k], column[k])
    return column


def rank(column: np.ndarray) -> int:
    """The number of a permutation in lexicographic order."""
    left, number = list(range(len(column))), 0
    for c in column.tolist():
        k = left.index(c)
        number = number * len(left) + k
        left.pop(k)
    return number
