"""Cutting stock by column generation: a revised simplex over patterns of length classes, priced by a knapsack programme."""

from __future__ import annotations

import numpy as np


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, and how often it takes each. By dynamic programming over capacities."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    use = np.flatnonzero(values > 1e-12)
    use = use[np.argsort(sizes[use], kind="stable")]
    v, s = values[use], sizes[use]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            gain = best[c - s[:n]] + v[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-15:
                best[c], took[c] = gain[k], use[k]
    counts = np.zeros(len(values))
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), counts


def relax(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in an optimum, within `gap`, of the linear programme
    min sum(x) with patterns' x covering the demand."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    is_pattern = np.ones(m, bool)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    centre = np.minimum(sizes / capacity, 1.0)  # dual values that never overrate a pattern; pricing leans towards the best such found
    bound = float(centre @ demand)
    for step in range(1, 40 * m + 1):
        cost = is_pattern.astype(float)
        dual = cost @ inverse
        low = int(dual.argmin())
        value, column = 0.0, np.zeros(m)
        for lean in (0.7, 0.0):
            price = lean * centre + (1 - lean) * np.maximum(dual, 0)
            value, column = knapsack(price, sizes, capacity)
            if float(price @ demand) / max(value, 1.0) > bound:
                centre, bound = price / max(value, 1.0), float(price @ demand) / max(value, 1.0)
            if float(dual @ column) > 1 + 1e-9:
                break
        if dual[low] < -1e-9:  # a surplus enters
            column, entering = np.zeros(m), False
            column[low] = -1
        else:
            total = float(cost @ x)
            if float(dual @ column) <= 1 + 1e-9 or total - bound <= gap * total:
                break
            entering = True
        move = inverse @ column
        limit = np.full(m, np.inf)
        up = move > 1e-10
        if not up.any():
            break
        limit[up] = x[up] / move[up]
        leave = int(limit.argmin())
        basis[:, leave], is_pattern[leave] = column, entering
        if step % 150:
            row = inverse[leave] / move[leave]
            inverse = inverse - np.outer(move, row)
            inverse[leave] = row
        else:
            inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ demand, 0) if step % 150 == 0 else np.maximum(x - move * limit[leave], 0)
        if step % 150:
            x[leave] = limit[leave]
    keep = is_pattern & (x > 1e-9)
    return basis[:, keep].T.astype(np.int64), x[keep]


def fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for what rounding leaves: the largest piece, then the subset of the others that fills the rest best."""
    left, out = left.copy(), []
    while left.any():
        pattern = np.zeros(len(sizes), np.int64)
        first = int(np.flatnonzero(left)[sizes[np.flatnonzero(left)].argmax()])
        pattern[first], room = 1, capacity - int(sizes[first])
        left[first] -= 1
        items = [i for i in np.argsort(-sizes, kind="stable").tolist() for _ in range(min(int(left[i]), room // int(sizes[i]))) if sizes[i] <= room]
        reach, steps, full = 1, [], (1 << (room + 1)) - 1
        for i in items:
            steps.append(reach)
            reach |= (reach << int(sizes[i])) & full
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        for i, before in zip(reversed(items[: len(steps)]), reversed(steps), strict=True):
            if not before >> at & 1:
                pattern[i] += 1
                left[i] -= 1
                at -= int(sizes[i])
        out.append(pattern)
    return out


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and whole numbers of uses that cover the demand of every class."""
    if not len(sizes):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, x = relax(sizes, demand.astype(float), capacity)
    uses = np.floor(x + 1e-7).astype(np.int64)
    patterns, uses = patterns[uses > 0], uses[uses > 0]
    left = np.maximum(demand - (patterns * uses[:, None]).sum(0), 0)
    rest = fill(sizes, left, capacity)
    if rest:
        patterns = np.concatenate([patterns.reshape(-1, len(sizes)), rest])
        uses = np.concatenate([uses, np.ones(len(rest), np.int64)])
    return patterns, uses
