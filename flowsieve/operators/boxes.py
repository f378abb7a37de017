"""Weighted points inside boxes, counted without looking at pairs.

Two coordinates: the points in the order of the first one, and a bit-wise partition of the second (each level tells how much weight
went to the zeros before a position), so a query takes one step a bit. Every further coordinate adds a tree of blocks
of 2^h points: a query covers at most two blocks a level, and each level is one problem with a coordinate less. Work for n points
and queries is n log n in two and n log^2 n in three dimensions, all steps over whole arrays.
"""

from __future__ import annotations

import numpy as np


def _bounds(values: np.ndarray, q: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Range in sorted distinct ``values`` of those whose difference from ``q``, as computed, is at most ``r``."""
    n = len(values)
    lo, hi = np.searchsorted(values, q - r, "left"), np.searchsorted(values, q + r, "right")
    while True:  # q - r may be rounded; the difference decides
        down = (lo > 0) & (q - values[np.maximum(lo - 1, 0)] <= r)
        up = (lo < n) & (q - values[np.minimum(lo, n - 1)] > r)
        if not (down | up).any():
            break
        lo = lo - down + (up & ~down)
    while True:
        up = (hi < n) & (values[np.minimum(hi, n - 1)] - q <= r)
        down = (hi > 0) & (values[np.maximum(hi - 1, 0)] - q > r)
        if not (down | up).any():
            break
        hi = hi + up - (down & ~up)
    return lo, hi


def _plane(first, second, weight, f_lo, f_hi, s_lo, s_hi, steps):
    """Weight of points with ``first`` in [f_lo, f_hi) and ``second`` in [s_lo, s_hi), per query."""
    order = np.argsort(first, kind="stable")
    first, row, w = first[order], second[order], weight[order]
    begin, end = np.searchsorted(first, f_lo), np.searchsorted(first, f_hi)
    n = len(f_lo)
    # the two limits of the second coordinate, as queries for the weight below a limit
    limit, left, right = np.concatenate([s_hi, s_lo]), np.tile(begin, 2), np.tile(end, 2)
    bits = int(max(int(row.max(initial=0)), int(limit.max(initial=0)))).bit_length()
    below = np.zeros(2 * n)
    for b in range(bits - 1, -1, -1):
        steps.append(len(row) + len(limit))
        zero = (row >> b) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        weights = np.concatenate([[0.0], np.cumsum(np.where(zero, w, 0.0))])
        one = (limit >> b) & 1 == 1
        below += np.where(one, weights[right] - weights[left], 0.0)
        left, right = (np.where(one, zeros[-1] + x - zeros[x], zeros[x]) for x in (left, right))
        row, w = np.concatenate([row[zero], row[~zero]]), np.concatenate([w[zero], w[~zero]])
    return below[:n] - below[n:]


def _count(points, weight, lo, hi, steps):
    """Weight of points with every coordinate in [lo, hi); lists of coordinates, a query a position of ``lo`` and ``hi``."""
    if len(points) == 1:
        steps.append(len(weight) + len(lo[0]))
        order = np.argsort(points[0], kind="stable")
        total = np.concatenate([[0.0], np.cumsum(weight[order])])
        row = points[0][order]
        return total[np.searchsorted(row, hi[0])] - total[np.searchsorted(row, lo[0])]
    if len(points) == 2:
        return _plane(points[0], points[1], weight, lo[0], hi[0], lo[1], hi[1], steps)
    order = np.argsort(points[0], kind="stable")
    first, rest, weight = points[0][order], [p[order] for p in points[1:]], weight[order]
    left, right = np.searchsorted(first, lo[0]), np.searchsorted(first, hi[0])
    out, place = np.zeros(len(left)), np.arange(len(first))
    width = int(max(rest[0].max(initial=0), hi[1].max(initial=0))) + 1
    level = 0
    while True:
        open_ = left < right
        if not open_.any():
            return out
        odd_left = open_ & (left & 1 == 1)
        odd_right = open_ & (right & 1 == 1)
        who = np.concatenate([np.flatnonzero(odd_left), np.flatnonzero(odd_right)])
        if len(who):
            block = np.concatenate([left[odd_left], right[odd_right] - 1]) * width
            inside = [(place >> level) * width + rest[0], *rest[1:]]
            less = [block + lo[1][who], *[x[who] for x in lo[2:]]]
            more = [block + hi[1][who], *[x[who] for x in hi[2:]]]
            np.add.at(out, who, _count(inside, weight, less, more, steps))
        left, right, level = (left + odd_left) >> 1, (right - odd_right) >> 1, level + 1


def within(q: np.ndarray, d: np.ndarray, r: float, weight: np.ndarray | None = None, steps: list[int] | None = None) -> np.ndarray:
    """For each row of ``q`` the weight (1 each, if not given) of the rows of ``d`` that differ by at most ``r`` in every coordinate.

    Whole weights are added exactly up to 2^53. ``steps`` collects how many array positions were touched.
    """
    if not len(q) or not len(d):
        return np.zeros(len(q))
    points, lo, hi = [], [], []
    for c in range(d.shape[1]):
        values, rank = np.unique(d[:, c], return_inverse=True)
        a, b = _bounds(values, q[:, c], r)
        points.append(rank.astype(np.int64))
        lo.append(a.astype(np.int64))
        hi.append(b.astype(np.int64))
    return _count(points, np.ones(len(d)) if weight is None else weight.astype(float), lo, hi, [] if steps is None else steps)
