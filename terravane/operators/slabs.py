"""The slabs of ``overlay`` for groups of few edges: all groups of an Arrow batch at once in numpy, a group never leaving its row.

The steps and the roundings are those of ``overlay.pieces``, which takes the groups of many edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs of edges, or of edges and slabs, that are held at a time.
PAIRS = 1 << 19
FIELDS = ("lo", "hi", "l_lo", "l_hi", "r_lo", "r_hi")
FOUND = f"array<struct<{','.join(f'{k}:double' for k in FIELDS)}>>"


def _levels(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    return np.repeat(np.arange(len(a)), a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), a.flatten()


def _edges(column: pa.Array, side: int) -> tuple[np.ndarray, ...]:
    """(row, side, part, x0, y0, x1, y1) of the edges of a column of parts that are not level, from their lower end up."""
    row, rings = _levels(column)
    part = np.arange(len(rings))
    of_ring, ring = _levels(rings)
    of_point, points = _levels(ring)
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    at = np.flatnonzero(of_point[1:] == of_point[:-1])
    at = at[y[at] != y[at + 1]]
    up = y[at] < y[at + 1]
    low, high = np.where(up, at, at + 1), np.where(up, at + 1, at)
    owner = of_ring[of_point[at]]
    return row[owner], np.full(len(at), side), part[owner], x[low], y[low], x[high], y[high]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each of rows in order differs from the one before in any key."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _products(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within groups of n and m rows that lie one group after the other."""
    a = np.repeat(np.arange(n.sum()), np.repeat(m, n))
    k = np.repeat(np.cumsum(n * m) - n * m, n * m)
    first = np.repeat(np.cumsum(m) - m, n * m)
    return a, first + (np.arange(len(a)) - k) % np.maximum(np.repeat(m, n * m), 1)


def trapezoids(g: np.ndarray, side: np.ndarray, part: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, inside: Callable, thin: float) -> tuple[np.ndarray, ...]:
    """(g, lo, hi, l_lo, l_hi, r_lo, r_hi) of groups 0, 1, 2 and so on, each of which has edges."""
    order = np.lexsort((y1, x1, y0, x0, g))
    g, side, part, x0, y0, x1, y1 = (v[order] for v in (g, side, part, x0, y0, x1, y1))
    line = np.cumsum(_starts(g, x0, y0, x1, y1))
    n = np.bincount(g)
    slight = lambda a, b: thin * np.maximum(np.abs(a), np.abs(b))
    # Heights at which two edges cross within their spans.
    a, b = _products(n, n)
    near = (line[a] < line[b]) & (np.maximum(y0[a], y0[b]) < np.minimum(y1[a], y1[b])) & (np.maximum(x0[a], x1[a]) >= np.minimum(x0[b], x1[b])) & (np.maximum(x0[b], x1[b]) >= np.minimum(x0[a], x1[a]))
    a, b = a[near], b[near]
    slope = (x1 - x0) / (y1 - y0)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (x0[b] - x0[a] + slope[a] * y0[a] - slope[b] * y0[b]) / (slope[a] - slope[b])
    met = (y > np.maximum(y0[a], y0[b])) & (y < np.minimum(y1[a], y1[b]))
    hg, h = np.concatenate([g, g, g[a[met]]]), np.concatenate([y0, y1, y[met]])
    order = np.lexsort((h, hg))
    hg, h = hg[order], h[order]
    keep = _starts(hg, h)
    hg, h = hg[keep], h[keep]
    # Heights that differ by rounding are one, the lowest of them.
    keep = _starts(hg)
    keep[1:] |= h[1:] - h[:-1] > slight(h[1:], h[:-1])
    hg, h = hg[keep], h[keep]
    both = np.flatnonzero(~_starts(hg)[1:])
    sg, lo, hi = hg[both], h[both], h[both + 1]
    e, s = _products(n, np.bincount(sg, minlength=len(n)))
    over = (y0[e] <= lo[s] + slight(lo[s], hi[s])) & (y1[e] >= hi[s])
    e, s = e[over], s[over]

    def at(y: np.ndarray) -> np.ndarray:
        x = x0[e] + (x1[e] - x0[e]) * ((y - y0[e]) / (y1[e] - y0[e]))
        return np.where(y == y0[e], x0[e], np.where(y == y1[e], x1[e], x))

    mid = at((lo[s] + hi[s]) / 2)
    # The first, third and so on of a part's edges enter it.
    order = np.lexsort((line[e], mid, part[e], side[e], s))
    new = _starts(s[order], side[e][order], part[e][order])
    place = np.arange(len(order))
    enter = np.empty(len(order), np.int64)
    enter[order] = np.where((place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0, 1, -1)
    order = np.lexsort((line[e], part[e], side[e], -enter, mid, s))
    e, s, mid, enter = e[order], s[order], mid[order], enter[order]
    first = _starts(s)
    last = np.append(first[1:], True)[: len(first)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))

    def count(k: int) -> np.ndarray:
        step = np.where(side[e] == k, enter, 0)
        total = np.cumsum(step)
        return total - (total - step)[start]

    within = inside(count(0), count(1))
    # A gap of no width, between sides that differ by rounding, is none.
    following = np.append(mid[1:], np.nan)[: len(mid)]
    within = within | (~last & np.append(within[1:], False)[: len(within)] & (following - mid <= slight(mid, following)))
    turn = within != np.where(first, False, np.append(False, within[:-1])[: len(within)])
    e, s, mid, within = e[turn], s[turn], mid[turn], within[turn]
    left = np.flatnonzero(within[:-1] & (s[1:] == s[:-1]))
    left = left[mid[left + 1] - mid[left] > slight(mid[left], mid[left + 1])]
    s, el, er = s[left], e[left], e[left + 1]
    lo, hi = lo[s], hi[s]
    ends = []
    for e in (el, er):
        ends += [at(lo), at(hi)]
    # Trapezoids between the same two edges, one above the other, are one.
    order = np.lexsort((lo, line[er], line[el], g[el]))
    gl, ll, lr, lo, hi, l_lo, l_hi, r_lo, r_hi = (v[order] for v in (g[el], line[el], line[er], lo, hi, *ends))
    new = _starts(gl, ll, lr)
    new[1:] |= hi[:-1] != lo[1:]
    low, high = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(new)])
    return gl[low], lo[low], hi[high], l_lo[low], l_hi[high], r_lo[low], r_hi[high]


def found_in(group: list[str], inside: Callable, thin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (group, found) of the rows (group, mine, other) that have trapezoids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, side, part, *ends = (np.concatenate(v) for v in zip(_edges(batch.column("mine"), 0), _edges(batch.column("other"), 1)))
            order = np.argsort(g, kind="stable")
            g, side, part, *ends = (v[order] for v in (g, side, part, *ends))
            rows, n = np.unique(g, return_counts=True)
            bounds = np.append(np.cumsum(n) - n, len(g))
            # As many groups at a time as have so many pairs of edges, at least one.
            begin, total = 0, np.cumsum(n * n)
            while begin < len(rows):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, side="right")))
                span = slice(bounds[begin], bounds[end])
                dense = np.repeat(np.arange(end - begin), n[begin:end])
                of, *values = trapezoids(dense, side[span], part[span], *(v[span] for v in ends), inside, thin)
                held, size = np.unique(of, return_counts=True)
                if len(held):
                    out = batch.select(group).take(pa.array(rows[begin:end][held]))
                    structs = pa.StructArray.from_arrays([pa.array(v) for v in values], names=list(FIELDS))
                    offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.ListArray.from_arrays(offsets, structs)], names=[*group, "found"])
                begin = end

    return run
