"""Crossings of all segments of one tile, in numpy: the same points as ``operators.joins.crossings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

TOL = 1e-6
#: Candidate pairs looked at in one step.
STEP = 500_000

Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def _pairs(s: Ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with i < j of segments whose boxes, grown by TOL, meet; each once: in the cell of the lower left corner of the common box."""
    x1, y1, x2, y2 = s
    box = [np.minimum(x1, x2) - TOL, np.minimum(y1, y2) - TOL, np.maximum(x1, x2) + TOL, np.maximum(y1, y2) + TOL]
    size = 1.5 * max(np.mean(box[2] - box[0]), np.mean(box[3] - box[1]))
    low, high = [np.floor(b / size).astype(np.int64) for b in box[:2]], [np.floor(b / size).astype(np.int64) for b in box[2:]]
    ny = high[1] - low[1] + 1
    many = (high[0] - low[0] + 1) * ny
    at = np.repeat(np.arange(len(x1)), many)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    cx, cy = low[0][at] + nth // ny[at], low[1][at] + nth % ny[at]
    order = np.lexsort((at, cy, cx))
    at, cx, cy = at[order], cx[order], cy[order]
    new = np.flatnonzero(np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])]))
    end = np.repeat(np.append(new[1:], len(at)), np.diff(np.append(new, len(at))))
    later = end - np.arange(len(at)) - 1
    held, before = [b[at] for b in box], np.concatenate([[0], np.cumsum(later)])
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(before, before[first] + STEP, "right")) - 1)
        n = later[first:last]
        p = np.repeat(np.arange(first, last), n)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        meet = (held[0][p] <= held[2][q]) & (held[0][q] <= held[2][p]) & (held[1][p] <= held[3][q]) & (held[1][q] <= held[3][p])
        p, q = p[meet], q[meet]
        own = (np.floor(np.maximum(held[0][p], held[0][q]) / size) == cx[p]) & (np.floor(np.maximum(held[1][p], held[1][q]) / size) == cy[p])
        yield at[p[own]], at[q[own]]
        first = last


def crossings(s: Ends) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, x, y) of points that segments share, i < j, other than ends of both."""
    out: list[tuple[np.ndarray, ...]] = []
    for i, j in _pairs(s):
        a, b = [v[i] for v in s], [v[j] for v in s]
        side = lambda g, px, py: (g[2] - g[0]) * (py - g[1]) - (px - g[0]) * (g[3] - g[1])
        d = [side(b, a[0], a[1]), side(b, a[2], a[3]), side(a, b[0], b[1]), side(a, b[2], b[3])]

        def keep(hit: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            k = np.flatnonzero(hit)
            x, y = x[k], y[k]
            at_end = [
                np.logical_or(*[(np.abs(x - g[2 * e][k]) <= TOL) & (np.abs(y - g[2 * e + 1][k]) <= TOL) for e in (0, 1)]) for g in (a, b)
            ]
            k2 = ~(at_end[0] & at_end[1])
            if k2.any():
                out.append((i[k][k2], j[k][k2], rounded(x[k2]), rounded(y[k2])))

        proper = (d[0] * d[1] < 0) & (d[2] * d[3] < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = d[0] / (d[0] - d[1])
            keep(proper, a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1]))
        for n, (g, o) in enumerate(((b, a), (b, a), (a, b), (a, b))):
            x, y = o[2 * (n % 2)], o[2 * (n % 2) + 1]
            near = d[n] * d[n] <= TOL * TOL * ((g[2] - g[0]) ** 2 + (g[3] - g[1]) ** 2)
            near &= (x >= np.minimum(g[0], g[2]) - TOL) & (x <= np.maximum(g[0], g[2]) + TOL)
            keep(near & (y >= np.minimum(g[1], g[3]) - TOL) & (y <= np.maximum(g[1], g[3]) + TOL), x, y)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
    i, j, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
    once = _once(i, j, x, y)
    return i[once], j[once], x[once], y[once]


def _once(*keys: np.ndarray) -> np.ndarray:
    """Places of distinct rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]


def split(s: Ends, line: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[Ends, np.ndarray]:
    """(pieces, the segment that each was cut from): segments cut at points of their own, in order along each."""
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x - x1[line]) * dx[line] + (y - y1[line]) * dy[line]) / (dx * dx + dy * dy)[line]
    k = np.flatnonzero((t > TOL) & (t < 1 - TOL))
    line, x, y, t = line[k], x[k], y[k], t[k]
    k = _once(line, t, x, y)  # points of one place have one parameter
    n = len(x1)
    own = np.concatenate([np.arange(n), line[k], np.arange(n)])
    order = np.lexsort((np.concatenate([np.zeros(n), t[k], np.ones(n)]), own))
    own, px, py = own[order], np.concatenate([x1, x[k], x2])[order], np.concatenate([y1, y[k], y2])[order]
    last = np.append(own[1:] != own[:-1], True)
    p = np.flatnonzero(~last)
    return (px[p], py[p], px[p + 1], py[p + 1]), own[p]


def rounds(s: Ends, owned: np.ndarray, most: int) -> tuple[list[int], list[np.ndarray]]:
    """Crossings of each of ``most`` rounds and pieces of each segment before it; a crossing counts if the first of its two segments is owned."""
    met, pieces, of = [], [], np.arange(len(owned))
    while len(met) < most:
        i, j, x, y = crossings(s)
        met.append(int(owned[of[i]].sum()))
        pieces.append(np.bincount(of, minlength=len(owned)))
        now, own = split(s, np.concatenate([i, j]), np.concatenate([x, x]), np.concatenate([y, y]))
        if len(own) == len(of):  # nothing was cut, so later rounds are as this one
            return met + [met[-1]] * (most - len(met)), pieces + [pieces[-1]] * (most - len(pieces))
        s, of = now, of[own]
    return met, pieces
