"""Arrangements of many shapes of few segments at once, in arrays: what ``arrangement`` does by joins, for shapes that a task holds.

Spark deals the shapes to tasks; here are the steps for a block of them. A block is bounded by the pairs of segments
that its shapes have, and shapes of many segments don't come here. ``shape`` is a number of the block, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs of segments that are looked at at once.
PAIRS = 1 << 20
TINY = 1e-6

Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _each(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each span, as often as it is long, and the places in it."""
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, np.arange(len(owner)) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _blocks(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of rows of at most PAIRS of ``work`` together, or of one row."""
    done, low = np.cumsum(work), 0
    while low < len(work):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, "right")))
        yield low, high
        low = high


def _rounded(v: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero; larger numbers than 4e9 have no more."""
    return np.where(np.abs(v) < 4e9, np.copysign(np.floor(np.abs(v) * 1e6 + 0.5) / 1e6, v), v) + 0.0


def split(shape: np.ndarray, side: np.ndarray, ends: Ends) -> tuple[np.ndarray, np.ndarray, Ends]:
    """Segments cut where they meet, by the rules of ``arrangement.split_within``."""
    ax, ay, bx, by = ends
    every = np.arange(len(shape))
    p, q = _each(every + 1, np.searchsorted(shape, shape, "right") - every - 1)
    x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    meet = (x0[p] <= x1[q]) & (x0[q] <= x1[p]) & (y0[p] <= y1[q]) & (y0[q] <= y1[p])
    p, q = p[meet], q[meet]
    stops = [(every, np.zeros(len(shape)), ax, ay), (every, np.ones(len(shape)), bx, by)]
    touch = np.zeros(len(p), bool)
    for s, o in ((p, q), (q, p)):
        dx, dy = bx[s] - ax[s], by[s] - ay[s]
        length = dx * dx + dy * dy
        for x, y in ((ax[o], ay[o]), (bx[o], by[o])):
            t = ((x - ax[s]) * dx + (y - ay[s]) * dy) / length
            off = np.abs((x - ax[s]) * dy - (y - ay[s]) * dx) / np.sqrt(length)
            own = ((x == ax[s]) & (y == ay[s])) | ((x == bx[s]) & (y == by[s]))
            cut = (t > 0) & (t < 1) & (off <= TINY) & ~own
            touch |= cut
            stops.append((s[cut], t[cut], x[cut], y[cut]))
    rx, ry, sx, sy = bx[p] - ax[p], by[p] - ay[p], bx[q] - ax[q], by[q] - ay[q]
    qx, qy = ax[q] - ax[p], ay[q] - ay[p]
    d = rx * sy - ry * sx
    t, u = (qx * sy - qy * sx) / d, (qx * ry - qy * rx) / d
    inner = (t > 0) & (t < 1) & (u > 0) & (u < 1) & ~touch
    x, y = _rounded((ax[p] + t * rx)[inner]), _rounded((ay[p] + t * ry)[inner])
    stops += [(p[inner], t[inner], x, y), (q[inner], u[inner], x, y)]
    seg, t, x, y = map(np.concatenate, zip(*stops, strict=True))
    order = np.lexsort((y, x, t, seg))
    seg, x, y = seg[order], x[order], y[order]
    piece = np.flatnonzero((seg[:-1] == seg[1:]) & ((x[:-1] != x[1:]) | (y[:-1] != y[1:])))
    return shape[seg[piece]], side[seg[piece]], (x[piece], y[piece], x[piece + 1], y[piece + 1])


def wound(shape: np.ndarray, side: np.ndarray, ends: Ends, sides: int) -> tuple[np.ndarray, Ends, np.ndarray, np.ndarray]:
    """Pieces once each, from left to right, and their winding numbers ``left[k], right[k]``, as ``arrangement.sided_pieces``."""
    ax, ay, bx, by = ends
    forth = (ax < bx) | ((ax == bx) & (ay < by))
    way = [np.where(forth, a, b) for a, b in ((ax, bx), (ay, by), (bx, ax), (by, ay))]
    order = np.lexsort((*reversed(way), shape))
    shape, side, once, (ax, ay, bx, by) = shape[order], side[order], np.where(forth, 1, -1)[order], (c[order] for c in way)
    first = np.flatnonzero(_changes(shape, ax, ay, bx, by))
    net = np.stack([np.add.reduceat(np.where(side == k, once, 0), first) for k in range(sides)])
    kept = net.any(axis=0)
    shape, ax, ay, bx, by = (c[first[kept]] for c in (shape, ax, ay, bx, by))
    net = net[:, kept]
    start = np.searchsorted(shape, shape, "left")
    size = np.searchsorted(shape, shape, "right") - start
    mx, my, near = (ax + bx) / 2, (ay + by) / 2, np.zeros_like(net)
    for low, high in _blocks(size):
        own, over = _each(start[low:high], size[low:high])
        own += low
        above = (ax[over] <= mx[own]) & (mx[own] < bx[over]) & (own != over)
        own, over = own[above], over[above]
        above = ay[over] + (mx[own] - ax[over]) / (bx[over] - ax[over]) * (by[over] - ay[over]) > my[own]
        own, over = own[above] - low, over[above]
        for k in range(sides):
            near[k, low:high] = -np.bincount(own, net[k, over], high - low)
    upright = ax == bx
    return shape, (ax, ay, bx, by), np.where(upright, near + net, near), np.where(upright, near, near - net)


def _places(follow: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest link of each link's ring, which is its first, and the steps to its last one."""
    low, ptr = np.arange(len(follow)), follow
    for _ in range(longest.bit_length()):
        low, ptr = np.minimum(low, low[ptr]), ptr[ptr]
    ptr = np.where(follow == low, np.arange(len(follow)), follow)
    steps = (follow != low).astype(np.int64)
    for _ in range(longest.bit_length()):
        steps, ptr = steps + steps[ptr], ptr[ptr]
    return low, steps


def _followers(shape: np.ndarray, ends: Ends) -> np.ndarray:
    """Around every vertex an edge that comes in goes on with the first one clockwise from it."""
    ax, ay, bx, by = ends
    n = len(shape)
    vertex = np.concatenate([shape, shape]), np.concatenate([ax, bx]), np.concatenate([ay, by])
    turn = np.concatenate([np.arctan2(by - ay, bx - ax), np.arctan2(ay - by, ax - bx)])
    comes = np.arange(2 * n) >= n
    order = np.lexsort((comes, turn, *reversed(vertex)))
    first = np.flatnonzero(_changes(*(v[order] for v in vertex)))
    size = np.diff(first, append=2 * n)
    link, comes, at = order % n, comes[order], np.arange(2 * n)
    before = np.maximum.accumulate(np.where(comes, -1, at))
    last = np.repeat(before[first + size - 1], size)
    begin = np.repeat(first, size)
    then = np.where(before >= begin, before, last)
    follow = np.empty(n, np.int64)
    follow[link[comes]] = np.where(last >= begin, link[then], link)[comes]
    return follow


def _parted(follow: np.ndarray, ring: np.ndarray, ends: Ends) -> np.ndarray:
    """``follow``, so that no ring passes a vertex twice: there each edge that comes in goes on where the next one does."""
    ax, ay, bx, by = ends
    order = np.lexsort((np.arctan2(ay - by, ax - bx), by, bx, ring))
    first = np.flatnonzero(_changes(ring[order], bx[order], by[order]))
    size = np.diff(first, append=len(order))
    after = np.arange(len(order)) + 1
    after[first + size - 1] = first
    parted = follow.copy()
    parted[order] = follow[order[after]]
    return parted


def _holders(shape: np.ndarray, ends: Ends, ring: np.ndarray, area: np.ndarray) -> np.ndarray:
    """The shell of every ring, by number: for a hole the smallest one of its shape around the middle of its first edge."""
    x, y, u, v = ends
    part = np.arange(len(area))
    holes = np.unique(ring[area[ring] < 0])
    start = np.searchsorted(shape, shape[holes], "left")
    size = np.searchsorted(shape, shape[holes], "right") - start
    for low, high in _blocks(size):
        own, edge = _each(start[low:high], size[low:high])
        shell = area[ring[edge]] > 0
        own, edge = holes[low:high][own[shell]], edge[shell]
        px, py = (x[own] + u[own]) / 2, (y[own] + v[own]) / 2
        crossed = ((y[edge] > py) != (v[edge] > py)) & (px < x[edge] + (py - y[edge]) * (u[edge] - x[edge]) / (v[edge] - y[edge]))
        back = (x[edge] == u[own]) & (y[edge] == v[own]) & (u[edge] == x[own]) & (v[edge] == y[own])
        pair, at = np.unique(np.stack([own, ring[edge]]), axis=1, return_inverse=True)
        around = (np.bincount(at.ravel(), crossed, pair.shape[1]) % 2 == 1) & (np.bincount(at.ravel(), back, pair.shape[1]) == 0)
        hole, shell = pair[:, around]
        order = np.lexsort((shell, area[shell], hole))
        best = order[_changes(hole[order])]
        part[hole[best]] = shell[best]
    return part


def polygons(shape: np.ndarray, ends: Ends, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``shape, part, rings, area, perimeter`` of pieces and whether the result lies on their left and right."""
    edge = left != right
    shape, left = shape[edge], left[edge]
    ax, ay, bx, by = (c[edge] for c in ends)
    ends = x, y, u, v = tuple(np.where(left, a, b) for a, b in ((ax, bx), (ay, by), (bx, ax), (by, ay)))
    longest = int(np.bincount(shape).max()) if len(shape) else 0
    follow = _followers(shape, ends)
    ring, _ = _places(follow, longest)
    ring, steps = _places(_parted(follow, ring, ends), longest)
    area = np.bincount(ring, (x - u) * (y + v), len(ring)) / 2
    part = _holders(shape, ends, ring, area)
    order = np.lexsort((-steps, ring, ring != part[ring], part[ring]))
    order = order[area[ring[order]] != 0]
    ring, length = ring[order], np.hypot(u - x, v - y)[order]
    rings = np.flatnonzero(_changes(ring))
    parts = np.flatnonzero(_changes(part[ring[rings]]))
    points = pa.StructArray.from_arrays([pa.array(x[order]), pa.array(y[order])], ["x", "y"])
    offsets = lambda starts, end: pa.array(np.append(starts, end).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets(parts, len(rings)), pa.ListArray.from_arrays(offsets(rings, len(order)), points))
    held = part[ring[rings[parts]]]
    if not len(parts):
        return held, held, lists, np.empty(0), np.empty(0)
    return shape[held], held, lists, np.add.reduceat(area[ring[rings]], parts), np.add.reduceat(length, rings[parts])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Ends]]:
    """Blocks of whole shapes of batches in which a shape's segments follow one another: shapes by number, their ids, sides and ends."""
    rest: list[np.ndarray] | None = None

    def blocks(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Ends]]:
        first = np.flatnonzero(_changes(columns[0]))
        size = np.diff(first, append=len(columns[0]))
        for low, high in _blocks(size * size):
            own = slice(first[low], first[high - 1] + size[high - 1])
            yield np.repeat(np.arange(high - low), size[low:high]), columns[0][first[low:high]], columns[1][own], tuple(c[own] for c in columns[2:])

    for batch in batches:
        if batch.num_rows:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = columns if rest is None else [np.concatenate([a, b]) for a, b in zip(rest, columns, strict=True)]
            cut = int(np.flatnonzero(_changes(columns[0]))[-1])  # the last shape may go on in the next batch
            rest = [c[cut:] for c in columns]
            yield from blocks([c[:cut] for c in columns])
    if rest is not None:
        yield from blocks(rest)


PIECES = "shape long, side int, ax double, ay double, bx double, by double"
POLYGONS = "shape long, which int, part long, rings array<array<struct<x:double,y:double>>>, area double, perimeter double"


def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``shape, side, ax, ay, bx, by`` to those of their pieces."""
    with np.errstate(all="ignore"):
        for shape, ids, side, ends in _shapes(batches):
            at, of, cut = split(shape, side, ends)
            yield pa.record_batch([pa.array(ids[at]), pa.array(of.astype(np.int32)), *map(pa.array, cut)], names=["shape", "side", "ax", "ay", "bx", "by"])


def polygon_batches(insides: list[Callable], sides: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of segments to those of polygons, ``which`` being the number of the condition that they are inside of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for shape, ids, side, ends in _shapes(batches):
                own, pieces, left, right = wound(*split(shape, side, ends), sides)
                for which, inside in enumerate(insides):
                    at, part, rings, area, perimeter = polygons(own, pieces, inside(*left), inside(*right))
                    columns = [pa.array(ids[at]), pa.array(np.full(len(at), which, np.int32)), pa.array(part), rings, pa.array(area), pa.array(perimeter)]
                    yield pa.record_batch(columns, names=["shape", "which", "part", "rings", "area", "perimeter"])

    return run
