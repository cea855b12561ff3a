"""Array arithmetic of whole batches of frames: gathering atoms, backbone geometry, neighbours, covered sphere points.

Every function takes flat numpy arrays in which a point knows its frame, so that one call serves all frames of an Arrow
batch. The module is sent to the workers by value with the functions that use it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Canonical whole numbers for what is no finite number.
NO_NUMBER, BELOW, ABOVE = -(2**63), -(2**63) + 1, 2**63 - 1


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def stretches(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows, as first and end, that hold at most so many points or one row."""
    begin, low = starts_of(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + at_once, "right")) - 1)
        yield low, high
        low = high


def gathered(points: np.ndarray, first: np.ndarray, count: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Point `index` of a frame whose points start at `first`; NaN where the index is absent (-1) or out of range."""
    there = (index >= 0) & (index < count)
    found = np.full((len(index), 3), np.nan)
    found[there] = points[(first + index)[there]]
    return found


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[:, i] * b[:, j] - a[:, j] * b[:, i] for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def torsion(before, axis, after, near, far, defined) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine of the angle around `axis`; 0, 0 where an atom is absent, 0, 1 where none can be told."""
    length = np.sqrt(dot(axis, axis))
    x = np.where(length < 1e-8, -dot(before, after), dot(near, far))
    y = length * dot(before, far)
    r = np.sqrt(x * x + y * y)
    flat = r == 0
    safe = np.where(flat, 1.0, r)
    return np.where(defined & ~flat, y / safe, 0.0), np.where(defined, np.where(flat, 1.0, x / safe), 0.0)


def backbone(at: dict[str, np.ndarray], there: dict[str, np.ndarray], weights: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """C-beta (n, 3) and phi, psi, omega as sine and cosine (n, 6) from the points cp, n, ca, c, nn, can and cb."""
    with np.errstate(invalid="ignore", over="ignore"):
        walk = [at[name] for name in ("cp", "n", "ca", "c", "nn", "can")]
        bonds = [b - a for a, b in zip(walk, walk[1:])]
        normals = [cross(a, b) for a, b in zip(bonds, bonds[1:])]
        corners = {"phi": ("cp", "n", "ca", "c"), "psi": ("n", "ca", "c", "nn"), "omega": ("ca", "c", "nn", "can")}
        parts = []
        for i, names in enumerate(corners.values()):
            defined = np.logical_and.reduce([there[name] for name in names])
            parts += torsion(bonds[i], bonds[i + 1], bonds[i + 2], normals[i], normals[i + 1], defined)
        virtual = at["ca"] + normals[1] * weights[0] + bonds[1] * weights[1] + bonds[2] * weights[2]
        arms = (there["n"] & there["c"])[:, None]
        cb = np.where(there["cb"][:, None], at["cb"], np.where(arms, virtual, at["ca"]))
    return cb, np.stack(parts, axis=1)


def half(values: np.ndarray) -> np.ndarray:
    """Values as half precision holds them, in single precision."""
    with np.errstate(over="ignore"):
        return values.astype(np.float16).astype(np.float32)


def canonical_whole(values: np.ndarray, scale: float = 10_000.0) -> np.ndarray:
    """floor(scale * x + 1/2) as 64-bit numbers, with names for NaN and for what lies beyond them."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale + 0.5)
        inside = np.abs(scaled) < 2.0**62
    whole = np.where(inside, scaled, 0).astype(np.int64)
    whole[scaled >= 2.0**62], whole[scaled <= -(2.0**62)], whole[np.isnan(scaled)] = ABOVE, BELOW, NO_NUMBER
    return whole


def neighbours(frame: np.ndarray, points: np.ndarray, reach: float, at_once: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, squared distance) of all pairs of different points of one frame less than `reach` apart.

    A cell list: points are sorted by (frame, cell of width `reach`), and each meets the 27 cells around its own. All
    pairs of a point come in the same part; a part has about `at_once` candidate pairs or those of one point.
    """
    placed = np.flatnonzero(np.isfinite(points).all(axis=1))
    if not len(placed):
        return
    width = reach
    while True:
        cell = np.floor(points[placed] / width)
        low = cell.min(axis=0)
        extent = cell.max(axis=0) - low + 3
        if float(np.prod(extent)) * (float(frame.max()) + 1) < 2.0**61:
            break
        width *= 2  # Wider cells only add candidates.
    cell = (cell - low).astype(np.int64) + 1
    extent = extent.astype(np.int64)
    key = ((frame[placed].astype(np.int64) * extent[0] + cell[:, 0]) * extent[1] + cell[:, 1]) * extent[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    placed, key = placed[order], key[order]
    steps = np.array([(x * extent[1] + y) * extent[2] + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    around = key[:, None] + steps[None, :]
    begin, end = np.searchsorted(key, around, "left"), np.searchsorted(key, around, "right")
    count = (end - begin).sum(axis=1)
    total = np.cumsum(count)
    low_row = 0
    while low_row < len(key):
        done = total[low_row - 1] if low_row else 0
        high_row = max(low_row + 1, int(np.searchsorted(total, done + at_once, "right")))
        first, size = begin[low_row:high_row].ravel(), (end - begin)[low_row:high_row].ravel()
        a = np.repeat(np.arange(low_row, high_row), count[low_row:high_row])
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        b = np.repeat(first, size) + inside
        other = a != b
        a, b = placed[a[other]], placed[b[other]]
        gap = points[a] - points[b]
        d2 = dot(gap, gap)
        near = d2 < reach * reach
        yield a[near], b[near], d2[near]
        low_row = high_row


def nearest(frame: np.ndarray, points: np.ndarray, radius: float, most: int, at_once: int = 100_000) -> tuple[np.ndarray, ...]:
    """(a, b, place, distance) of the `most` nearest points within the radius, ties to the lower point."""
    parts = []
    for a, b, d2 in neighbours(frame, points, radius, at_once):
        order = np.lexsort((b, d2, a))
        a, b, d2 = a[order], b[order], d2[order]
        place = np.arange(len(a)) - np.searchsorted(a, a) + 1
        keep = place <= most
        parts.append((a[keep], b[keep], place[keep], np.sqrt(d2[keep])))
    if not parts:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.float64))
    found = [np.concatenate(column) for column in zip(*parts)]
    order = np.lexsort((found[2], found[0]))
    return tuple(column[order] for column in found)


def sphere(n_points: int) -> np.ndarray:
    """Unit vectors on a golden spiral."""
    k = np.arange(n_points)
    z = 1.0 - (2.0 * k + 1.0) / n_points
    ring = np.sqrt(1.0 - z * z)
    turn = k * (math.pi * (3.0 - math.sqrt(5.0)))
    return np.stack([ring * np.cos(turn), ring * np.sin(turn), z], axis=1)


def exposed_points(frame: np.ndarray, points: np.ndarray, reach: np.ndarray, n_points: int) -> np.ndarray:
    """How many test points of each sphere lie inside no other sphere of its frame."""
    covered = np.zeros((len(points), n_points), bool)
    directions = sphere(n_points).T
    if len(points):
        for a, b, d2 in neighbours(frame, points, 2 * float(reach.max()), at_once=max(20_000_000 // n_points, 1)):
            touching = d2 < (reach[a] + reach[b]) * (reach[a] + reach[b])
            a, b, d2 = a[touching], b[touching], d2[touching]
            if not len(a):
                continue
            # A point at reach * u from the atom is inside the neighbour when (atom - neighbour) . u is below this bound.
            bound = (reach[b] * reach[b] - d2 - reach[a] * reach[a]) / (2 * reach[a])
            step = max(1, 4_000_000 // n_points)
            for low in range(0, len(a), step):
                part = slice(low, low + step)
                inside = (points[a[part]] - points[b[part]]) @ directions < bound[part][:, None]
                at = np.flatnonzero(np.concatenate([[True], a[part][1:] != a[part][:-1]]))
                covered[a[part][at]] |= np.logical_or.reduceat(inside, at, axis=0)
    return n_points - covered.sum(axis=1)


def sphere_areas(sizes: np.ndarray, at: np.ndarray, reach: np.ndarray, n_points: int, at_once: int = 20_000) -> np.ndarray:
    """Exposed area of every sphere of frames with so many spheres each; frames are taken together up to `at_once` spheres."""
    begin = starts_of(sizes)
    frame = np.repeat(np.arange(len(sizes)), sizes)
    area = np.zeros(len(at))
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + at_once, "right")) - 1)
        part = slice(begin[low], begin[high])
        exposed = exposed_points(frame[part] - low, at[part], reach[part], n_points)
        area[part] = 4 * math.pi * reach[part] * reach[part] * exposed / float(n_points)
        low = high
    return area
