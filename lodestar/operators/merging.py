"""Merging fine clusters into two shards. Input is one row for each cluster, so this runs on the driver in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: How far a shard may outgrow its target, and where power iteration stops.
OVERFLOW = 1.06
POWER_STEPS, POWER_STOP = 100, 1e-6


def _check(centroids: np.ndarray, sizes: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    c, s = np.asarray(centroids, np.float64), np.asarray(sizes, np.int64)
    if len(c) < 2:
        raise ValueError("two shards need two clusters")
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    return c, s


@dataclass(frozen=True)
class Bisection:
    axis: np.ndarray
    mean: np.ndarray
    projection: np.ndarray
    shard: np.ndarray


def principal_axis(centered: np.ndarray, weights: np.ndarray, steps: int = POWER_STEPS, stop: float = POWER_STOP) -> np.ndarray:
    """First principal axis by power iteration from the first row; its sign follows from that start."""
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v
    axis = unit(centered[0])
    for _ in range(steps):
        nxt = unit((centered * weights[:, None]).T @ (centered @ axis))
        done = abs(abs(nxt @ axis) - 1) < stop
        axis = nxt
        if done:
            break
    return axis


def split_sorted(sizes: np.ndarray, target: int) -> int:
    """How many leading clusters come nearest to ``target`` rows; the larger count on a tie; one at least on each side."""
    total = np.cumsum(sizes)
    i = int(np.searchsorted(total, target))
    if i >= len(sizes):
        return 1
    before = total[i] - sizes[i]
    cut = i if i and abs(before - target) < abs(total[i] - target) else i + 1
    return min(max(cut, 1), len(sizes) - 1)


def pca_bisection(centroids: np.ndarray, sizes: np.ndarray, ratio: float = 0.5, steps: int = POWER_STEPS, stop: float = POWER_STOP) -> Bisection:
    """Clusters in the order of their projection on the first principal axis, cut where shard 0 is nearest to its share."""
    c, s = _check(centroids, sizes, ratio)
    mean = (c * s[:, None]).sum(0) / max(1, s.sum())
    axis = principal_axis(c - mean, s.astype(np.float64), steps, stop)
    p = (c - mean) @ axis
    order = np.lexsort((np.arange(len(p)), p))
    cut = split_sorted(s[order], int(s.sum() * ratio))
    shard = np.ones(len(c), np.int64)
    shard[order[:cut]] = 0
    return Bisection(axis, mean, p, shard)


def seeds(centroids: np.ndarray) -> tuple[int, int]:
    """The first pair at the greatest distance; (0, 0) if all coincide."""
    best, pair = 0.0, (0, 0)
    for i in range(len(centroids) - 1):
        d = np.linalg.norm(centroids[i + 1 :] - centroids[i], axis=1)
        if len(d) and d.max() > best:
            best, pair = float(d.max()), (i, i + 1 + int(d.argmax()))
    return pair


def greedy_merge(centroids: np.ndarray, sizes: np.ndarray, ratio: float = 0.5, linkage: str = "min") -> np.ndarray:
    """Shard of each cluster: from the two seeds the globally nearest free cluster joins its nearer shard.

    ``linkage`` 'min' measures to the nearest member, 'centroid' to the weighted mean of the shard. A cluster that would
    take a shard beyond OVERFLOW times its target goes to the other one, whatever that one holds. Equal distances
    prefer shard 1, equal best distances the lower cluster. Running distances keep it at k^2 evaluations.
    """
    c, s = _check(centroids, sizes, ratio)
    if linkage not in ("min", "centroid"):
        raise ValueError("linkage must be 'min' or 'centroid'")
    total = int(s.sum())
    goal0 = int(total * ratio)
    limit = np.array([goal0, total - goal0]) * OVERFLOW
    shard = np.full(len(c), -1)
    for side, i in enumerate(seeds(c)):
        shard[i] = side
    load = np.array([s[shard == 0].sum(), s[shard == 1].sum()])
    to = lambda v: np.linalg.norm(c - v, axis=1)

    def mean(side: int) -> np.ndarray:
        i = shard == side
        return (c[i] * s[i][:, None]).sum(0) / s[i].sum() if s[i].sum() else np.zeros(c.shape[1])

    if linkage == "min":
        dist = np.stack([to(c[shard == side][0]) if (shard == side).any() else np.full(len(c), np.inf) for side in (0, 1)])
    while (free := np.flatnonzero(shard < 0)).size:
        if linkage == "centroid":
            dist = np.stack([to(mean(0)), to(mean(1))])
        side = np.where(dist[0, free] < dist[1, free], 0, 1)
        side = np.where(load[side] + s[free] > limit[side], 1 - side, side)
        pick = int(dist[side, free].argmin())
        i, to_side = int(free[pick]), int(side[pick])
        shard[i] = to_side
        load[to_side] += s[i]
        if linkage == "min":
            dist[to_side] = np.minimum(dist[to_side], to(c[i]))
    return shard
