"""Two-level k-means of a bounded sample: roots, leaves, and the leaf interval of each root."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Hierarchy:
    """``leaves``: centroids by cluster id; root r owns the leaves from ``offsets[r]`` to ``offsets[r + 1]``."""

    leaves: np.ndarray
    roots: np.ndarray
    offsets: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a.astype(np.float32) @ b.T.astype(np.float32)) * -2
    d += np.einsum("ij,ij->i", a, a)[:, None]
    d += np.einsum("ij,ij->i", b, b)[None]
    return np.maximum(d, 0, out=d)


def closest(x: np.ndarray, centres: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance); a near tie is decided by the exact distances, a tie goes to the smaller id."""
    label, best = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), block):
        rows = x[at : at + block]
        d = distances(rows, centres)
        low = d.min(1)
        scale = np.einsum("ij,ij->i", rows, rows) + 1
        label[at : at + block] = d.argmin(1)
        best[at : at + block] = low
        for i in np.flatnonzero((d <= (low + 1e-5 * scale)[:, None]).sum(1) > 1):
            near = np.flatnonzero(d[i] <= low[i] + 1e-5 * scale[i])
            exact = ((rows[i].astype(np.float64) - centres[near]) ** 2).sum(1)
            label[at + i], best[at + i] = near[exact.argmin()], exact.min()
    return label, best


def kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids from distinct start rows; an empty cluster takes half of the largest by a small shift of its centre."""
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(iterations):
        sizes, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]))
        for a in range(0, len(x), 4096):  # a block's sums come from a matrix product, blocks add up in double precision
            rows = x[a : a + 4096]
            label = distances(rows, centres).argmin(1)
            mine, at = np.unique(label, return_inverse=True)
            member = np.zeros((len(mine), len(rows)), np.float32)
            member[at, np.arange(len(rows))] = 1
            sums[mine] += member @ rows
            sizes += np.bincount(label, minlength=k)
        filled = np.flatnonzero(sizes)
        new = centres.copy()
        new[filled] = (sums[filled] / sizes[filled, None]).astype(np.float32)
        room = sizes.copy()
        for e in np.flatnonzero(sizes == 0):
            donor = int(room.argmax())
            shift = np.where(np.arange(x.shape[1]) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024).astype(np.float32)
            new[e], new[donor] = new[donor] * shift, new[donor] * (2 - shift)
            room[e], room[donor] = room[donor] // 2, room[donor] - room[donor] // 2
        if np.array_equal(new, centres):
            break
        centres = new
    if not np.isfinite(centres).all():
        raise FloatingPointError("training left the finite numbers")
    return centres


def budgets(sizes: np.ndarray, count: int) -> np.ndarray:
    """Leaves per root, in proportion to its rows: at least one, no more than rows, ``count`` in all, by largest remainders."""
    share = sizes * count / sizes.sum()
    got = np.clip(np.floor(share).astype(np.int64), 1, sizes)
    while got.sum() != count:
        gap = share - got
        if got.sum() < count:
            gap = np.where(got < sizes, gap, -np.inf)
            got[int(gap.argmax())] += 1
        else:
            gap = np.where(got > 1, gap, np.inf)
            got[int(gap.argmin())] -= 1
    return got


def recovered_roots(x: np.ndarray, roots: np.ndarray, label: np.ndarray, attempts: int = 3, iterations: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(roots, owner of each row) in which every root owns a row, where that can be had.

    A root without rows starts again at the row of the largest root that lies farthest from it, and all roots are moved a few times; after
    ``attempts`` it may still own nothing.
    """
    for _ in range(attempts):
        sizes = np.bincount(label, minlength=len(roots))
        if sizes.all():
            break
        roots = roots.copy()
        for empty in np.flatnonzero(sizes == 0):
            donor = int(sizes.argmax())
            own = np.flatnonzero(label == donor)
            if len(own) < 2:
                break
            far = own[((x[own].astype(np.float64) - roots[donor]) ** 2).sum(1).argmax()]
            roots[empty], label[far] = x[far], empty
            sizes[donor], sizes[empty] = sizes[donor] - 1, 1
        for _ in range(iterations):
            label, _ = closest(x, roots)
            sizes = np.bincount(label, minlength=len(roots))
            filled = np.flatnonzero(sizes)
            order = np.argsort(label, kind="stable")
            sums = np.add.reduceat(x[order].astype(np.float64), np.concatenate([[0], np.cumsum(sizes[filled])[:-1]]), axis=0)
            roots[filled] = (sums / sizes[filled, None]).astype(np.float32)
        label, _ = closest(x, roots)
    return roots, label


def flat_hierarchy(x: np.ndarray, count: int, roots: np.ndarray, iterations: int, seed: int) -> Hierarchy:
    """Leaves trained without roots, then laid out by their nearest root; a root is the mean of its leaves."""
    leaves = kmeans(x, count, iterations, np.random.default_rng(seed))
    label, _ = closest(leaves, roots)
    order = np.argsort(label, kind="stable")
    kept, sizes = np.unique(label, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    leaves = leaves[order]
    means = np.stack([leaves[a:b].astype(np.float64).mean(0) for a, b in zip(ends, ends[1:])]).astype(np.float32)
    return Hierarchy(leaves, means, ends)


def train(x: np.ndarray, count: int, iterations: int, seed: int) -> Hierarchy:
    """Roots, then the leaves of each from its own rows; leaves trained flat, with a warning, where the roots cannot share the rows out."""
    rng = np.random.default_rng(seed)
    roots = kmeans(x, min(count, max(1, round(count**0.5))), iterations, rng)
    label, _ = closest(x, roots)
    roots, label = recovered_roots(x, roots, label)
    sizes = np.bincount(label, minlength=len(roots))
    if not sizes.all():
        warnings.warn("some roots own no rows: the leaves are trained without them", RuntimeWarning, stacklevel=2)
        return flat_hierarchy(x, count, roots, iterations, seed)
    share = budgets(sizes, count)
    leaves = [kmeans(x[label == r], int(n), iterations, np.random.default_rng([seed, r + 1])) for r, n in enumerate(share)]
    return Hierarchy(np.concatenate(leaves), roots, np.concatenate([[0], np.cumsum(share)]))
