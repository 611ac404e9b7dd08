"""Rank agreement, low-discrepancy points and content fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np


def inversions(ranks: np.ndarray) -> int:
    """Pairs of places whose ranks, whole numbers, stand in descending order; halves of blocks are merged, each level in one pass."""
    found, width, n = 0, 1, len(ranks)
    at = np.argsort(ranks, kind="stable")
    while width < n:
        block = at // (2 * width)
        merged = np.argsort(block, kind="stable")
        place, own = at[merged], block[merged]
        right = (place // width) & 1
        before = np.cumsum(right)
        start = np.searchsorted(own, own)  # first of each block
        left = right == 0
        found += int((before[left] - (before - right)[start[left]]).sum())
        width *= 2
    return found


def _tied(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    runs = np.bincount(np.cumsum(new))
    return int((runs * (runs - 1) // 2).sum())


def kendall_tau(a: list, b: list) -> float:
    """Agreement of the order of two lists over their common length; pairs tied in either do not count, none at all gives 1.

    By Knight's rule, in n log(n) steps: discordant pairs are the inversions of one list sorted by the other. A place without a value
    in one of the lists has no pairs.
    """
    a, b = ([] if x is None else x for x in (a, b))
    n = min(len(a), len(b))
    x, y = np.asarray(a[:n], float), np.asarray(b[:n], float)
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = (np.unique(v[both], return_inverse=True)[1].astype(np.int64) for v in (x, y))
    n = len(x)
    if not n:
        return 1.0
    counted = n * (n - 1) // 2 - _tied(x) - _tied(y) + _tied(x, y)
    discordant = inversions(y[np.lexsort((y, x))])
    return (counted - 2 * discordant) / counted if counted else 1.0


def radical_inverse(index: int, base: int) -> float:
    value, scale = 0.0, 1.0 / base
    while index:
        index, digit = divmod(index, base)
        value += digit * scale
        scale /= base
    return value


def halton(count: int) -> list[tuple[float, float, float]]:
    """The first points of the sequence with bases 2, 3 and 5, starting at the origin."""
    return [tuple(radical_inverse(i, b) for b in (2, 3, 5)) for i in range(count)]


def diagonal(count: int = 8) -> list[tuple[float, float, float]]:
    """Lattice origins one voxel further back on every axis each, in voxels."""
    return [(0.0 - i,) * 3 for i in range(count)]


def occupancy_sha256(linear: np.ndarray, total: int) -> str:
    """SHA-256 of the occupancy bits in raster order, eight voxels a byte, lowest bit first, zero padded.

    Works through the sorted occupied indices in blocks; the dense bit string is never held.
    """
    digest = hashlib.sha256()
    linear = np.sort(np.unique(np.asarray(linear, np.int64)))
    size, block = (total + 7) // 8, 1 << 20
    for start in range(0, size, block):
        end = min(start + block, size)
        inside = linear[np.searchsorted(linear, start * 8) : np.searchsorted(linear, end * 8)] - start * 8
        packed = np.zeros(end - start, np.uint8)
        np.bitwise_or.at(packed, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        digest.update(packed.tobytes())
    return digest.hexdigest()
