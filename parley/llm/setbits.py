"""Bounds for the Jaccard similarity of sets: what it needs, and what parities of whole sets rule out."""

from __future__ import annotations

import numpy as np


def needed(nx: int, ny: int, percent: int) -> int:
    """Least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (nx + ny) // (100 + percent))


def allowed(nx: int, ny: int, percent: int) -> int:
    """Most elements that are in one set alone if the two are linked."""
    return nx + ny - 2 * needed(nx, ny, percent)


def parity(grams: np.ndarray) -> bytes:
    """For each slot of hashes whether it holds an odd number of the set, as bits; about as many slots as n-grams."""
    slots = min(max(64, 1 << (len(grams) - 1).bit_length()), 1 << 13) if len(grams) else 64
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(x: tuple[int, int], y: tuple[int, int]) -> int:
    """A lower bound of the elements that are in one set alone, from two parities (number of slots, bits).

    An element of both sets changes both parities alike. Parities of more slots fold to those of fewer by xor.
    """
    (sx, bx), (sy, by) = x, y
    while sx > sy:
        sx >>= 1
        bx = (bx ^ (bx >> sx)) & ((1 << sx) - 1)
    while sy > sx:
        sy >>= 1
        by = (by ^ (by >> sy)) & ((1 << sy) - 1)
    return (bx ^ by).bit_count()
