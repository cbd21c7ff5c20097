"""The E8 lattice: nearest points and neighbouring cells, vectorised."""

from __future__ import annotations

import itertools

import numpy as np


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the directions of neighbouring cells."""
    pairs = [(i, j) for i in range(8) for j in range(i)]
    whole = np.zeros((112, 8))
    for k, ((i, j), (s, t)) in enumerate(itertools.product(pairs, itertools.product((1, -1), repeat=2))):
        whole[k, i], whole[k, j] = s, t
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and if the sum is odd, turn the worst rounded place the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    odd = near.sum(axis=1) % 2 != 0
    turn = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows[odd], worst[odd]] += turn[odd]
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of eight coordinates: the better of D8 and D8 shifted by one half."""
    whole = _nearest_d8(x)
    half = _nearest_d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(better[:, None], half, whole)
