"""Ranks of suffixes by prefix doubling."""

from __future__ import annotations

import numpy as np


def rank_levels(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes of `codes` by their first 1, 2, 4, ... codes, up to the level at which all differ. The last
    code must occur only there. Two suffixes agree in their first 2**k codes exactly if their ranks of level k are equal."""
    n = len(codes)
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while n and levels[-1].max() < n - 1:
        now = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - step] = now[step:] + 1
        levels.append(np.unique(now * (n + 1) + after, return_inverse=True)[1])
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of the suffixes at a and at b, element by element, where a and b differ."""
    a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        for x in (a, b, length):
            x[same] += 1 << k
    return length
