"""Spanning forests of links inside one task."""

from __future__ import annotations

import numpy as np


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Flags of links (ids) that join trees not joined before."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y] if y in parent else y
            x = parent[x]
        return x

    out = np.zeros(len(left), bool)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out[i] = True
    return out
