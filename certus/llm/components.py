"""Components of links: over a table, and within one task."""

from __future__ import annotations

import numpy as np

from certus.operators.components import connected_components

__all__ = ["connected_components", "spanning_links"]


def spanning_links(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: each node's smallest reachable node."""
    root = np.arange(n)
    a, b = np.asarray(a), np.asarray(b)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root
