"""Outlines against the cells they stand for."""

import numpy as np
import pytest

from tidemark.operators import vectorise


def _runs(mask):
    rows = []
    for r, line in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
        rows += [(r, a, b - 1) for a, b in zip(edges[::2], edges[1::2])]
    return (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def _inside(rings, x, y):
    """Even number of crossings to the left is outside."""
    hits = 0
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
            if xa == xb and min(ya, yb) < y < max(ya, yb) and xa < x:
                hits += 1
    return hits % 2 == 1


def _area(ring):
    return sum(xa * yb - xb * ya for (xa, ya), (xb, yb) in zip(ring, ring[1:])) / 2


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_rings_enclose_their_cells(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(30):
        mask = rng.random((9, 11)) < share
        row, first, last = _runs(mask)
        label = vectorise.label_runs(row, first, last)
        for k in np.unique(label):
            at = label == k
            own = np.zeros_like(mask)
            for r, a, b in zip(row[at], first[at], last[at]):
                own[r, a : b + 1] = True
            rings = vectorise.rings(row[at], first[at], last[at])
            assert all(_inside(rings, c + 0.5, r + 0.5) == own[r, c] for r in range(9) for c in range(11))
            assert _area(rings[0]) > 0 and all(_area(x) < 0 for x in rings[1:]) and sum(map(_area, rings)) == own.sum()
            for ring in rings:
                assert ring[0] == ring[-1]
                for a, b, c in zip(ring, ring[1:], ring[2:]):  # corners only
                    assert (a[0] == b[0]) != (b[0] == c[0])


def test_a_large_region_has_few_edges():
    n = 3000
    rings = vectorise.rings(np.arange(n), np.zeros(n, np.int64), np.full(n, 10_000_000))
    assert rings == [[(0, 0), (10_000_001, 0), (10_000_001, n), (0, n), (0, 0)]]
