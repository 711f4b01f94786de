"""Exact links between 64-bit fingerprints that differ in few bits, by vantage points."""

from __future__ import annotations

import numpy as np

# Members up to which a branch is compared directly.
LEAF = 64
# Cells of a comparison held at once.
CELLS = 1 << 21


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """A tree over distinct fingerprints, split at the median distance to a vantage point.

    A query of radius r enters the near branch if ``d <= cut + r`` and the far branch if
    ``d > cut - r``: by the triangle inequality no other branch holds a match. Queries go
    down together, as arrays.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints

    def matches(self, radius: int, labels: np.ndarray | None = None):
        """Index pairs (query, member) within the radius, in bounded pieces.

        With ``labels``, which the caller changes as it goes, branches of one class are left out.
        """
        every = np.arange(len(self.prints))
        stack = [(every, every)]
        while stack:
            members, queries = stack.pop()
            if labels is not None:
                one = labels[members[0]]
                if (labels[members] == one).all() and (labels[queries] == one).all():
                    continue
            if len(members) <= LEAF:
                yield from self._direct(members, queries, radius)
                continue
            point = self.prints[members[0]]
            away = _distance(self.prints[members], point)
            cut = int(np.median(away))
            near = away <= cut
            if near.all():
                near = away < cut
            if not near.any() or near.all():  # all equally far: no split helps
                yield from self._direct(members, queries, radius)
                continue
            cut = int(away[near].max())
            from_queries = _distance(self.prints[queries], point)
            for side, inside in ((near, from_queries <= cut + radius), (~near, from_queries > cut - radius)):
                if inside.any():
                    stack.append((members[side], queries[inside]))

    def _direct(self, members: np.ndarray, queries: np.ndarray, radius: int):
        step = max(1, CELLS // len(members))
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            close = _distance(self.prints[part][:, None], self.prints[members][None, :]) <= radius
            q, m = np.nonzero(close)
            yield part[q], members[m]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link the lesser label, until nothing changes."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low = np.minimum(x[differ], y[differ])
        # the old labels' own entries move, too, so that whole classes follow
        np.minimum.at(labels, x[differ], low)
        np.minimum.at(labels, y[differ], low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def join_pairs(
    labels: np.ndarray, a: np.ndarray, b: np.ndarray, away: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs, closer ones first, that join two classes; the labels follow."""
    order = np.argsort(away, kind="stable")
    a, b = a[order], b[order]
    kept_a, kept_b = [a[:0]], [b[:0]]
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return np.concatenate(kept_a), np.concatenate(kept_b)
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        # every class goes to a lesser one, so that no ring closes
        high, first = np.unique(np.maximum(x, y), return_index=True)
        labels[high] = np.minimum(x, y)[first]
        kept_a.append(a[first])
        kept_b.append(b[first])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def spanning_pairs(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect what all such pairs connect, fewer than members."""
    labels = np.arange(len(prints))
    left, right = [prints[:0]], [prints[:0]]
    for a, b in VantageTree(prints).matches(radius, labels):
        a, b = join_pairs(labels, a, b, _distance(prints[a], prints[b]))
        left.append(prints[a])
        right.append(prints[b])
    return np.concatenate(left), np.concatenate(right)


def spanning_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As many links as connect what lies within the radius, directly or in steps."""
    labels = np.arange(len(prints))
    for a, b in VantageTree(prints).matches(radius):
        join_labels(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(prints)))
    return prints[moved], prints[labels[moved]]
