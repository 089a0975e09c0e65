"""Assignment and alignment of bases between steps."""

from __future__ import annotations

import numpy as np


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (shortest augmenting paths with potentials).

    Infinite costs are allowed; they are chosen only where nothing else is left.
    """
    cost = np.asarray(cost, float)
    n = len(cost)
    finite = np.isfinite(cost)
    if not finite.all():
        span = np.abs(cost[finite]).sum() + 1.0 if finite.any() else 1.0
        cost = np.where(finite, cost, 2 * span * (n + 1))
    rows, columns = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)  # row (from 1) of each column (from 1); 0: none
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            done[at] = True
            r = owner[at]
            slack = cost[r - 1] - rows[r] - columns[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            free = np.where(done, np.inf, least)
            nearest = int(np.argmin(free[1:])) + 1
            delta = free[nearest]
            rows[owner[done]] += delta
            columns[done] -= delta
            least[~done] -= delta
            at = nearest
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[came[at]], came[at]
    out = np.empty(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def canonical_signs(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size (the first of equals) is positive."""
    if not v.size:
        return v
    peak = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(peak < 0, -1.0, 1.0)


def matched(cosines: np.ndarray, method: str = "hungarian") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which current column takes each slot, its sign, and the size of their cosine, from slot-by-column cosines."""
    size = np.abs(cosines)
    p = len(size)
    if method == "hungarian":
        perm = assignment(-size)
    elif method == "greedy":  # each current column in turn takes the best slot that is left
        perm, left = np.empty(p, int), np.ones(p, bool)
        for column in range(p):
            slot = int(np.argmax(np.where(left, size[:, column], -1.0)))
            perm[slot], left[slot] = column, False
    else:
        raise ValueError(f"unknown matching method: {method!r}")
    slots = np.arange(p)
    return perm, np.where(cosines[slots, perm] < 0, -1.0, 1.0), size[slots, perm]


def match_step(previous: np.ndarray, current: np.ndarray, method: str = "hungarian"):
    return matched(previous.T @ current, method)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=0)
    return np.where(length > 1e-12, v / np.where(length > 1e-12, length, 1.0), 0.0)


class Chain:
    """Aligns bases one after another, each with the one before as aligned. Inactive coordinates are NaN."""

    def __init__(self, method: str = "hungarian") -> None:
        if method not in ("hungarian", "greedy"):
            raise ValueError(f"unknown matching method: {method!r}")
        self.method, self.basis = method, None

    def step(self, values: np.ndarray, vectors: np.ndarray):
        """Aligned values and vectors, similarity, flips and moves."""
        p = vectors.shape[1]
        active = ~np.isnan(vectors[:, 0])
        shared = active if self.basis is None else active & ~np.isnan(self.basis[:, 0])
        if self.basis is None or not shared.any():
            out = vectors.copy()
            out[active] = canonical_signs(vectors[active])
            self.basis = out
            return values, out, np.full(p, np.nan), 0, 0
        a, b = self.basis[shared], vectors[shared]
        perm, signs, similarity = matched(a.T @ b if shared.all() else _unit(a).T @ _unit(b), self.method)
        self.basis = vectors[:, perm] * signs
        return values[perm], self.basis, similarity, int((signs < 0).sum()), int((perm != np.arange(p)).sum())


def align_sequence(values: np.ndarray, vectors: np.ndarray, method: str = "hungarian"):
    """A whole chain: ``(T, p)`` and ``(T, d, p)``; steps whose values are NaN are passed over."""
    chain = Chain(method)
    out_values, out_vectors = values.copy(), vectors.copy()
    similarity, flips, moves = np.full(values.shape, np.nan), np.zeros(len(values), int), np.zeros(len(values), int)
    for t in np.flatnonzero(~np.isnan(values[:, 0])):
        out_values[t], out_vectors[t], similarity[t], flips[t], moves[t] = chain.step(values[t], vectors[t])
    return out_values, out_vectors, similarity, flips, moves
