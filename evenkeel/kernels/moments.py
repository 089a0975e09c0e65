"""Covariances of windows and their leading eigenpairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Matrices that are solved at once, and entries of all of them.
BATCH, ENTRIES = 2048, 1 << 22


def correlation(cov: np.ndarray) -> np.ndarray:
    """Correlations of a batch of covariances; a variable without variance has a row of zeros."""
    sd = np.sqrt(np.maximum(np.einsum("...ii->...i", cov), 0))
    below = sd[..., :, None] * sd[..., None, :]
    out = np.divide(cov, below, out=np.zeros_like(cov), where=below > 0)
    i = np.arange(cov.shape[-1])
    out[..., i, i] = sd > 0
    return out


def leading(cov: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``p`` largest eigenvalues in falling order, their vectors as columns, and traces."""
    values, vectors = np.linalg.eigh((cov + np.swapaxes(cov, -1, -2)) / 2)
    return values[..., ::-1][..., :p], vectors[..., ::-1][..., :p], np.einsum("...ii->...", cov)


def pieces(ends: np.ndarray, d: int, refresh_every: int) -> list[np.ndarray]:
    """Runs of successive windows, each of a bounded number of matrix entries: sums are made anew for every piece."""
    most = max(1, min(refresh_every, BATCH, ENTRIES // (d * d)))
    runs = np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends) != 1) + 1)
    return [run[i : i + most] for run in runs for i in range(0, len(run), most)]


def window_moments(x: np.ndarray, first: int, n: int, window: int, ddof: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of ``n`` successive windows, the first of which ends at row ``first``.

    The first window is summed up whole, about its own mean; the next ones gain a row and lose one.
    """
    start = x[first - window + 1 : first + 1]
    centre = start.mean(axis=0)
    start, gained, lost = start - centre, x[first + 1 : first + n] - centre, x[first - window + 1 : first - window + n] - centre
    s1 = np.cumsum(np.concatenate([start.sum(axis=0)[None], gained - lost]), axis=0)
    s2 = np.empty((n, x.shape[1], x.shape[1]))
    s2[0] = start.T @ start
    np.multiply(gained[:, :, None], gained[:, None, :], out=s2[1:])
    s2[1:] -= lost[:, :, None] * lost[:, None, :]
    np.cumsum(s2, axis=0, out=s2)
    s2 -= s1[:, :, None] * s1[:, None, :] / window
    s2 /= window - ddof
    return centre + s1 / window, s2


def flat_windows(panel: np.ndarray, ends: np.ndarray, window: int, p: int, corr: bool, ddof: int, refresh_every: int = 1024, tol: float | None = None):
    """Eigenpairs for windows of ``(items, T, d)`` that end at ``ends``; NaN marks an absent feature (one item only).

    Values, vectors, means per item, total variance. Where fewer than ``p`` features are there, all is NaN. With ``tol``,
    a window whose features are all there starts from the basis of the window before, if it has one.
    """
    items, _, d = panel.shape
    n = len(ends)
    values, vectors = np.full((n, p), np.nan), np.full((n, d, p), np.nan)
    means, total = np.full((items, n, d), np.nan), np.full(n, np.nan)
    finite = np.concatenate([np.zeros((1, d)), np.cumsum(np.isfinite(panel).all(axis=0), axis=0)])
    active = finite[ends + 1] - finite[ends + 1 - window] == window
    sets, of = np.unique(active, axis=0, return_inverse=True)
    for k, on in enumerate(sets):
        if on.sum() < p:
            continue
        rows, use = np.flatnonzero(of.ravel() == k), np.flatnonzero(on)
        if tol is not None and on.all() and items == 1 and p < d:
            for at, found in subspaces(panel[0], ends[rows], window, p, corr, ddof, refresh_every, tol):
                values[rows[at]], vectors[rows[at]], means[0, rows[at]], total[rows[at]] = found
            continue
        for run in pieces(ends[rows], len(use), refresh_every):
            at, cov = rows[run], 0
            for f in range(items):
                x = panel[f, ends[at[0]] - window + 1 : ends[at[-1]] + 1][:, use]
                m, c = window_moments(x, window - 1, len(at), window, ddof)
                means[np.ix_([f], at, use)] = m
                cov = c if items == 1 else cov + c / items
            if corr:
                cov = correlation(cov)
            values[at], vectors[np.ix_(at, use)], total[at] = leading(cov, p)
    return values, vectors, means, total


def subspaces(x: np.ndarray, ends: np.ndarray, window: int, p: int, corr: bool, ddof: int, refresh_every: int, tol: float):
    """Each window's place among ``ends``, and its values, vectors, mean and total variance, from one basis to the next.

    One matrix of sums slides along; covariances are multiplied by a basis without being written out.
    """
    before, last = None, -1
    for at, end in enumerate(ends):
        if end != last + 1 or (at % refresh_every) == 0:
            rows = x[end - window + 1 : end + 1]
            centre = rows.mean(axis=0)
            rows = rows - centre
            s1, s2 = rows.sum(axis=0), rows.T @ rows
            before = before if end == last + 1 else None
        else:
            gained, lost = x[end] - centre, x[end - window] - centre
            s1 += gained - lost
            s2 += np.stack([gained, -lost], axis=1) @ np.stack([gained, lost])
        last, n = end, window - ddof
        total = (np.trace(s2) - s1 @ s1 / window) / n
        cov = None
        if corr or before is None:
            cov = (s2 - np.outer(s1, s1) / window) / n
            cov = correlation(cov) if corr else cov
            total = np.trace(cov)
        times = cov.__matmul__ if corr else lambda v: (s2 @ v - np.outer(s1, s1 @ v) / window) / n  # noqa: B023
        found = None if before is None else warm_subspace(times, before, tol)
        if found is None:
            found = leading(cov if cov is not None else (s2 - np.outer(s1, s1) / window) / n, p)[:2]
        before = found[1]
        yield at, (*found, centre + s1 / window, total)


class Decayed:
    """Exponentially weighted moments of ``(items, d)`` rows, from the first row on."""

    def __init__(self, items: int, d: int, halflife: float) -> None:
        self.keep = 0.5 ** (1.0 / halflife)
        self.s1, self.s2, self.weight = np.zeros((items, d)), np.zeros((items, d, d)), 0.0

    def add(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.weight = self.keep * self.weight + 1.0
        self.s1 = self.keep * self.s1 + row
        self.s2 = self.keep * self.s2 + row[:, :, None] * row[:, None, :]
        mean = self.s1 / self.weight
        return mean, (self.s2 / self.weight - mean[:, :, None] * mean[:, None, :]).mean(axis=0)


def warm_subspace(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, tol: float = 1e-8, steps: int = 8):
    """Leading eigenpairs by subspace iteration from a nearby basis; None where it doesn't converge.

    ``times`` multiplies the matrix by columns.
    """
    image = times(start)
    for _ in range(steps):
        basis, _ = np.linalg.qr(image)
        image = times(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = basis @ turn, image @ turn
        off = image - vectors * values
        if (off * off).sum() <= tol * tol * (values * values).sum():
            return values, vectors
    return None
