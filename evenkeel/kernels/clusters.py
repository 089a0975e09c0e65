"""Lloyd iterations with matched identities, and Procrustes-aligned embeddings: steppers over periods."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from evenkeel.kernels.matching import assignment, canonical_signs


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """The point nearest the mean, then each time the point farthest from those chosen; the first of equals."""
    chosen = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen].copy()


def plus_plus(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    out = [x[random.integers(len(x))]]
    near = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < k:
        total = near.sum()
        out.append(x[random.integers(len(x)) if total <= 0 else random.choice(len(x), p=near / total)])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def lloyd(x: np.ndarray, centres: np.ndarray, iterations: int, tol: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Centres, labels, inertia and iterations. Empty clusters take the farthest points in turn."""
    k, i = len(centres), 0
    for i in range(1, iterations + 1):
        far = squared_distances(x, centres)
        label = far.argmin(axis=1)
        count = np.bincount(label, minlength=k).astype(float)
        total = np.zeros_like(centres)
        np.add.at(total, label, x)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            taken = np.argsort(-far[np.arange(len(x)), label], kind="stable")[: len(empty)]
            count[empty], total[empty] = 1.0, x[taken]
        new = total / count[:, None]
        moved = ((new - centres) ** 2).sum(axis=1).max()
        centres = new
        if moved <= tol**2:
            break
    far = squared_distances(x, centres)
    return centres, far.argmin(axis=1), float(far.min(axis=1).sum()), i


class KMeansStepper:
    """One step per period; batch and stream run the same object."""

    def __init__(self, n_clusters=3, centroid_memory=1, max_iter=300, warm_iter=100, tol=1e-8, init="maxmin", seed=None, n_init=10) -> None:
        if centroid_memory < 1:
            raise ValueError(f"centroid_memory must be 1 or more; got {centroid_memory}")
        if init not in ("maxmin", "k-means++"):
            raise ValueError(f"init must be 'maxmin' or 'k-means++'; got {init!r}")
        if n_clusters < 1:
            raise ValueError(f"n_clusters must be 1 or more; got {n_clusters}")
        self.k, self.max_iter, self.warm, self.tol = n_clusters, max_iter, warm_iter, tol
        self.init, self.seed, self.n_init = init, seed, n_init
        self.centres, self.memory = None, deque(maxlen=centroid_memory)
        self.labels: dict = {}

    def _first(self, x: np.ndarray) -> np.ndarray:
        if self.init == "maxmin":
            return lloyd(x, farthest_first(x, self.k), self.max_iter, self.tol)[0]
        random = np.random.default_rng(self.seed)
        tries = [lloyd(x, plus_plus(x, self.k, random), self.max_iter, self.tol) for _ in range(max(1, self.n_init))]
        return min(tries, key=lambda t: t[2])[0]

    def step(self, entities: list, x: np.ndarray) -> dict:
        if len(x) < self.k:
            raise ValueError(f"a period has {len(x)} entities, fewer than {self.k} clusters")
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        relabels, iterations = 0, 0
        if self.centres is None:
            centres = self._first(x)
            self.centres = centres[np.lexsort(centres.T[::-1])]
        else:
            centres, _, _, iterations = lloyd(x, self.centres, self.warm, self.tol)
            perm = assignment(squared_distances(self.centres, centres))
            relabels = int((perm != np.arange(self.k)).sum())
            self.centres = centres[perm]
        self.memory.append(self.centres)
        far = np.stack([squared_distances(x, c) for c in self.memory]).min(axis=0)
        label = far.argmin(axis=1)
        switched = [e in self.labels and self.labels[e] != n for e, n in zip(entities, label, strict=True)]
        self.labels = dict(zip(entities, label.tolist(), strict=True))
        dist = far.min(axis=1)
        return {"label": label, "switched": switched, "dist2": dist, "centroids": self.centres, "inertia": float(dist.sum()), "n_relabels": relabels, "n_iter": iterations}


def procrustes_fit(reference: np.ndarray, current: np.ndarray, r0: np.ndarray, c0: np.ndarray, scale: bool = False):
    """(turn, shift, scale) that move ``current`` onto ``reference``, both centred, their means beside them."""
    u, s, vt = np.linalg.svd(current.T @ reference)
    turn = u @ vt
    size = (current**2).sum()
    factor = float(s.sum() / size) if scale and size > 0 else 1.0
    return turn, r0 - c0 @ turn * factor, factor


def procrustes_align(reference: np.ndarray, current: np.ndarray, scale: bool = False):
    """``current`` turned, mirrored if need be, and moved onto ``reference``: aligned, disparity, (turn, shift, scale)."""
    r0, c0 = reference.mean(axis=0), current.mean(axis=0)
    turn, shift, factor = procrustes_fit(reference - r0, current - c0, r0, c0, scale)
    aligned = current @ turn * factor + shift
    return aligned, float(np.sqrt(((aligned - reference) ** 2).sum(axis=1).mean())), (turn, shift, factor)


def principal_axes(x: np.ndarray, start: np.ndarray | None, k: int) -> np.ndarray:
    """Coordinates on the leading axes of a cross-section."""
    z = x - x.mean(axis=0)
    return z @ leading_axes(z.T @ z / max(1, len(x) - 1), k)


def leading_axes(covariance: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` principal axes as columns."""
    values, vectors = np.linalg.eigh(covariance)
    return canonical_signs(vectors[:, ::-1][:, :k])


def factored(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows as their number, their mean and a factor: of the centred rows, with no more rows than columns."""
    mean = x.mean(axis=0)
    return len(x), mean, np.linalg.qr(x - mean, mode="r")


def pooled(n: np.ndarray, means: np.ndarray, factors: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """What ``factored`` gives for all rows, from what it gave for parts of them."""
    total = n.sum()
    mean = means[0] + (n / total) @ (means - means[0])
    between = np.sqrt(n)[:, None] * (means - mean)
    return int(total), mean, np.linalg.qr(np.concatenate([between, *factors]), mode="r")


def turned(steps: Iterable[tuple[int, np.ndarray, np.ndarray] | None], k: int, scale: bool = False) -> Iterator[tuple]:
    """Each step's turn, shift and disparity, as ``EmbeddingStepper`` finds them, from what ``factored`` gives for the
    rows of entities that the step before has too: their raw coordinates there, then those of the step. None: no such rows."""
    turn, shift = np.eye(k), np.zeros(k)
    for found in steps:
        if found is None or found[0] < max(k + 1, 3):
            turn, shift, disparity = np.eye(k), np.zeros(k), np.nan
        else:
            n, mean, r = found
            reference, current = r[:, :k] @ turn, r[:, k:]
            r0, c0 = mean[:k] @ turn + shift, mean[k:]
            turn, shift, factor = procrustes_fit(reference, current, r0, c0, scale)
            turn = turn * factor
            disparity = float(np.sqrt(((current @ turn - reference) ** 2).sum() / n))
        yield turn, shift, disparity


def backend(which: str | Callable, k: int, seed: int = 0, settings: dict | None = None) -> Callable:
    """A function ``(x, start) -> coordinates``: "pca", "umap" (where umap-learn is installed) or a callable."""
    settings = settings or {}
    if callable(which):
        return lambda x, start: np.asarray(which(x, start, **settings), float)
    if which == "pca":
        return lambda x, start: principal_axes(x, start, k)
    if which == "umap":
        import umap

        def run(x: np.ndarray, start: np.ndarray | None) -> np.ndarray:
            own = {"n_neighbors": min(15, max(2, len(x) - 1)), "init": "spectral" if start is None else start} | settings
            return umap.UMAP(n_components=k, random_state=seed, **own).fit_transform(x)

        return run
    raise ValueError(f"unknown backend: {which!r}")


class EmbeddingStepper:
    """One step per period. Only the period before is remembered: who was absent from it is a newcomer."""

    def __init__(self, n_components=2, backend_name: str | Callable = "pca", scale=False, seed=0, backend_kwargs=None) -> None:
        self.k, self.scale = n_components, scale
        self.which = backend_name, seed, backend_kwargs
        backend(backend_name, n_components, seed, backend_kwargs)
        self.before: dict = {}

    def step(self, entities: list, x: np.ndarray) -> dict:
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        if not 1 <= self.k <= x.shape[1]:
            raise ValueError(f"n_components must be 1 to {x.shape[1]}; got {self.k}")
        name, seed, settings = self.which
        known = np.array([e in self.before for e in entities], bool)
        old = np.array([self.before[e] for e in entities if e in self.before], float).reshape(-1, self.k)
        start = None
        if known.any():
            start = np.empty((len(x), self.k))
            start[known] = old
            new = np.flatnonzero(~known)
            if len(new):
                start[new] = old[squared_distances(x[new], x[known]).argmin(axis=1)] + 1e-3 * (np.arange(len(new)) + 1)[:, None]
        found = backend(name, self.k, seed, settings)(x, start)
        if found.shape != (len(x), self.k):
            raise ValueError(f"backend returned shape {found.shape}, expected {(len(x), self.k)}")
        disparity, moved = np.nan, np.full(len(x), np.nan)
        if known.sum() >= max(self.k + 1, 3):
            _, disparity, (turn, shift, factor) = procrustes_align(old, found[known], self.scale)
            found = found @ turn * factor + shift
            moved[known] = np.sqrt(((found[known] - old) ** 2).sum(axis=1))
        self.before = dict(zip(entities, found, strict=True))
        return {"coords": found, "displacement": moved, "disparity": disparity}
