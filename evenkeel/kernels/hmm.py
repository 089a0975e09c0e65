"""Gaussian hidden Markov models: passes as associative scans, and a stepper with anchored identities."""

from __future__ import annotations

import numpy as np

from evenkeel.kernels.matching import assignment

#: Every responsibility and transition keeps this much, and no transition falls below the floor.
SMOOTH, FLOOR = 1e-10, 1e-4


def log_densities(x: np.ndarray, means: np.ndarray, covs: np.ndarray, reg: float) -> np.ndarray:
    """``(n, K)`` log densities; ``reg`` is added to each covariance's diagonal here too, besides the fit."""
    d = x.shape[1]
    lower = np.linalg.cholesky(covs + reg * np.eye(d))
    z = np.linalg.inv(lower) @ (x.T - means[:, :, None])
    logdet = 2 * np.log(np.einsum("kii->ki", lower)).sum(axis=1)
    return -0.5 * (d * np.log(2 * np.pi) + logdet[:, None] + (z**2).sum(axis=1)).T


def posterior(x: np.ndarray, means: np.ndarray, covs: np.ndarray, weights: np.ndarray, reg: float) -> np.ndarray:
    logs = log_densities(x, means, covs, reg) + np.log(weights)
    out = np.exp(logs - logs.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _products(m: np.ndarray) -> np.ndarray:
    """Running products of matrices ``(K, K, …, n)``, each up to a factor: doubling steps instead of a loop over time."""
    k, n = len(m), m.shape[-1]
    out, reach, level = m / m.max(axis=(0, 1)), 1, 0
    while reach < n:
        left, right = out[..., :-reach], out[..., reach:]
        new = np.empty_like(left)
        for i in range(k):
            for j in range(k):
                cell = np.multiply(left[i, 0], right[0, j], out=new[i, j])
                for between in range(1, k):
                    cell += left[i, between] * right[between, j]
        level += 1
        if level % 2 == 0 or k > 4:  # no entry falls below the floor of transitions to the fourth power in between
            new /= new.max(axis=(0, 1))
        out[..., reach:] = new
        reach *= 2
    return out


def _moves(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    return a[:, :, None] * np.ascontiguousarray(b[1:].T)[None]


def _filtered(first: np.ndarray, products: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.empty((products.shape[2] + 1, len(first)))
    rows[0], rows[1:] = first, sum(f * p for f, p in zip(first, products, strict=True)).T
    alpha = rows / rows.sum(axis=1, keepdims=True)
    out = moves.sum(axis=1)
    scale = sum(alpha[:-1, i] * out[i] for i in range(len(first)))
    return alpha, np.concatenate([[first.sum()], scale])


def forward(b: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered probabilities, scale factors, and the steps ``a * b[t]`` between them, time last."""
    moves = _moves(b, a)
    return *_filtered(pi * b[0], _products(moves) if moves.size else moves, moves), moves


def _scaled(alpha: np.ndarray, tail: np.ndarray) -> np.ndarray:
    beta = np.ones_like(alpha)
    beta[:-1] = tail.sum(axis=0)[:, ::-1].T
    return beta / (alpha * beta).sum(axis=1, keepdims=True)


def backward(alpha: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Backward factors, scaled so that they average to one under ``alpha``."""
    # products from the end: transposed and turned round, they run forward
    turned = np.ascontiguousarray(moves.swapaxes(0, 1)[:, :, ::-1])
    return _scaled(alpha, _products(turned) if moves.size else turned)


def both_ways(b: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``forward`` and ``backward`` in one scan."""
    moves = _moves(b, a)
    both = np.stack([moves, moves.swapaxes(0, 1)[:, :, ::-1]], axis=2)
    both = _products(both) if moves.size else both
    alpha, scale = _filtered(pi * b[0], both[:, :, 0], moves)
    return alpha, scale, moves, _scaled(alpha, both[:, :, 1])


def fit(x, means, covs, a, pi, *, iterations, tol, reg, pseudo, least_mass, a_prior, prior_means, prior_covs, strength):
    """MAP Baum-Welch from a warm start; new parameters, the mean log likelihood before the last step, iterations."""
    n, d = x.shape
    k = len(means)
    last, mean_log, i = -np.inf, -np.inf, 0
    for i in range(1, iterations + 1):
        logs = log_densities(x, means, covs, reg)
        shift = logs.max(axis=1)
        alpha, scale, moves, beta = both_ways(np.exp(logs - shift[:, None]), a, pi)
        mean_log = float((np.log(scale) + shift).sum() / n)
        gamma = alpha * beta * (1 - SMOOTH) + SMOOTH / k
        ahead = (beta[1:] / scale[1:, None]).T
        xi = np.stack([(m * ahead) @ alpha[:-1, i] for i, m in enumerate(moves)]) + SMOOTH + pseudo * a_prior
        a = xi / xi.sum(axis=1, keepdims=True)
        a = np.maximum(a, FLOOR)
        a = a / a.sum(axis=1, keepdims=True)
        pi = gamma[0] / gamma[0].sum()
        mass = gamma.sum(axis=0)
        below = (mass + strength)[:, None]
        new_means = (gamma.T @ x + strength * prior_means) / below
        z = (x[None] - new_means[:, None]).swapaxes(1, 2)
        off = prior_means - new_means
        scatter = (z * gamma.T[:, None]) @ z.swapaxes(1, 2) + strength * (prior_covs + off[:, :, None] * off[:, None, :])
        new_covs = scatter / below[:, :, None] + reg * np.eye(d)
        own = mass >= least_mass
        means = np.where(own[:, None], new_means, means)
        covs = np.where(own[:, None, None], new_covs, covs)
        if abs(mean_log - last) < tol:
            break
        last = mean_log
    return means, covs, a, pi, mean_log, i


def bhattacharyya(m1, c1, m2, c2) -> float:
    middle, apart = (c1 + c2) / 2, m1 - m2
    sign, logdet = np.linalg.slogdet(middle)
    if sign <= 0:
        return np.inf
    own = (np.linalg.slogdet(c1)[1] + np.linalg.slogdet(c2)[1]) / 2
    return float(apart @ np.linalg.solve(middle, apart)) / 8 + (logdet - own) / 2


def stationary(a: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(a.T)
    out = np.abs(vectors[:, np.abs(values - 1).argmin()].real)
    return out / out.sum() if np.isfinite(out.sum()) and out.sum() > 0 else np.full(len(a), 1 / len(a))


def by_dispersion(x: np.ndarray, k: int, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Starting components from groups of rows by their distance from the mean, the calmest first."""
    order = np.argsort(((x - x.mean(axis=0)) ** 2).sum(axis=1))
    cuts = np.linspace(0, len(x), k + 1).astype(int)
    groups = [x[order[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    means = np.stack([g.mean(axis=0) for g in groups])
    covs = np.stack([np.cov(g, rowvar=False, ddof=0).reshape(x.shape[1], -1) + reg * np.eye(x.shape[1]) for g in groups])
    return means, covs


def sticky(k: int, p_switch: float) -> np.ndarray:
    if k == 1:
        return np.ones((1, 1))
    return np.where(np.eye(k, dtype=bool), 1 - p_switch, p_switch / (k - 1))


class RegimeStepper:
    """One step per row; batch and stream run the same object."""

    def __init__(
        self, n_regimes=2, window=1008, refit_every=1, p_switch=0.02, switch_threshold=0.6, reg_covar=1e-6, warm_iter=10, init_iter=200,
        tol=1e-6, anchor_rate=None, anchor_min_separation=0.1, anchor_strength=20.0, trans_pseudo=2.0, min_state_mass=2.0,
    ) -> None:
        if not 1 <= n_regimes <= 32:
            raise ValueError(f"n_regimes must be 1 to 32; got {n_regimes}")
        if window < 2 * n_regimes:
            raise ValueError(f"window must be at least {2 * n_regimes}; got {window}")
        if not 0 < p_switch < 1:
            raise ValueError(f"p_switch must be between 0 and 1; got {p_switch}")
        self.k, self.window, self.every = n_regimes, window, refit_every
        self.threshold, self.reg, self.warm, self.first, self.tol = switch_threshold, reg_covar, warm_iter, init_iter, tol
        self.rate = 2.0 / (window + 1) if anchor_rate is None else anchor_rate
        self.apart, self.strength, self.pseudo, self.least = anchor_min_separation, anchor_strength, trans_pseudo, min_state_mass
        self.reference = sticky(n_regimes, p_switch)
        self.rows: np.ndarray | None = None
        self.at, self.label = -1, -1

    def _fit(self, x: np.ndarray, iterations: int, prior: tuple, strength: float) -> None:
        self.means, self.covs, self.a, self.pi, self.log, _ = fit(
            x, self.means, self.covs, self.a, self.pi, iterations=iterations, tol=self.tol, reg=self.reg, pseudo=self.pseudo,
            least_mass=self.least, a_prior=self.reference, prior_means=prior[0], prior_covs=prior[1], strength=strength,
        )

    def _reorder(self, perm: np.ndarray) -> None:
        self.means, self.covs, self.pi, self.a = self.means[perm], self.covs[perm], self.pi[perm], self.a[np.ix_(perm, perm)]

    def add(self, row: np.ndarray) -> dict | None:
        """The step's result, or None while the window fills."""
        row = np.asarray(row, float)[None]
        self.rows = row if self.rows is None else np.concatenate([self.rows[-(self.window - 1) :], row])
        if len(self.rows) < self.window:
            return None
        x = self.rows
        self.at += 1
        relabels = 0
        if self.at == 0:
            self.means, self.covs = by_dispersion(x, self.k, self.reg)
            self.a, self.pi = self.reference.copy(), np.full(self.k, 1 / self.k)
            self._fit(x, self.first, (self.means, self.covs), 0.0)
            self._reorder(np.argsort([np.trace(c) for c in self.covs]))
            self.anchors = self.means.copy(), self.covs.copy()
        elif self.at % self.every == 0:
            self._fit(x, self.warm, self.anchors, self.strength)
            cost = [[bhattacharyya(*one, m, c) for m, c in zip(self.means, self.covs, strict=True)] for one in zip(*self.anchors, strict=True)]
            perm = assignment(np.array(cost))
            relabels = int((perm != np.arange(self.k)).sum())
            if relabels:
                self._reorder(perm)
            pairs = [(i, j) for i in range(self.k) for j in range(i)]
            near = min((bhattacharyya(self.means[i], self.covs[i], self.means[j], self.covs[j]) for i, j in pairs), default=np.inf)
            if near >= self.apart:
                self.anchors = tuple((1 - self.rate) * old + self.rate * new for old, new in zip(self.anchors, (self.means, self.covs), strict=True))
        logs = log_densities(x, self.means, self.covs, self.reg)
        probs = forward(np.exp(logs - logs.max(axis=1, keepdims=True)), self.a, self.pi)[0][-1]
        raw = posterior(x[-1:], self.means, self.covs, np.full(self.k, 1 / self.k), self.reg)[0]
        best, switched = int(probs.argmax()), False
        if self.label < 0:
            self.label = best
        elif best != self.label and probs[best] >= self.threshold:
            self.label, switched = best, True
        return {
            "label": self.label, "probs": probs, "raw_probs": raw, "weights": stationary(self.a), "means": self.means, "covariances": self.covs,
            "transition": self.a, "log_likelihood": self.log, "n_relabels": relabels, "switched": switched,
        }


def selection_row(x: np.ndarray, k: int, reg: float, p_switch: float, iterations: int, tol: float) -> dict:
    """Likelihood and information criteria of a maximum-likelihood fit with ``k`` states."""
    n, d = x.shape
    if not 1 <= k <= 32 or n < 2 * k:
        raise ValueError(f"invalid candidate n_regimes={k} for {n} observations")
    means, covs = by_dispersion(x, k, reg)
    a = sticky(k, p_switch)
    *_, mean_log, _ = fit(
        x, means, covs, a, np.full(k, 1 / k), iterations=iterations, tol=tol, reg=reg, pseudo=0.0, least_mass=2.0, a_prior=a,
        prior_means=means, prior_covs=covs, strength=0.0,
    )
    free = (k - 1) + k * (k - 1) + k * d + k * d * (d + 1) // 2
    log = mean_log * n
    return {"log_likelihood": log, "n_params": free, "aic": 2 * free - 2 * log, "bic": free * np.log(n) - 2 * log}


def mixture_fit(x: np.ndarray, means: np.ndarray, covs: np.ndarray, weights: np.ndarray, iterations: int, tol: float, reg: float):
    """EM of a Gaussian mixture without order in time: new parameters, mean log likelihood, iterations."""
    last, log, i = -np.inf, -np.inf, 0
    for i in range(1, iterations + 1):
        logs = log_densities(x, means, covs, reg) + np.log(weights)
        top = logs.max(axis=1, keepdims=True)
        log = float((top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))).mean())
        gamma = np.exp(logs - top)
        gamma = gamma / gamma.sum(axis=1, keepdims=True) * (1 - SMOOTH) + SMOOTH / len(means)
        mass = gamma.sum(axis=0)
        means = gamma.T @ x / mass[:, None]
        z = x[None] - means[:, None]
        covs = np.einsum("nk,kni,knj->kij", gamma, z, z) / mass[:, None, None] + reg * np.eye(x.shape[1])
        weights = mass / mass.sum()
        if abs(log - last) < tol:
            break
        last = log
    return means, covs, weights, log, i
