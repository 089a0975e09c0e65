from __future__ import annotations

import itertools

import numpy as np
import pytest

from evenkeel.kernels import clusters, hmm, matching, moments


@pytest.mark.parametrize("n", range(1, 7))
def test_assignment_is_the_best_of_all(n):
    for seed in range(30):
        cost = np.random.default_rng(seed).normal(size=(n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        found = matching.assignment(cost)
        assert sorted(found) == list(range(n)) and abs(cost[np.arange(n), found].sum() - best) < 1e-12


def test_assignment_with_infinite_costs():
    cost = np.array([[np.inf, 1.0], [2.0, np.inf]])
    assert matching.assignment(cost).tolist() == [1, 0]
    assert sorted(matching.assignment(np.full((3, 3), np.inf))) == [0, 1, 2]


@pytest.mark.parametrize("method", ["hungarian", "greedy"])
def test_order_and_signs_are_recovered(method):
    random = np.random.default_rng(0)
    basis, _ = np.linalg.qr(random.normal(size=(8, 4)))
    perm, signs = np.array([2, 0, 3, 1]), np.array([1, -1, -1, 1.0])
    shuffled = np.empty_like(basis)
    shuffled[:, perm] = basis * signs
    found, turned, size = matching.match_step(basis, shuffled, method)
    assert (found == perm).all() and (turned == signs).all() and np.allclose(size, 1)


def test_unknown_method():
    with pytest.raises(ValueError):
        matching.match_step(np.eye(2), np.eye(2), "best")


def test_signs():
    v = np.array([[0.1, -0.9, 0.0], [-0.8, 0.2, 0.0]])
    assert np.allclose(matching.canonical_signs(v), [[-0.1, 0.9, 0], [0.8, -0.2, 0]])


def test_chain_passes_over_gaps_and_restarts_without_shared_features():
    values, vectors = np.full((4, 2), np.nan), np.full((4, 4, 2), np.nan)
    one = np.linalg.qr(np.random.default_rng(1).normal(size=(2, 2)))[0]
    values[0] = values[2] = values[3] = [2.0, 1.0]
    vectors[0, :2], vectors[2, :2], vectors[3, 2:] = one, -one, one
    _, out, similarity, flips, _ = matching.align_sequence(values, vectors)
    kept = (matching.canonical_signs(one) == one).all(axis=0)
    assert np.allclose(out[0, :2], out[2, :2]) and flips[2] == kept.sum() and np.allclose(similarity[2], 1)
    assert np.isnan(similarity[3]).all() and np.allclose(out[3, 2:], matching.canonical_signs(one))


@pytest.mark.parametrize("corr", [False, True])
def test_window_eigenvalues_are_numpys(corr):
    x = np.random.default_rng(2).normal(size=(90, 5)) * [1, 2, 3, 4, 5] + 1000
    ends = np.arange(19, 90)
    values, vectors, means, total = moments.flat_windows(x[None], ends, 20, 3, corr, 1)
    for i, t in enumerate(ends):
        win = x[t - 19 : t + 1]
        cov = np.corrcoef(win, rowvar=False) if corr else np.cov(win, rowvar=False)
        assert np.allclose(values[i], np.linalg.eigvalsh(cov)[::-1][:3], rtol=1e-8)
        assert np.isclose(total[i], np.trace(cov)) and np.allclose(means[0, i], win.mean(axis=0))
        assert np.allclose(cov @ vectors[i], vectors[i] * values[i], atol=1e-7 * np.trace(cov))


def test_constant_features_have_no_correlation():
    cov = np.array([[1.0, 0.0], [0.0, 0.0]])
    assert moments.correlation(cov).tolist() == [[1.0, 0.0], [0.0, 0.0]]


def test_decayed_moments_are_weighted_ones():
    x = np.random.default_rng(3).normal(size=(40, 3))
    sums = moments.Decayed(1, 3, 7.0)
    for row in x:
        mean, cov = sums.add(row[None])
    w = 0.5 ** (np.arange(39, -1, -1) / 7.0)
    w /= w.sum()
    m = w @ x
    assert np.allclose(mean[0], m) and np.allclose(cov, (x - m).T @ ((x - m) * w[:, None]))


def test_warm_subspace_agrees_with_the_exact_solver():
    random = np.random.default_rng(4)
    a = random.normal(size=(60, 60))
    cov = a @ np.diag(np.r_[[900, 400, 100], np.ones(57)]) @ a.T / 60
    values, vectors, _ = moments.leading(cov, 3)
    near = np.linalg.qr(vectors + 0.02 * random.normal(size=vectors.shape))[0]
    found = moments.warm_subspace(cov.__matmul__, near, 1e-6, steps=60)
    assert found is not None and np.allclose(found[0], values, rtol=1e-5)


def loop_passes(b, a, pi):
    n, k = b.shape
    alpha, scale, beta = np.empty((n, k)), np.empty(n), np.ones((n, k))
    for t in range(n):
        row = (pi if t == 0 else alpha[t - 1] @ a) * b[t]
        scale[t], alpha[t] = row.sum(), row / row.sum()
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    return alpha, scale, beta


@pytest.mark.parametrize("n,k", [(1, 2), (2, 2), (37, 3), (300, 2), (751, 4)])
def test_scans_equal_loops(n, k):
    random = np.random.default_rng(n)
    b = np.exp(-random.exponential(30, size=(n, k)))
    b /= b.max(axis=1, keepdims=True)
    a = random.dirichlet(np.ones(k), k) * 0.1 + 0.9 * np.eye(k)
    pi = np.full(k, 1 / k)
    alpha, scale, beta = loop_passes(b, a, pi)
    got_alpha, got_scale, moves = hmm.forward(b, a, pi)
    assert np.allclose(got_alpha, alpha, atol=1e-10) and np.allclose(got_scale, scale, rtol=1e-8)
    assert np.allclose(hmm.backward(got_alpha, moves), beta, rtol=1e-6, atol=1e-10)


def test_likelihood_grows_and_rows_are_stochastic():
    random = np.random.default_rng(6)
    x = np.concatenate([random.normal(0, 0.5, (150, 2)), random.normal(1, 2.0, (150, 2))])
    means, covs = hmm.by_dispersion(x, 2, 1e-6)
    a, pi, logs = hmm.sticky(2, 0.02), np.full(2, 0.5), []
    for _ in range(12):
        means, covs, a, pi, log, _ = hmm.fit(x, means, covs, a, pi, iterations=1, tol=0, reg=1e-6, pseudo=0.0, least_mass=0.0, a_prior=a, prior_means=means, prior_covs=covs, strength=0.0)
        logs.append(log)
        assert np.allclose(a.sum(axis=1), 1) and np.isclose(pi.sum(), 1)
    assert (np.diff(logs) > -1e-4).all() and logs[-1] > logs[0]


def regimes(n=700, seed=3):
    random = np.random.default_rng(seed)
    state = np.concatenate([[0], np.cumsum(random.random(n - 1) > 0.99)]) % 2
    return np.where(state == 0, 8e-4, -6e-4)[:, None] + np.where(state == 0, 0.006, 0.025)[:, None] * random.standard_normal((n, 3)), state


def test_regimes_are_found_without_relabels():
    x, state = regimes()
    stepper = hmm.RegimeStepper(window=250, refit_every=5)
    found = [stepper.add(row) for row in x]
    assert found[248] is None and found[249] is not None
    label = np.array([f["label"] for f in found[249:]])
    assert (label == state[249:]).mean() > 0.9 and sum(f["n_relabels"] for f in found[249:]) == 0
    assert not found[249]["switched"]


def test_one_regime_and_bad_settings():
    x, _ = regimes(60)
    found = [hmm.RegimeStepper(n_regimes=1, window=30).add(row) for row in x[:1]]
    assert found == [None]
    for bad in ({"n_regimes": 0}, {"n_regimes": 33}, {"window": 3}, {"p_switch": 0.0}, {"p_switch": 1.0}):
        with pytest.raises(ValueError):
            hmm.RegimeStepper(**bad)


def test_hysteresis_switches_less_with_a_higher_threshold():
    x, _ = regimes(500, 8)
    counts = []
    for threshold in (0.5, 0.9):
        stepper = hmm.RegimeStepper(window=200, refit_every=10, switch_threshold=threshold)
        counts.append(sum(f["switched"] for f in map(stepper.add, x) if f))
    assert counts[1] <= counts[0]


def test_mixture_finds_two_groups():
    random = np.random.default_rng(1)
    x = np.concatenate([random.normal(-3, 1, (100, 1)), random.normal(3, 1, (100, 1))])
    means, _, weights, _, _ = hmm.mixture_fit(x, np.array([[-1.0], [1.0]]), np.ones((2, 1, 1)), np.full(2, 0.5), 100, 1e-9, 1e-6)
    assert np.allclose(np.sort(means.ravel()), [-3, 3], atol=0.4) and np.allclose(weights, 0.5, atol=0.05)


def blobs(n=60, seed=0):
    random = np.random.default_rng(seed)
    centres = np.array([[0.0, 0], [6, 0], [0, 6]])
    return centres[np.arange(n) % 3] + 0.3 * random.standard_normal((n, 2))


def test_lloyd_ties_and_empty_clusters():
    x = np.array([[0.0], [0.0], [10.0], [11.0]])
    centres, label, inertia, _ = clusters.lloyd(x, np.array([[0.0], [100.0], [200.0]]), 50, 1e-9)
    assert len(set(label.tolist())) == 3 and inertia <= 0.5
    assert clusters.squared_distances(np.array([[1.0]]), np.array([[0.0], [2.0]])).argmin(axis=1).tolist() == [0]


def test_farthest_first():
    x = np.array([[0.0], [1.0], [10.0], [4.0]])
    assert clusters.farthest_first(x, 3).ravel().tolist() == [4.0, 10.0, 0.0]


@pytest.mark.parametrize("init", ["maxmin", "k-means++"])
def test_static_data_stays(init):
    stepper, entities = clusters.KMeansStepper(init=init, seed=1), [f"e{i}" for i in range(60)]
    found = [stepper.step(entities, blobs()) for _ in range(10)]
    assert found[0]["n_iter"] == 0
    assert all((f["label"] == found[0]["label"]).all() and not any(f["switched"]) and f["n_relabels"] == 0 for f in found)


def test_memory_keeps_places_of_the_past():
    entities = [f"e{i}" for i in range(60)]
    long, short = clusters.KMeansStepper(2, centroid_memory=30), clusters.KMeansStepper(2, centroid_memory=1)
    random = np.random.default_rng(5)
    for t in range(30):
        a = np.array([8.0 * t / 29, 0]) + 0.1 * random.standard_normal((30, 2))
        b = np.array([4.0, 6]) + 0.1 * random.standard_normal((30, 2))
        x = np.concatenate([a, b])
        x[0] = [0.5, 0.0]
        one, two = long.step(entities, x), short.step(entities, x)
    assert one["dist2"][0] < 1.0 < two["dist2"][0]


def test_kmeans_errors():
    for bad in ({"centroid_memory": 0}, {"init": "random"}, {"n_clusters": 0}):
        with pytest.raises(ValueError):
            clusters.KMeansStepper(**bad)
    with pytest.raises(ValueError):
        clusters.KMeansStepper(3).step(["a"], np.zeros((1, 2)))
    with pytest.raises(ValueError):
        clusters.KMeansStepper(1).step(["a"], np.array([[np.nan]]))


@pytest.mark.parametrize("scale", [False, True])
def test_procrustes_undoes_rigid_motions(scale):
    random = np.random.default_rng(2)
    x = random.normal(size=(40, 2))
    turn = np.array([[np.cos(1.1), -np.sin(1.1)], [np.sin(1.1), np.cos(1.1)]]) @ np.diag([1, -1])
    moved = (x @ turn + [3, -2]) * (2.5 if scale else 1)
    aligned, disparity, _ = clusters.procrustes_align(x, moved, scale)
    assert np.allclose(aligned, x) and disparity < 1e-9


def test_embedding_static_newcomers_and_backends():
    x, names = blobs(30, 4), [f"e{i}" for i in range(30)]
    stepper = clusters.EmbeddingStepper()
    first = stepper.step(names, x)
    again = stepper.step(names, x)
    assert np.allclose(first["coords"], again["coords"]) and again["disparity"] < 1e-9 and np.isnan(first["disparity"])
    fewer = stepper.step(names[:20], x[:20])
    back = stepper.step(names, x)
    assert np.isfinite(fewer["displacement"]).all() and np.isnan(back["displacement"][20:]).all()
    given = []
    own = clusters.EmbeddingStepper(2, lambda x, start: given.append(start) or x[:, ::-1])
    own.step(names[:10], x[:10])
    own.step(names[:12], x[:12])
    assert given[0] is None and given[1].shape == (12, 2)
    with pytest.raises(ValueError):
        clusters.EmbeddingStepper(2, "unknown")
    with pytest.raises(ValueError):
        clusters.EmbeddingStepper(2, lambda x, start: x[:, :1]).step(names, x)
    with pytest.raises(ValueError):
        clusters.EmbeddingStepper(3).step(names, x)


def test_selection_rows():
    x, _ = regimes(600, 11)
    rows = {k: hmm.selection_row(x * 100, k, 1e-6, 0.02, 300, 1e-8) for k in (1, 2)}
    assert rows[2]["bic"] < rows[1]["bic"] and rows[1]["n_params"] == 9
    with pytest.raises(ValueError):
        hmm.selection_row(x[:3], 2, 1e-6, 0.02, 10, 1e-8)


@pytest.mark.parametrize("corr", [False, True])
def test_subspace_windows_agree_with_exact_ones(corr):
    random = np.random.default_rng(6)
    x = random.normal(size=(260, 4)) @ random.normal(size=(4, 70)) * [3.0] + 0.3 * random.normal(size=(260, 70)) + 50
    ends = np.r_[np.arange(99, 180), np.arange(200, 260)]  # with a gap
    exact = moments.flat_windows(x[None], ends, 100, 3, corr, 1, refresh_every=7)
    warm = moments.flat_windows(x[None], ends, 100, 3, corr, 1, refresh_every=50, tol=1e-9)
    assert np.allclose(exact[0], warm[0], rtol=1e-6) and np.allclose(exact[3], warm[3]) and np.allclose(exact[2], warm[2])
    cosines = np.abs(np.einsum("tdp,tdp->tp", exact[1], warm[1]))
    assert cosines.min() > 1 - 1e-6
    assert np.allclose(exact[0], moments.flat_windows(x[None], ends, 100, 3, corr, 1, refresh_every=1)[0])


def test_pieces_hold_bounded_matrices():
    runs = moments.pieces(np.r_[np.arange(10), np.arange(20, 30)], 1000, 1024)
    assert max(map(len, runs)) == moments.ENTRIES // 1000**2 and sum(map(len, runs)) == 20
    assert all((np.diff(np.r_[np.arange(10), np.arange(20, 30)][r]) == 1).all() for r in runs)
