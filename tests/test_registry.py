"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from evenkeel.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def same(a, b) -> bool:
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return abs(a - b) <= 2e-6 * (1 + abs(b)) if isinstance(a, float) or isinstance(b, float) else a == b


def ordered(rows: list[tuple]) -> list[tuple]:
    plain = lambda v: (1, "") if v is None or v != v else (0, f"{v:.4f}" if isinstance(v, float) else str(v))
    return sorted(rows, key=lambda r: [plain(v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    a = ordered([tuple(r[c] for c in columns) for r in found.collect()])
    b = ordered([tuple(r[wanted.columns.index(c)] for c in columns) for r in wanted.fetchall()])
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def normal(x: float, mean: float, var: float) -> float:
    import math

    return math.exp(-((x - mean) ** 2) / (2 * var)) / math.sqrt(2 * math.pi * var)


def test_variable_universe_by_hand(spark):
    import numpy as np

    rows, names = registry.daily_series(spark, SF)
    x = np.array([[r[n] if r[n] is not None else np.nan for n in names] for r in rows.orderBy("ts").collect()])
    found = registry.QUERIES["pca_variable_universe"](spark, SF).orderBy("ts").collect()
    assert len(found) == len(x)
    for t in range(19, len(x)):
        window = x[t - 19 : t + 1]
        window = window[:, np.isfinite(window).all(axis=0)]
        assert found[t]["valid"] == (window.shape[1] >= 2)
        if found[t]["valid"]:
            want = np.linalg.eigvalsh(np.cov(window, rowvar=False))[::-1][:2]
            assert np.allclose(sorted(found[t]["eigenvalues"], reverse=True), want, rtol=1e-6, atol=1e-12)


def test_regimes_by_hand(spark):
    """Probabilities of single rows under each step's own parameters, and of all rows under the last ones."""
    steps = registry.QUERIES["regime_steps"](spark, SF).collect()
    rets = {(r["series"], r["ts"]): r["ret"] for r in registry.flags(spark, SF).collect()}
    last = {}
    for r in sorted((r for r in steps if r["label"] >= 0), key=lambda r: r["ts"]):
        p = [normal(rets[r["series"], r["ts"]], m[0], c[0][0] + 1e-8) for m, c in zip(r["means"], r["covariances"], strict=True)]
        assert all(abs(a - b / sum(p)) < 1e-6 for a, b in zip(r["raw_probs"], p, strict=True)) and abs(sum(r["probs"]) - 1) < 1e-9
        last[r["series"]] = r
    for r in registry.QUERIES["regime_predict"](spark, SF).collect():
        p = [normal(r["ret"], m[0], c[0][0] + 1e-8) for m, c in zip(last[r["series"]]["means"], last[r["series"]]["covariances"], strict=True)]
        assert all(abs(a - b / sum(p)) < 1e-6 for a, b in zip(r["probs"], p, strict=True)) and r["label"] == p.index(max(p))


def test_selections_by_hand(spark):
    import math

    import numpy as np

    found = {r["n_regimes"]: r for r in registry.QUERIES["select_n_regimes"](spark, SF).collect()}
    n = registry.market(spark, SF).count()
    for k, r in found.items():
        assert r["n_params"] == (k - 1) + k * (k - 1) + 2 * k
        assert math.isclose(r["aic"], 2 * r["n_params"] - 2 * r["log_likelihood"]) and math.isclose(r["bic"], r["n_params"] * math.log(n) - 2 * r["log_likelihood"])
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().groupby("user_id")["value"].agg(["count", "mean", "max"]).sort_index()
    x = rows.to_numpy(float)
    apart = lambda a, b: float(((a - b) ** 2).sum())
    for r in registry.QUERIES["select_n_clusters"](spark, SF).collect():
        centres = [min(x, key=lambda p: apart(p, x.mean(axis=0)))]
        while len(centres) < r["n_clusters"]:
            centres.append(max(x, key=lambda p: min(apart(p, c) for c in centres)))  # noqa: B023
        for _ in range(300):
            label = [min(range(len(centres)), key=lambda j: apart(p, centres[j])) for p in x]  # noqa: B023
            centres = [x[[i for i, l in enumerate(label) if l == j]].mean(axis=0) for j in range(len(centres))]
        assert math.isclose(r["inertia"], sum(apart(p, centres[l]) for p, l in zip(x, label, strict=True)), rel_tol=1e-9)
        mean = lambda i, j: np.mean([math.sqrt(apart(x[i], x[k])) for k, l in enumerate(label) if l == j and k != i] or [np.nan])  # noqa: B023, E731
        s = []
        for i, l in enumerate(label):
            a, b = mean(i, l), min(mean(i, j) for j in set(label) - {l})
            s.append(0.0 if a != a else (b - a) / max(a, b))
        assert math.isclose(r["silhouette"], float(np.mean(s)), rel_tol=1e-9)
