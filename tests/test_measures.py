from __future__ import annotations

import datetime

import numpy as np
import pytest

from evenkeel.functions import measures as ms
from evenkeel.functions import rolling as ro
from evenkeel.operators.scorecard import Scorecard, checked

DAY = datetime.date(2020, 1, 1)
NAN = float("nan")


def frame(spark, **series):
    rows = [(name, DAY + datetime.timedelta(days=i), None if v is None else float(v)) for name, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts date, ret double").repartition(3)


def one(spark, values, names, benchmark=None, ppy=252):
    bench = None if benchmark is None else frame(spark, b=benchmark).select("ts", "ret")
    return ms.measure_table(frame(spark, a=values), bench, names, ppy).first().asDict()


def close(a, b, tol=1e-9):
    return (a is None and b is None) or abs(a - b) <= tol * (1 + abs(b))


def test_closed_forms(spark):
    row = one(spark, [0.01] * 252, ["total_return", "cagr", "ann_return", "sharpe", "max_drawdown", "hit_rate", "gain_to_pain", "best_period", "skewness", "kurtosis"])
    assert close(row["total_return"], 1.01**252 - 1) and close(row["cagr"], 1.01**252 - 1) and close(row["ann_return"], 2.52)
    assert row["sharpe"] is None or abs(row["sharpe"]) > 1e6  # the deviation of a constant is rounding or nothing
    assert row["max_drawdown"] == 0 and row["hit_rate"] == 1 and row["gain_to_pain"] is None and row["best_period"] == 0.01
    assert row["skewness"] is None or abs(row["skewness"]) < 10


def test_against_numpy(spark):
    r = np.random.default_rng(1).normal(4e-4, 0.01, 900)
    names = [n for n, m in ms.MEASURES.items() if not m.relative]
    row = one(spark, r.tolist(), names)
    wealth = np.cumsum(np.log1p(r))
    dd = np.expm1(wealth - np.maximum.accumulate(wealth))
    down = np.sqrt(np.mean(np.minimum(r, 0) ** 2)) * np.sqrt(252)
    q = np.quantile(r, 0.05, method="inverted_cdf")
    z = r - r.mean()
    want = {
        "total_return": np.expm1(wealth[-1]), "cagr": np.exp(wealth[-1]) ** (252 / 900) - 1, "ann_return": r.mean() * 252, "ann_vol": r.std(ddof=1) * np.sqrt(252),
        "downside_vol": down, "sharpe": r.mean() * np.sqrt(252) / r.std(ddof=1), "sortino": r.mean() * 252 / down, "max_drawdown": dd.min(),
        "calmar": (np.exp(wealth[-1]) ** (252 / 900) - 1) / abs(dd.min()), "var_hist": -q, "cvar_hist": -r[r <= q].mean(), "skewness": (z**3).mean() / (z**2).mean() ** 1.5,
        "kurtosis": (z**4).mean() / (z**2).mean() ** 2 - 3, "hit_rate": (r > 0).mean(), "gain_to_pain": r[r > 0].sum() / -r[r < 0].sum(), "best_period": r.max(), "worst_period": r.min(),
    }
    assert set(want) == set(names)
    assert all(close(row[n], want[n]) for n in names), {n: (row[n], want[n]) for n in names if not close(row[n], want[n])}


def test_drawdown_starts_at_the_first_value(spark):
    rows = ms.prepared(frame(spark, a=[0.10, -0.50, 0.10], b=[-0.5, 0.1, 0.1]), needs=frozenset(("path",))).orderBy("series", "ts").collect()
    assert [round(r["dd"], 12) for r in rows] == [0, -0.5, -0.45, 0, 0, 0]


def test_wipe_outs(spark):
    assert one(spark, [0.1, -1.0, 0.2], ["total_return", "max_drawdown", "cagr"]) == {"series": "a", "total_return": -1.0, "max_drawdown": -1.0, "cagr": None}
    row = one(spark, [-1.0, 0.1], ["total_return", "max_drawdown"])
    assert row["total_return"] == -1.0 and row["max_drawdown"] is None


def test_missing_values(spark):
    row = one(spark, [0.01, NAN, 0.02, None, -0.01], ["hit_rate", "ann_return", "total_return", "downside_vol"])
    assert close(row["hit_rate"], 2 / 3) and close(row["ann_return"], 0.02 / 3 * 252)
    assert close(row["total_return"], 1.01 * 1.02 * 0.99 - 1) and close(row["downside_vol"], np.sqrt(0.0001 / 3) * np.sqrt(252))
    row = one(spark, [None, NAN], list(n for n, m in ms.MEASURES.items() if not m.relative))
    assert row.pop("total_return") == 0 and row.pop("max_drawdown") == 0 and set(row.values()) == {"a", None}


def test_single_rows_and_empty_tables(spark):
    row = one(spark, [0.05], ["ann_vol", "sharpe", "var_hist", "skewness"])
    assert row["ann_vol"] is None and row["sharpe"] is None and row["var_hist"] == -0.05 and row["skewness"] is None
    assert ms.measure_table(frame(spark, a=[0.1]).where("false"), None, ["cagr", "max_drawdown", "cvar_hist"]).count() == 0


def test_value_at_risk(spark):
    row = one(spark, [0.01] * 95 + [-0.10] * 5, ["var_hist", "cvar_hist"])
    assert close(row["var_hist"], 0.10) and close(row["cvar_hist"], 0.10)


def test_leveraged_benchmark(spark):
    b = np.random.default_rng(2).normal(3e-4, 0.01, 500)
    row = one(spark, (2 * b).tolist(), ["beta", "alpha", "correlation", "active_return", "tracking_error", "information_ratio", "up_capture"], b.tolist())
    assert close(row["beta"], 2) and close(row["correlation"], 1) and abs(row["alpha"]) < 1e-9
    assert close(row["active_return"], b.mean() * 252) and close(row["tracking_error"], b.std(ddof=1) * np.sqrt(252))
    up = b > 0
    growth = lambda x: np.exp(np.log1p(x[up]).sum() / up.sum()) - 1
    assert close(row["up_capture"], growth(2 * b) / growth(b))


def test_gaps_are_not_pairwise(spark):
    b, r = np.array([0.01, -0.02, 0.03, 0.01]), np.array([0.02, NAN, 0.01, -0.01])
    row = one(spark, r.tolist(), ["beta", "correlation", "up_capture", "down_capture"], b.tolist())
    rm, bm = r - np.nanmean(r), b - b.mean()
    assert close(row["beta"], np.nanmean(rm * bm) / np.mean(bm**2))
    assert close(row["correlation"], np.nanmean(rm * bm) / np.sqrt(np.nanmean(rm**2) * np.mean(bm**2)))
    up = b > 0
    assert close(row["up_capture"], (np.exp(np.nansum(np.log1p(r[up])) / 3) - 1) / (np.exp(np.log1p(b[up]).sum() / 3) - 1))
    assert close(row["down_capture"], 0.0)


def test_constant_benchmarks(spark):
    row = one(spark, [0.01, 0.02, -0.01], ["beta", "correlation", "down_capture"], [0.5, 0.5, 0.5])
    assert row["beta"] is None and row["correlation"] is None and row["down_capture"] is None


def test_relative_measures_need_a_benchmark(spark):
    with pytest.raises(ValueError):
        ms.measure_table(frame(spark, a=[0.1]), None, ["beta"])


def test_rolling(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(3).normal(size=30)
    rows = frame(spark, a=x.tolist(), b=x[:4].tolist())
    g, c = ["series"], F.col("ret")
    found = rows.select("series", "ts", ro.rolling_mean(c, g, "ts", 5).alias("m"), ro.rolling_vol(c, g, "ts", 5, 12).alias("v"), ro.rolling_sharpe(c, g, "ts", 5, 0.1, 12).alias("s")).orderBy("series", "ts").collect()
    for i, r in enumerate(found[:30]):
        win = x[i - 4 : i + 1]
        want = (None,) * 3 if i < 4 else (win.mean(), win.std(ddof=1) * np.sqrt(12), (win.mean() - 0.1 / 12) * np.sqrt(12) / win.std(ddof=1))
        assert all(close(a, b) for a, b in zip(r[2:], want, strict=True))
    assert all(r["m"] is None for r in found[30:])
    with pytest.raises(ValueError):
        ro.rolling_mean(c, g, "ts", 0)


def test_scorecard_ranks(spark):
    random = np.random.default_rng(0)
    target = random.normal(4e-4, 0.01, 800)
    funds = {"same": target, "better": target + 3e-4, "worse": target - 3e-4 + random.normal(0, 0.004, 800)}
    returns, aim = frame(spark, **funds), frame(spark, t=target).select("ts", "ret")
    card = Scorecard()
    values, summary = card.compare(returns, aim)
    order = [r["asset"] for r in summary.orderBy("rank").collect()]
    assert order == ["better", "same", "worse"]
    found = {(r["asset"], r["measure"]): r for r in values.collect()}
    assert len(found) == 3 * 13 and abs(found["same", "cagr"]["score"]) < 1e-9 and found["same", "up_capture"]["target_value"] == 1.0
    assert found["worse", "ann_vol"]["score"] < 0 < found["better", "cagr"]["score"]
    assert card.frame(values).count() == 3
    weighted = Scorecard(weights={n: 0.0 for n in card.measures} | {"ann_vol": 1.0})
    assert [r["asset"] for r in weighted.compare(returns, aim)[1].orderBy("rank").collect()][-1] == "worse"


def test_scorecard_errors(spark):
    for bad in ({"cagr": -1.0}, {n: 0.0 for n in Scorecard().measures}):
        with pytest.raises(ValueError):
            Scorecard(weights=bad)
    returns, target = frame(spark, a=[0.1, 0.2]), frame(spark, t=[0.1, 0.2]).select("ts", "ret")
    checked(returns, target, names=["a"])
    for args in ((returns, target.union(target)), (returns, target.limit(1)), (returns, target, "ts", "series", ["b"])):
        with pytest.raises(ValueError):
            checked(*args)


def test_custom_measures(spark):
    from pyspark.sql import functions as F

    own = {"median": ms.Measure(lambda: F.expr("percentile(r, 0.5)")), "cagr": ms.MEASURES["cagr"]}
    values = Scorecard(own, ppy=12).values(frame(spark, a=[0.1, 0.3, 0.2]), frame(spark, t=[0.1, 0.1, 0.1]).select("ts", "ret"))
    assert {r["measure"]: round(r["score"], 6) for r in values.collect()}["median"] == 1.0


def test_ranks_over_ranges_are_those_of_one_window(spark):
    from evenkeel.operators.scorecard import ranked

    rows = [(f"a{i}", None if i % 11 == 0 else float(i * 37 % 50)) for i in range(700)]
    got = {r["asset"]: r["rank"] for r in ranked(spark.createDataFrame(rows, "asset string, x double").repartition(3), "x", "asset").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {a: i + 1 for i, (a, _) in enumerate(want)}
    assert ranked(spark.createDataFrame([], "asset string, x double"), "x", "asset").count() == 0
    assert {r["rank"] for r in ranked(spark.createDataFrame([("b", None), ("a", None)], "asset string, x double"), "x", "asset").collect()} == {1, 2}


def test_comparison_checks_its_times(spark):
    from evenkeel.operators.scorecard import Scorecard

    returns = spark.createDataFrame([("a", t, 0.01 * t) for t in range(1, 6)], "series string, ts int, ret double")
    target = returns.select("ts", "ret")
    Scorecard().compare(returns, target, names=["a"])
    for bad in ({"target": target.where("ts < 4")}, {"target": target.unionByName(target)}, {"names": ["b"]}):
        with pytest.raises(ValueError):
            Scorecard().compare(**({"returns": returns, "target": target} | bad))
