from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.kernels.hmm import RegimeStepper
from evenkeel.operators import models, select, summaries
from evenkeel.sources import panels, simulate
from evenkeel.streaming import updates


def factors(n=130, d=5, seed=0):
    random = np.random.default_rng(seed)
    return random.normal(size=(n, 3)) * [5, 2.5, 1.2] @ random.normal(size=(3, d)) + 0.1 * random.normal(size=(n, d))


def frame(spark, panels_, parts=3):
    rows = [(g, t, *map(float, row)) for g, x in panels_.items() for t, row in enumerate(x)]
    d = next(iter(panels_.values())).shape[1]
    return spark.createDataFrame(rows, "g string, ts int, " + ", ".join(f"f{i} double" for i in range(d))).orderBy(F.rand(1)).repartition(parts)


NAMES = [f"f{i}" for i in range(5)]


def test_pca_blocks_groups_and_order(spark):
    data = {"a": factors(seed=1), "b": factors(60, seed=2)}
    whole = models.rolling_pca(frame(spark, data), ["g"], "ts", NAMES, 20, 3).orderBy("g", "ts").collect()
    small = models.rolling_pca(frame(spark, data, 5), ["g"], "ts", NAMES, 20, 3, block=20).orderBy("g", "ts").collect()
    assert len(whole) == 190
    for r, s in zip(whole, small, strict=True):
        x = data[r["g"]]
        t = r["ts"]
        assert r["valid"] == (t >= 19) and (r["eigenvalues"][0] is None) == (t < 19)
        if t >= 19:
            win = x[t - 19 : t + 1]
            assert np.allclose(r["eigenvalues"], sorted(np.linalg.eigvalsh(np.cov(win, rowvar=False)))[::-1][:3], rtol=1e-7) or r["n_reorders"]
            assert np.allclose(r["projections"], (x[t] - win.mean(axis=0)) @ np.array(r["components"]).T)
            assert np.allclose(r["components"], s["components"], atol=1e-6) and np.isclose(sum(r["explained_variance_ratio"]), sum(r["eigenvalues"]) / r["total_variance"])


def test_rotating_cloud_has_no_flips(spark):
    rows = simulate.rotating_cloud(spark, 600, 0.02, (5.0, 0.3), seed=1).withColumn("g", F.lit("x"))
    out = models.rolling_pca(rows, ["g"], "step", ["x0", "x1"], 40, 1).where("valid").orderBy("ts").collect()
    v = np.array([r["components"][0] for r in out])
    assert ((v[1:] * v[:-1]).sum(axis=1) > 0.9).all() and min(r["similarity"][0] for r in out[1:]) > 0.9


def test_pca_variable_universe(spark):
    x = factors(120)
    x[:50, 4], x[90:, 0] = np.nan, np.nan
    out = models.rolling_pca(frame(spark, {"a": x}), ["g"], "ts", NAMES, 20, 2, block=25).orderBy("ts").collect()
    on = [[c is not None for c in r["components"][0]] if r["valid"] else None for r in out]
    assert on[60] == [True] * 4 + [False] and on[69] == [True] * 5 and on[90] == [False] + [True] * 4
    win = x[41:61, :4]
    assert np.allclose(out[60]["eigenvalues"], np.linalg.eigvalsh(np.cov(win, rowvar=False))[::-1][:2], rtol=1e-7)


def test_pca_correlation_and_decay(spark):
    x = factors(70)
    corr = models.rolling_pca(frame(spark, {"a": x}), ["g"], "ts", NAMES, 20, 5, corr=True).where("valid").collect()
    assert all(np.isclose(r["total_variance"], 5) and np.isclose(sum(r["eigenvalues"]), 5) for r in corr)
    exact, warm = (models.rolling_pca(frame(spark, {"a": x}), ["g"], "ts", NAMES, 15, 1, halflife=10.0, solver=s).orderBy("ts").collect() for s in ("exact", "subspace"))
    w = 0.5 ** (np.arange(69, -1, -1) / 10.0)
    w /= w.sum()
    z = x - w @ x
    assert np.isclose(exact[69]["eigenvalues"][0], np.linalg.eigvalsh(z.T @ (z * w[:, None]))[-1])
    assert all(np.isclose(a["eigenvalues"][0], b["eigenvalues"][0], rtol=1e-6) for a, b in zip(exact[14:], warm[14:], strict=True))


def test_pca_errors(spark):
    df = frame(spark, {"a": factors(30)})
    for bad in ({"n_components": 6}, {"n_components": 0}, {"window": 1}, {"window": 5, "ddof": 5}, {"solver": "x"}, {"halflife": 0.0}, {"matching": "x"}):
        with pytest.raises(ValueError):
            models.rolling_pca(df, ["g"], "ts", NAMES, **({"window": 10, "n_components": 2} | bad))


def test_item_panels_share_a_basis(spark):
    random = np.random.default_rng(3)
    items = {f"i{k}": np.cumsum(random.normal(size=(50, 3)), axis=0) for k in range(3)}
    rows = [("g", k, t, *map(float, row)) for k, x in items.items() for t, row in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, item string, ts int, f0 double, f1 double, f2 double")
    out = models.panel_pca(df, ["g"], "item", "ts", ["f0", "f1", "f2"], 15, 2).collect()
    assert len(out) == 3 * 36
    cov = np.mean([np.cov(x[35:50], rowvar=False) for x in items.values()], axis=0)
    last = [r for r in out if r["ts"] == 49]
    assert all(np.allclose(sorted(r["eigenvalues"]), np.linalg.eigvalsh(cov)[-2:]) for r in last)


def test_projection_of_new_rows(spark):
    x = factors(40)
    df = frame(spark, {"a": x})
    steps = models.rolling_pca(df, ["g"], "ts", NAMES, 20, 2)
    last = steps.orderBy(F.desc("ts")).first()
    got = models.project(steps, df, ["g"], NAMES).orderBy("ts").collect()
    want = (x - np.array(last["means"])) @ np.array(last["components"]).T
    assert np.allclose([r["projections"] for r in got], want)


def test_regimes_equal_the_stepper(spark):
    rows = simulate.regime_returns(spark, 260, 2, 0.97, seed=4)
    x = rows.orderBy("step").toPandas()[["a0", "a1"]].to_numpy()
    df = rows.crossJoin(spark.createDataFrame([("p",), ("q",)], "g string")).repartition(4)
    settings = {"n_regimes": 2, "window": 120, "refit_every": 10}
    out = models.rolling_regimes(df, ["g"], "step", ["a0", "a1"], **settings).orderBy("g", "ts").collect()
    stepper = RegimeStepper(**settings)
    want = [stepper.add(row) for row in x]
    for k in range(2):
        for r, w in zip(out[260 * k : 260 * (k + 1)], want, strict=True):
            assert r["label"] == (-1 if w is None else w["label"])
            assert w is None or np.allclose(r["probs"], w["probs"])
    steps = models.rolling_regimes(df, ["g"], "step", ["a0", "a1"], **settings)
    judged = models.predict_regimes(steps, df.select("g", "step", "a0", "a1"), ["g"], ["a0", "a1"]).collect()
    assert len(judged) == 520 and all(abs(sum(r["probs"]) - 1) < 1e-9 and r["label"] == int(np.argmax(r["probs"])) for r in judged)


def test_blobs_keep_their_identity(spark):
    rows = simulate.drifting_blobs(spark, 25, 60, seed=2).withColumn("g", F.lit("x"))
    out = models.rolling_kmeans(rows, ["g"], "period", "entity", ["f0", "f1"], n_clusters=3)
    assert out.where("switched").count() == 0 and out.agg(F.sum("n_relabels")).first()[0] == 0
    truth = out.join(rows.select("period", "entity", "membership").withColumn("entity", F.col("entity").cast("string")), ["period", "entity"])
    assert truth.select("label", "membership").distinct().count() == 3
    assert models.kmeans_steps(out).count() == 25


def test_unbalanced_panels(spark):
    rows = simulate.drifting_blobs(spark, 12, 30, seed=5).withColumn("g", F.lit("x")).where("not (entity = 'e0003' and period between 4 and 6) and not (entity = 'e0007' and period < 5)")
    out = models.rolling_kmeans(rows, ["g"], "period", "entity", ["f0", "f1"], n_clusters=3).cache()
    assert out.count() == 30 * 12 - 3 - 5
    wide = summaries.labels_frame(out).orderBy("period").collect()
    assert wide[4]["e0003"] == -1 and wide[7]["e0003"] >= 0
    summary = {r["label"]: r for r in summaries.cluster_summary(out).collect()}
    assert sum(r["moves_in"] for r in summary.values()) == 2 and abs(sum(r["share"] for r in summary.values()) - 1) < 1e-12
    coords = models.rolling_embedding(rows, ["g"], "period", "entity", ["f0", "f1"], 2).cache()
    back = {r["period"]: r for r in models.trajectory(coords, "e0003").collect()}
    assert back[7]["displacement"] is None and back[8]["displacement"] is not None and 5 not in back
    assert models.embedding_frame(coords, 0).count() == 29


def test_linear_embedding_keeps_rows_apart_and_agrees_with_the_stepper(spark):
    random = np.random.default_rng(7)
    rows = [(g, t, f"e{e}", *map(float, random.normal(size=3) * [5, 2, 1] + e % 7)) for g in ("a", None) for t in (0, 1, 3, 4, 9) for e in range(90 if t != 4 else 3) if random.random() < 0.8 or t == 4]
    rows += [("b", 0, "one", 1.0, 2.0, 3.0), ("b", 1, "one", 2.0, 2.0, 3.0), ("a", None, "e1", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, t int, e string, x double, y double, z double").repartition(4)
    for scale in (False, True):
        found = models.rolling_embedding(df, ["g"], "t", "e", ["x", "y", "z"], 2, scale=scale)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan  # rows of a group never meet in one task
        got = {(r["g"], r["period"], r["entity"]): r for r in found.collect()}
        want = models.rolling_embedding(df, ["g"], "t", "e", ["x", "y", "z"], 2, scale=scale, with_state=True).collect()
        assert len(got) == len(want) == len(rows) - 1
        for w in want:
            r = got[w["g"], w["period"], w["entity"]]
            assert np.allclose(r["coords"], w["coords"], atol=1e-9)
            for c in ("displacement", "disparity"):
                assert (r[c] is None) == (w[c] is None) and (w[c] is None or abs(r[c] - w[c]) < 1e-9)
    with pytest.raises(Exception, match="features must be finite"):
        models.rolling_embedding(df.withColumn("x", F.lit(None).cast("double")), ["g"], "t", "e", ["x", "y"], 2).collect()


def test_selection(spark):
    rows = simulate.drifting_blobs(spark, 1, 60, seed=1)
    best = select.select_n_clusters(rows, "entity", ["f0", "f1"], (2, 3, 4)).orderBy(F.desc("silhouette")).first()
    assert best["n_clusters"] == 3
    two = simulate.regime_returns(spark, 700, 2, 0.98, seed=3).select("step", *((F.col(c) * 100).alias(c) for c in ("a0", "a1")))
    assert select.select_n_regimes(two, "step", ["a0", "a1"], (1, 2)).orderBy("bic").first()["n_regimes"] == 2


def test_spells_and_summary(spark):
    rows = [("g", t, v, float(t)) for t, v in enumerate([-1, -1, 0, 0, 1, 0, 0, 0])]
    df = spark.createDataFrame(rows, "g string, ts int, label long, x double")
    runs = [(r["label"], r["length"]) for r in summaries.spells(df, ["g"], "ts").orderBy("start").collect()]
    assert runs == [(-1, 2), (0, 2), (1, 1), (0, 3)]
    found = {r["label"]: r for r in summaries.regime_summary(df, ["g"], "ts", ["x"]).collect()}
    assert found[0]["avg_spell"] == 2.5 and found[0]["n_spells"] == 2 and abs(found[0]["share"] - 5 / 6) < 1e-12 and found[1]["std_x"] is None


def test_shapes_and_checks(spark):
    wide = spark.createDataFrame([(1, 0.1, float("nan")), (2, None, 0.2)], "ts int, a double, b double")
    long = panels.melted(wide, ["ts"])
    assert {(r["ts"], r["series"]): r["ret"] for r in long.collect()} == {(1, "a"): 0.1, (1, "b"): None, (2, "a"): None, (2, "b"): 0.2}
    assert panels.pivoted(long, "ts", "series", "ret").count() == 2
    with pytest.raises(Exception, match="missing feature"):
        panels.require_finite(wide, ["a", "b"], "ts").collect()
    panel = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "period int, entity string")
    with pytest.raises(ValueError):
        panels.require_balanced(panel, "period", "entity")
    panels.require_balanced(panel.where("period = 1"), "period", "entity")


def stream(spark, tmp_path, df, build, batches):
    """Run a query over files that arrive one after another."""
    source, out = tmp_path / "in", tmp_path / "out"
    for i, part in enumerate(batches):
        part.coalesce(1).write.parquet(f"{source}/b{i}")
        files = spark.readStream.schema(df.schema).parquet(f"{source}/*")
        q = build(files).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(out))


def test_streams_equal_batches_by_row(spark, tmp_path):
    x = factors(40)
    df = frame(spark, {"a": x, "b": factors(40, seed=9)})
    batches = [df.where("ts < 15"), df.where("ts between 15 and 16 or ts = 3"), df.where("ts > 16")]
    got = stream(spark, tmp_path / "pca", df, lambda s: updates.update_pca(s, "g", "ts", NAMES, 12, 2), batches).orderBy("group", "ts").collect()
    want = models.rolling_pca(df, ["g"], "ts", NAMES, 12, 2).orderBy("g", "ts").collect()
    assert len(got) == 80  # the late row is dropped
    for a, b in zip(got, want, strict=True):
        assert (a["group"], a["ts"]) == (b["g"], b["ts"])
        assert a["components"] is None or np.allclose(a["components"], b["components"], atol=1e-6)
    settings = {"n_regimes": 2, "window": 20}
    got = stream(spark, tmp_path / "hmm", df, lambda s: updates.update_regimes(s, "g", "ts", NAMES[:2], **settings), batches).orderBy("group", "ts").collect()
    want = models.rolling_regimes(df, ["g"], "ts", NAMES[:2], **settings).orderBy("g", "ts").collect()
    assert [r["label"] for r in got] == [r["label"] for r in want] and [r["switched"] for r in got] == [r["switched"] for r in want]


def test_streams_equal_batches_by_period(spark, tmp_path):
    df = simulate.drifting_blobs(spark, 10, 20, seed=6).withColumn("g", F.lit("x")).select("g", "period", "entity", "f0", "f1")
    batches = [df.where("period < 3 or (period = 3 and entity < 'e0009')"), df.where("(period = 3 and entity >= 'e0009') or period between 4 and 6"), df.where("period > 6")]
    got = stream(spark, tmp_path / "km", df, lambda s: updates.update_kmeans(s, "g", "period", "entity", ["f0", "f1"], n_clusters=3), batches)
    want = models.rolling_kmeans(df, ["g"], "period", "entity", ["f0", "f1"], n_clusters=3).where("period < 9")
    key = lambda rows: sorted((r["period"], r["entity"], r["label"], round(r["dist2"], 9)) for r in rows.collect())
    assert key(got) == key(want)  # the last period waits for the next one
    got = stream(spark, tmp_path / "em", df, lambda s: updates.update_embedding(s, "g", "period", "entity", ["f0", "f1"], 2), batches)
    want = models.rolling_embedding(df, ["g"], "period", "entity", ["f0", "f1"], 2).where("period < 9")
    key = lambda rows: sorted((r["period"], r["entity"], *(round(c, 6) for c in r["coords"])) for r in rows.collect())
    assert key(got) == key(want)


def test_empty_inputs(spark):
    df = frame(spark, {"a": factors(5)}).where("false")
    assert models.rolling_pca(df, ["g"], "ts", NAMES, 3, 1).count() == 0
    assert models.rolling_regimes(df, ["g"], "ts", NAMES, n_regimes=1, window=3).count() == 0
