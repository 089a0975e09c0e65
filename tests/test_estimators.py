from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators.estimators import RollingEmbedding, RollingKMeans, RollingPCA, RollingRegimes
from evenkeel.sources import simulate


def test_row_models(spark):
    rows = simulate.regime_returns(spark, 160, 3, 0.97, seed=2).withColumn("g", F.lit("x"))
    names = ["a0", "a1", "a2"]
    pca = RollingPCA(["g"], "step", names, n_components=2, window=40)
    with pytest.raises(RuntimeError):
        pca.components_
    head, tail = rows.where("step < 120"), rows.where("step >= 120")
    whole = {r["ts"]: r["components"] for r in RollingPCA(["g"], "step", names, 2, 40).fit(rows).components_.collect()}
    new = pca.fit(head).update(tail).collect()
    assert len(new) == 40 and all(np.allclose(r["components"], whole[r["ts"]]) for r in new)
    assert pca.transform(tail).count() == 40 and pca.fit_transform(head).count() == 120 and "window=40" in repr(pca)
    assert all(getattr(pca, n).count() == 120 for n in ("eigenvalues_", "explained_variance_ratio_", "similarity_", "n_flips_", "n_reorders_", "result_"))
    with pytest.raises(ValueError):
        pca.update(tail.drop("a1"))
    regimes = RollingRegimes(["g"], "step", names, window=80, refit_every=5)
    labels = {r["ts"]: r["label"] for r in RollingRegimes(["g"], "step", names, window=80, refit_every=5).fit_predict(rows).collect()}
    assert {r["ts"]: r["label"] for r in regimes.fit(head).update(tail).collect()} == {t: k for t, k in labels.items() if t >= 120}
    assert regimes.predict(tail).count() == 40 and "label" not in regimes.predict_proba(tail).columns
    assert abs(sum(r["share"] for r in regimes.regime_summary().collect()) - 1) < 1e-9
    assert all(getattr(regimes, n).count() == 160 for n in ("probs_", "means_", "covariances_", "weights_", "transition_", "n_relabels_", "switched_"))


def test_panel_models(spark):
    rows = simulate.drifting_blobs(spark, 8, 30, seed=3).withColumn("g", F.lit("x"))
    names = ["f0", "f1"]
    km = RollingKMeans(["g"], "period", "entity", names, n_clusters=3, centroid_memory=2)
    whole = {(r["period"], r["entity"]): r["label"] for r in RollingKMeans(["g"], "period", "entity", names, 3, centroid_memory=2).fit_predict(rows).collect()}
    new = km.fit(rows.where("period < 6")).update(rows.where("period >= 6")).collect()
    assert len(new) == 60 and all(whole[r["period"], r["entity"]] == r["label"] for r in new)
    last = rows.where("period = 7").select("g", "entity", *names)
    assert {r["entity"]: r["label"] for r in km.predict(last).collect()} == {e: k for (p, e), k in whole.items() if p == 7}
    assert km.transform(last).count() == 90 and km.labels_frame().count() == 8 and km.cluster_summary().count() == 3
    assert km.times_.count() == 8 and km.entity_names_.count() == 30 and km.switched_.where("switched").count() == 0
    assert all(getattr(km, n).count() == 8 for n in ("centroids_", "inertia_", "n_relabels_", "n_iter_"))
    em = RollingEmbedding(["g"], "period", "entity", names, n_components=2).fit(rows)
    assert em.embeddings_.count() == 240 and em.disparity_.count() == 8 and em.displacement_.count() == 240
    assert em.trajectory("e0003").count() == 8 and em.embedding_frame(2).count() == 30


def test_predictions_keep_repeated_rows(spark):
    rows = simulate.drifting_blobs(spark, 3, 20, seed=3).withColumn("g", F.lit("x"))
    km = RollingKMeans(["g"], "period", "entity", ["f0", "f1"], n_clusters=3, centroid_memory=2).fit(rows)
    last = rows.where("period = 2").select("g", "entity", "f0", "f1")
    assert km.predict(last.unionByName(last)).count() == 40 and km.transform(last.unionByName(last)).count() == 120
    with pytest.raises(ValueError):
        km.transform(last.withColumn("distance", F.lit(1)))
