"""The models as objects: parameters, ``fit`` on a DataFrame, results as DataFrames.

Results are lazy, and kept by Spark once they are made, together with the state that each group is left in. ``update``
goes on from there: its cost is that of the new rows, however long the history is (only exponentially weighted PCA is
fitted again). ``release`` lets go of what is kept. A service uses ``evenkeel.streaming.updates``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import models, summaries


class _Model:
    """``group``, time and features of the data, and what was fitted on them."""

    def __init__(self, group: Sequence[str], features: Sequence[str]) -> None:
        self.group, self.feature_names_in_ = list(group), list(features)
        self._rows: DataFrame | None = None
        self._result: DataFrame | None = None
        self._states: DataFrame | None = None
        self._kept: list[DataFrame] = []

    def _fitted(self) -> DataFrame:
        if self._result is None:
            raise RuntimeError(f"{type(self).__name__} is not fitted yet")
        return self._result

    def _columns(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self._needed() if c not in df.columns]:
            raise ValueError(f"columns are missing: {missing}")
        return df.select(*self._needed())

    def _keep(self, steps: DataFrame) -> DataFrame:
        steps = steps.persist()
        self._kept.append(steps)
        return steps

    def fit(self, df: DataFrame):
        self.release()
        self._rows = self._columns(df)
        steps = self._keep(self._run(self._rows, with_state=True))
        self._result, self._states = steps.drop("state"), models.last_states(steps, self.group)
        return self

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def update(self, df: DataFrame) -> DataFrame:
        """The steps of rows that come after those fitted; the model then includes them."""
        self._fitted()
        new, key = self._columns(df), self._key()
        if self.settings.get("halflife") is not None:
            last = self._rows.groupBy(*self.group).agg(F.max(key[0]).alias("_last"))
            self.fit(self._rows.unionByName(new))
            out = self._result.join(last, self.group, "left")
            return out.where(F.col("_last").isNull() | (F.col(key[1]) > F.col("_last"))).drop("_last")
        steps = self._keep(self._run(new, with_state=True, states=self._states))
        newer = models.last_states(steps, self.group)
        others = self._states.join(newer.select(*self.group), self.group, "left_anti")
        self._states, self._rows = self._keep(others.unionByName(newer)), self._rows.unionByName(new)
        self._result = self._result.unionByName(steps.drop("state"))
        return steps.drop("state")

    @property
    def result_(self) -> DataFrame:
        return self._fitted()

    def _pick(self, *names: str) -> DataFrame:
        return self._fitted().select(*self.group, self._key()[1], *names)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.settings.items())})"


class _Rows(_Model):
    def __init__(self, group: Sequence[str], ts: str, features: Sequence[str], settings: dict) -> None:
        super().__init__(group, features)
        self.ts, self.settings = ts, settings

    def _needed(self) -> list[str]:
        return [*self.group, self.ts, *self.feature_names_in_]

    def _key(self) -> tuple[str, str]:
        return self.ts, "ts"


class _Panel(_Model):
    def __init__(self, group: Sequence[str], period: str, entity: str, features: Sequence[str], settings: dict) -> None:
        super().__init__(group, features)
        self.period, self.entity, self.settings = period, entity, settings

    def _needed(self) -> list[str]:
        return [*self.group, self.period, self.entity, *self.feature_names_in_]

    def _key(self) -> tuple[str, str]:
        return self.period, "period"

    @property
    def times_(self) -> DataFrame:
        return self._fitted().select(*self.group, "period").distinct()

    @property
    def entity_names_(self) -> DataFrame:
        """Every entity seen, with the period in which it first was."""
        return self._fitted().groupBy(*self.group, "entity").agg(F.min("period").alias("first_period"))


class RollingPCA(_Rows):
    def __init__(self, group: Sequence[str], ts: str, features: Sequence[str], n_components: int = 3, window: int = 252, **settings) -> None:
        super().__init__(group, ts, features, {"n_components": n_components, "window": window, **settings})

    def _run(self, df: DataFrame, **more) -> DataFrame:
        return models.rolling_pca(df, self.group, self.ts, self.feature_names_in_, **self.settings, **more)

    def transform(self, df: DataFrame | None = None) -> DataFrame:
        """The projections of the rows fitted, or of others on the latest valid basis."""
        if df is None:
            return self._pick("projections")
        return models.project(self._fitted(), self._columns(df), self.group, self.feature_names_in_)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform()

    components_ = property(lambda self: self._pick("components"))
    eigenvalues_ = property(lambda self: self._pick("eigenvalues"))
    explained_variance_ratio_ = property(lambda self: self._pick("explained_variance_ratio"))
    similarity_ = property(lambda self: self._pick("similarity"))
    n_flips_ = property(lambda self: self._pick("n_flips"))
    n_reorders_ = property(lambda self: self._pick("n_reorders"))


class RollingRegimes(_Rows):
    def __init__(self, group: Sequence[str], ts: str, features: Sequence[str], n_regimes: int = 2, window: int = 1008, **settings) -> None:
        super().__init__(group, ts, features, {"n_regimes": n_regimes, "window": window, **settings})

    def _run(self, df: DataFrame, **more) -> DataFrame:
        return models.rolling_regimes(df, self.group, self.ts, self.feature_names_in_, **self.settings, **more)

    def predict(self, df: DataFrame) -> DataFrame:
        """``label`` and ``probs`` of rows under the latest parameters."""
        return models.predict_regimes(self._fitted(), self._columns(df), self.group, self.feature_names_in_, self.settings.get("reg_covar", 1e-6))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.predict(df).drop("label")

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).labels_

    def regime_summary(self) -> DataFrame:
        rows = self._rows.withColumnRenamed(self.ts, "ts")
        return summaries.regime_summary(self._pick("label").join(rows, [*self.group, "ts"]), self.group, "ts", self.feature_names_in_)

    labels_ = property(lambda self: self._pick("label"))
    probs_ = property(lambda self: self._pick("probs"))
    means_ = property(lambda self: self._pick("means"))
    covariances_ = property(lambda self: self._pick("covariances"))
    weights_ = property(lambda self: self._pick("weights"))
    transition_ = property(lambda self: self._pick("transition"))
    n_relabels_ = property(lambda self: self._pick("n_relabels"))
    switched_ = property(lambda self: self._pick("switched"))


class RollingKMeans(_Panel):
    def __init__(self, group: Sequence[str], period: str, entity: str, features: Sequence[str], n_clusters: int = 3, **settings) -> None:
        super().__init__(group, period, entity, features, {"n_clusters": n_clusters, **settings})

    def _run(self, df: DataFrame, **more) -> DataFrame:
        return models.rolling_kmeans(df, self.group, self.period, self.entity, self.feature_names_in_, **self.settings, **more)

    def _bank(self) -> DataFrame:
        """The remembered centroids of the last periods, a row per group, cluster and period."""
        from pyspark.sql.window import Window

        steps = models.kmeans_steps(self._fitted(), self.group)
        recent = F.row_number().over(Window.partitionBy(*self.group).orderBy(F.desc("period")))
        kept = steps.withColumn("_n", recent).where(F.col("_n") <= self.settings.get("centroid_memory", 1))
        return kept.select(*self.group, F.posexplode("centroids").alias("k", "centre"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Distances to each cluster's nearest remembered place: ``k, distance`` for every row, repeated ones too."""
        found = self._far(df).select(*df.columns, F.inline("_far"))
        return found.withColumnsRenamed({"_k": "k", "_d": "distance"})

    def _far(self, df: DataFrame) -> DataFrame:
        if clash := {"k", "distance", "label"} & set(df.columns):
            raise ValueError(f"columns have names of results: {sorted(clash)}")
        held = summaries.bank(self._bank(), self.group)  # a row per group: clusters times memory
        joined = df.join(held, self.group) if self.group else df.crossJoin(F.broadcast(held))
        x = F.array(*(F.col(f).cast("double") for f in self.feature_names_in_))
        return joined.withColumn("_far", summaries.distances(x, F.col("_held")))

    def predict(self, df: DataFrame) -> DataFrame:
        """``label`` of rows: the cluster of the nearest remembered place, the lowest of equals."""
        best = F.array_min(F.transform("_far", lambda f: F.struct(f["_d"].alias("d"), f["_k"].alias("k"))))
        return self._far(df).select(*df.columns, best["k"].cast("long").alias("label"))

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).labels_

    def labels_frame(self) -> DataFrame:
        return summaries.labels_frame(self._fitted())

    def cluster_summary(self) -> DataFrame:
        return summaries.cluster_summary(self._fitted(), self.group)

    @property
    def labels_(self) -> DataFrame:
        return self._fitted().select(*self.group, "period", "entity", "label")

    @property
    def switched_(self) -> DataFrame:
        return self._fitted().select(*self.group, "period", "entity", "switched")

    def _steps(self, name: str) -> DataFrame:
        return models.kmeans_steps(self._fitted(), self.group).select(*self.group, "period", name)

    centroids_ = property(lambda self: self._steps("centroids"))
    inertia_ = property(lambda self: self._steps("inertia"))
    n_relabels_ = property(lambda self: self._steps("n_relabels"))
    n_iter_ = property(lambda self: self._steps("n_iter"))


class RollingEmbedding(_Panel):
    def __init__(self, group: Sequence[str], period: str, entity: str, features: Sequence[str], n_components: int = 2, **settings) -> None:
        super().__init__(group, period, entity, features, {"n_components": n_components, **settings})

    def _run(self, df: DataFrame, **more) -> DataFrame:
        return models.rolling_embedding(df, self.group, self.period, self.entity, self.feature_names_in_, **self.settings, **more)

    def embedding_frame(self, period) -> DataFrame:
        return models.embedding_frame(self._fitted(), period)

    def trajectory(self, entity: str) -> DataFrame:
        return models.trajectory(self._fitted(), entity)

    @property
    def embeddings_(self) -> DataFrame:
        return self._fitted().select(*self.group, "period", "entity", "coords")

    @property
    def displacement_(self) -> DataFrame:
        return self._fitted().select(*self.group, "period", "entity", "displacement")

    @property
    def disparity_(self) -> DataFrame:
        return self._fitted().groupBy(*self.group, "period").agg(F.first("disparity").alias("disparity"))
