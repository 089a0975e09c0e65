"""Streaming updates of the four models: the batch kernels, one state per group, in Structured Streaming.

Rows of a group are put in order within each micro-batch; a row that is not later than the last one handled is dropped
and counted in the state. For row models (PCA, regimes) each row is a step. For panel models (clusters, embeddings) a
period is complete once a later period of the group has arrived, or by ``flush``: with it, the end of a micro-batch
completes all its periods. State is the kernel object, pickled: a window of rows and the last parameters, not a history.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evenkeel.kernels import moments
from evenkeel.kernels.clusters import EmbeddingStepper, KMeansStepper
from evenkeel.kernels.hmm import RegimeStepper
from evenkeel.kernels.matching import Chain
from evenkeel.operators.models import CLUSTER_FIELDS, EMBEDDING_FIELDS, REGIME_FIELDS, VECTOR, MATRIX, listed, regime_row


class PcaStepper:
    """Exact windows over the rows kept, aligned with the last valid basis."""

    def __init__(self, window: int, n_components: int, matching: str = "hungarian", corr: bool = False, ddof: int = 1, halflife: float | None = None) -> None:
        self.window, self.p, self.corr, self.ddof = window, n_components, corr, ddof
        self.chain, self.rows, self.halflife, self.seen, self.sums = Chain(matching), [], halflife, 0, None

    def add(self, row: np.ndarray) -> dict | None:
        if not np.isfinite(row).all():
            raise NotImplementedError("updates need rows without gaps")
        self.seen += 1
        if self.halflife is not None:
            self.sums = self.sums or moments.Decayed(1, len(row), self.halflife)
            mean, cov = self.sums.add(row[None])
            mean = mean[0]
        else:
            self.rows = [*self.rows[-(self.window - 1) :], row]
        if self.seen < self.window:
            return None
        if self.halflife is None:
            x = np.stack(self.rows)
            mean, cov = x.mean(axis=0), np.cov(x, rowvar=False, ddof=self.ddof).reshape(len(row), len(row))
        values, vectors, total = moments.leading(moments.correlation(cov) if self.corr else cov, self.p)
        values, vectors, similarity, flips, moves = self.chain.step(values, vectors)
        return {"components": vectors.T, "eigenvalues": values, "similarity": similarity, "means": mean, "total": total, "projections": (row - mean) @ vectors, "flips": flips, "moves": moves}


PCA_UPDATE_FIELDS = (
    ("components", MATRIX), ("eigenvalues", VECTOR), ("explained_variance_ratio", VECTOR), ("similarity", VECTOR), ("means", VECTOR),
    ("total_variance", T.DoubleType()), ("projections", VECTOR), ("n_flips", T.LongType()), ("n_reorders", T.LongType()),
)


def pca_row(found: dict | None) -> tuple:
    if found is None:
        return *[None] * 7, 0, 0
    shares = found["eigenvalues"] / found["total"] if found["total"] else np.full(len(found["eigenvalues"]), np.nan)
    return (
        listed(found["components"]), listed(found["eigenvalues"]), listed(shares), listed(found["similarity"]), listed(found["means"]),
        float(found["total"]), listed(found["projections"]), found["flips"], found["moves"],
    )


class RowProcessor(StatefulProcessor):
    """Feeds a group's rows to a stepper, in order."""

    def __init__(self, make: Callable, shape: Callable, features: Sequence[str], names: Sequence[str]) -> None:
        self.make, self.shape, self.features, self.names = make, shape, list(features), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {"model": self.make(), "last": None, "dropped": 0}
        new = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        made, times = [], []
        for ts, row in zip(new["ts"], new[self.features].to_numpy(float), strict=True):
            if held["last"] is not None and ts <= held["last"]:
                held["dropped"] += 1
                continue
            made.append(self.shape(held["model"].add(row)))
            times.append(ts)
            held["last"] = ts
        self.state.update((pickle.dumps(held),))
        frame = pd.DataFrame(made, columns=self.names)
        frame.insert(0, "ts", times)
        frame.insert(0, "group", str(key[0]))
        yield frame

    def close(self) -> None:
        pass


class PeriodProcessor(RowProcessor):
    """Feeds a group's complete periods to a stepper."""

    def __init__(self, make: Callable, shape: Callable, features: Sequence[str], names: Sequence[str], flush: bool) -> None:
        super().__init__(make, shape, features, names)
        self.flush = flush

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {"model": self.make(), "last": None, "dropped": 0, "open": None}
        new = pd.concat(list(rows), ignore_index=True)
        if held["last"] is not None:
            late = new["period"] <= held["last"]
            held["dropped"] += int(late.sum())
            new = new[~late]
        if held["open"] is not None:
            new = pd.concat([held["open"], new], ignore_index=True)
        made, held["open"] = [], None
        newest = new["period"].max() if len(new) else None
        for period, part in new.sort_values(["period", "entity"], kind="stable").groupby("period", sort=True):
            if period == newest and not self.flush:
                held["open"] = part
                continue
            entities = part["entity"].tolist()
            found = self.shape(held["model"].step(entities, part[self.features].to_numpy(float)), len(part))
            made.append(pd.DataFrame({"group": str(key[0]), "period": period, "entity": entities} | found))
            held["last"] = period
        self.state.update((pickle.dumps(held),))
        yield from made

    def close(self) -> None:
        pass


def _rows(stream: DataFrame, group: str, ts: str, features: Sequence[str], fields, make, shape) -> DataFrame:
    source = stream.select(F.col(group).cast("string").alias("group"), F.col(ts).alias("ts"), *(F.col(f).cast("double") for f in features))
    schema = T.StructType([T.StructField("group", T.StringType()), source.schema["ts"], *(T.StructField(n, t) for n, t in fields)])
    processor = RowProcessor(make, shape, features, [n for n, _ in fields])
    return source.groupBy("group").transformWithStateInPandas(processor, schema, "append", "none")


def update_pca(stream: DataFrame, group: str, ts: str, features: Sequence[str], window: int, n_components: int, **settings) -> DataFrame:
    make = lambda: PcaStepper(window, n_components, **settings)
    make()
    return _rows(stream, group, ts, features, PCA_UPDATE_FIELDS, make, pca_row)


def update_regimes(stream: DataFrame, group: str, ts: str, features: Sequence[str], **settings) -> DataFrame:
    k, d = RegimeStepper(**settings).k, len(features)
    return _rows(stream, group, ts, features, REGIME_FIELDS, lambda: RegimeStepper(**settings), lambda found: regime_row(found, k, d))


def _periods(stream: DataFrame, group: str, period: str, entity: str, features: Sequence[str], fields, make, shape, flush: bool) -> DataFrame:
    source = stream.select(
        F.col(group).cast("string").alias("group"), F.col(period).alias("period"), F.col(entity).cast("string").alias("entity"),
        *(F.col(f).cast("double") for f in features),
    )
    schema = T.StructType([T.StructField("group", T.StringType()), source.schema["period"], T.StructField("entity", T.StringType()), *(T.StructField(n, t) for n, t in fields)])
    processor = PeriodProcessor(make, shape, features, [n for n, _ in fields], flush)
    return source.groupBy("group").transformWithStateInPandas(processor, schema, "append", "none")


def update_kmeans(stream: DataFrame, group: str, period: str, entity: str, features: Sequence[str], flush: bool = False, **settings) -> DataFrame:
    def shape(f: dict, n: int) -> dict:
        c = listed(f["centroids"])
        return {"label": f["label"], "switched": f["switched"], "dist2": f["dist2"], "centroids": [c] * n, "inertia": f["inertia"], "n_relabels": f["n_relabels"], "n_iter": f["n_iter"]}

    KMeansStepper(**settings)
    return _periods(stream, group, period, entity, features, CLUSTER_FIELDS, lambda: KMeansStepper(**settings), shape, flush)


def update_embedding(stream: DataFrame, group: str, period: str, entity: str, features: Sequence[str], n_components: int = 2, flush: bool = False, **settings) -> DataFrame:
    def shape(f: dict, n: int) -> dict:
        null = lambda v: None if v != v else float(v)
        return {"coords": [listed(c) for c in f["coords"]], "displacement": [null(v) for v in f["displacement"]], "disparity": null(f["disparity"])}

    make = lambda: EmbeddingStepper(n_components=n_components, **settings)
    make()
    return _periods(stream, group, period, entity, features, EMBEDDING_FIELDS, make, shape, flush)
