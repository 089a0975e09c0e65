"""The four rolling models over DataFrames: parallel over groups, and PCA's windows over blocks of time.

A chain over time is sequential by nature: each step starts from the one before. So regimes, clusters and embeddings are
grouped kernels, one group at a time in a task; many groups run side by side. PCA is split: eigenpairs of windows are
independent, so they are solved in blocks of time whose first rows are copies of the last rows of the block before, and
only the alignment of what comes out, a few numbers per step, runs along the whole group.

Rows of a group are ordered by time (then by entity); nothing depends on how they arrive.

With ``states`` a model goes on from where it was: each group's state is what the last step left (a window of rows, the
last parameters), pickled in the ``state`` column of the group's last row, so that new rows cost the same however long
the history is. ``with_state`` asks for that column; it is NULL in all other rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evenkeel.kernels import moments
from evenkeel.kernels.clusters import EmbeddingStepper, KMeansStepper, factored, leading_axes, pooled, turned
from evenkeel.kernels.hmm import RegimeStepper
from evenkeel.kernels.matching import Chain
from evenkeel.sources.panels import number, with_step

VECTOR, MATRIX = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))
#: Rows of time in a block, beyond the window; features from which on subspace iterations beat whole solutions.
BLOCK, MANY = 1024, 64


def listed(x: np.ndarray):
    """Nested lists with NULL for NaN."""
    x = np.asarray(x, float)
    if not np.isnan(x).any():
        return x.tolist()
    if x.ndim > 1:
        return [listed(row) for row in x]
    return [None if v != v else v for v in x.tolist()]


def unlisted(column: pd.Series, width: int) -> np.ndarray:
    """Rows of lists as a matrix, NaN for NULL."""
    return np.array([np.asarray(row, float) for row in column], float).reshape(len(column), width)


def _schema(df: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields)])


STATE = ("state", T.BinaryType())


def _stated(frame: pd.DataFrame, state, wanted: bool) -> pd.DataFrame:
    """``frame`` with the state at its last row."""
    if wanted:
        frame = frame.assign(state=None)
        if len(frame):
            frame.iat[len(frame) - 1, frame.columns.get_loc("state")] = pickle.dumps(state)
    return frame


def _by_group(rows: DataFrame, group: Sequence[str], run: Callable, schema: T.StructType, states: DataFrame | None) -> DataFrame:
    """``run(rows, state)`` for each group; the state is None where there is none."""
    if states is None:
        return rows.groupBy(*group).applyInPandas(lambda pdf: run(pdf, None), schema)
    empty = pd.DataFrame(columns=schema.fieldNames())

    def go_on(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return run(new, pickle.loads(held["state"].iloc[0]) if len(held) else None) if len(new) else empty

    return rows.groupBy(*group).cogroup(states.select(*group, "state").groupBy(*group)).applyInPandas(go_on, schema)


def last_states(steps: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, state``: where each group's model is."""
    return steps.where("state is not null").select(*group, "state")


PCA_FIELDS = (
    ("step", T.IntegerType()), ("valid", T.BooleanType()), ("components", MATRIX), ("eigenvalues", VECTOR), ("explained_variance_ratio", VECTOR),
    ("similarity", VECTOR), ("means", VECTOR), ("total_variance", T.DoubleType()), ("projections", VECTOR), ("n_flips", T.LongType()), ("n_reorders", T.LongType()),
)


def rolling_pca(
    df: DataFrame, group: Sequence[str], ts: str, features: Sequence[str], window: int = 252, n_components: int = 3, *, matching: str = "hungarian",
    corr: bool = False, ddof: int = 1, halflife: float | None = None, align: bool = True, block: int = BLOCK, solver: str = "auto", solver_tol: float = 1e-8,
    refresh_every: int = 1024, with_state: bool = False, states: DataFrame | None = None,
) -> DataFrame:
    """A row per group and time: aligned components (rows), eigenvalues, shares, similarity, means, projections.

    A missing feature is absent: it is active where it is there in the whole window. ``halflife`` weighs rows
    exponentially from the first on, with ``window`` as warm-up; gaps are not allowed then. Projections are centred by
    the window's mean and not divided by deviations, also with ``corr``. ``solver``: "exact" (or "eigh") solves every
    window anew; "subspace" starts each from the basis of the one before and is exact where the residual exceeds
    ``solver_tol`` or features are absent; "auto" takes it if ``n_components`` is a quarter of the features or less, and
    these are many enough for it to pay.
    ``refresh_every``: steps after which sliding sums are made anew (sooner where memory asks for it).
    """
    d, p = len(features), n_components
    if not 1 <= p <= d:
        raise ValueError(f"n_components must be 1 to {d}; got {p}")
    if window < 2:
        raise ValueError(f"window must be 2 or more; got {window}")
    if ddof >= window:
        raise ValueError("ddof must be below window")
    if solver not in ("auto", "exact", "eigh", "subspace"):
        raise ValueError(f"unknown solver: {solver!r}")
    if refresh_every < 1:
        raise ValueError(f"refresh_every must be 1 or more; got {refresh_every}")
    tol = solver_tol if p < d and (solver == "subspace" or solver == "auto" and 4 * p <= d and d >= MANY) else None
    if halflife is not None and halflife <= 0:
        raise ValueError("halflife must be positive")
    Chain(matching)
    group = list(group)
    rows = df.select(*group, F.col(ts).alias("ts"), F.array(*(number(f) for f in features)).alias("x"))
    rows = with_step(rows, group, "ts")
    raw = _schema(rows, [*group, "ts", "step", "x"], [("values", VECTOR), ("vectors", VECTOR), ("means", VECTOR), ("total", T.DoubleType())])

    out = _schema(rows, [*group, "ts"], (*PCA_FIELDS, STATE) if with_state else PCA_FIELDS)

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return unlisted(pdf["x"], d)

    def aligned(pdf: pd.DataFrame, found: tuple, steps: np.ndarray, aligner: Chain) -> pd.DataFrame:
        made = []
        for step, values, vectors, means, total, x in zip(steps.tolist(), *found, matrix(pdf), strict=True):
            valid, total = not np.isnan(values[0]), float(total)
            similarity, flips, moves, shares, seen = np.full(p, np.nan), 0, 0, np.full(p, np.nan), np.full(p, np.nan)
            if valid:
                if align:
                    values, vectors, similarity, flips, moves = aligner.step(values, vectors)
                shares = values / total if total else np.full(p, np.nan)
                seen = np.where(np.isfinite(means), x - means, 0.0) @ np.nan_to_num(vectors)
            made.append((step, valid, listed(vectors.T), listed(values), listed(shares), listed(similarity), listed(means), total, listed(seen), flips, moves))
        frame = pd.concat([pdf[[*group, "ts"]].reset_index(drop=True), pd.DataFrame(made, columns=[n for n, _ in PCA_FIELDS])], axis=1)
        return frame

    def state(x: np.ndarray, step: int, aligner: Chain) -> dict:
        return {"tail": x[-(window - 1) :], "step": step, "chain": aligner}

    if states is not None:
        if halflife is not None:
            raise NotImplementedError("exponential weights go on in evenkeel.streaming.updates")

        def go_on(pdf: pd.DataFrame, held: dict | None) -> pd.DataFrame:
            pdf = pdf.sort_values("ts", kind="stable")
            held = held or {"tail": np.empty((0, d)), "step": -1, "chain": Chain(matching)}
            tail, n = held["tail"], len(pdf)
            x = np.concatenate([tail, matrix(pdf)])
            found = np.full((n, p), np.nan), np.full((n, d, p), np.nan), np.full((n, d), np.nan), np.full(n, np.nan)
            ends = np.arange(max(window - 1, len(tail)), len(x))
            if len(ends):
                values, vectors, means, total = moments.flat_windows(x[None], ends, window, p, corr, ddof, refresh_every, tol)
                for kept, new in zip(found, (values, vectors, means[0], total), strict=True):
                    kept[ends - len(tail)] = new
            steps = held["step"] + 1 + np.arange(n)
            return _stated(aligned(pdf, found, steps, held["chain"]), state(x, int(steps[-1]), held["chain"]), with_state)

        return _by_group(rows.drop("step"), group, go_on, out, states)

    def emitted(pdf: pd.DataFrame, values, vectors, means, total) -> pd.DataFrame:
        flat = vectors.reshape(len(pdf), d * p)
        lists = lambda rows: pd.Series(list(rows), index=pdf.index, dtype=object)
        return pdf[[*group, "ts", "step", "x"]].assign(values=lists(values), vectors=lists(flat), means=lists(means), total=total)

    if halflife is None:
        size = max(block, window)
        at = (F.col("step") / size).cast("int")
        into_next = (F.col("step") + window - 1 >= (at + 1) * size)
        spread = rows.withColumn("block", F.explode(F.when(into_next, F.array(at, at + 1)).otherwise(F.array(at))))

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("step", kind="stable")
            steps = pdf["step"].to_numpy()
            own = steps // size == pdf["block"].to_numpy()
            x = matrix(pdf)
            n = len(pdf)
            values, vectors, means, total = np.full((n, p), np.nan), np.full((n, d, p), np.nan), np.full((n, d), np.nan), np.full(n, np.nan)
            ends = np.flatnonzero(own & (steps >= window - 1))
            if len(ends):
                values[ends], vectors[ends], m, total[ends] = moments.flat_windows(x[None], ends, window, p, corr, ddof, refresh_every, tol)
                means[ends] = m[0]
            return emitted(pdf[own], values[own], vectors[own], means[own], total[own])

        solved = spread.groupBy(*group, "block").applyInPandas(solve, raw)
    else:

        def decay(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("step", kind="stable")
            x = matrix(pdf)
            if not np.isfinite(x).all():
                raise NotImplementedError("exponential weights with gaps")
            n = len(pdf)
            values, vectors, means, total = np.full((n, p), np.nan), np.full((n, d, p), np.nan), np.full((n, d), np.nan), np.full(n, np.nan)
            sums, before = moments.Decayed(1, d, halflife), None
            for t in range(n):
                mean, cov = sums.add(x[t][None])
                if t < window - 1:
                    continue
                cov = moments.correlation(cov) if corr else cov
                found = moments.warm_subspace(cov.__matmul__, before, tol) if tol is not None and before is not None else None
                v, w, total[t] = (*found, np.trace(cov)) if found else moments.leading(cov, p)
                values[t], vectors[t], means[t], before = v, w, mean[0], w
            return emitted(pdf, values, vectors, means, total)

        solved = rows.groupBy(*group).applyInPandas(decay, raw)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step", kind="stable")
        aligner = Chain(matching)
        found = unlisted(pdf["values"], p), unlisted(pdf["vectors"], d * p).reshape(-1, d, p), unlisted(pdf["means"], d), pdf["total"].to_numpy(float)
        frame = aligned(pdf, found, pdf["step"].to_numpy(), aligner)
        return _stated(frame, state(matrix(pdf), len(pdf) - 1, aligner), with_state)

    return solved.groupBy(*group).applyInPandas(chain, out)


def panel_pca(
    df: DataFrame, group: Sequence[str], item: str, ts: str, features: Sequence[str], window: int = 252, n_components: int = 3, *,
    matching: str = "hungarian", corr: bool = False, ddof: int = 1, align: bool = True, halflife: float | None = None,
) -> DataFrame:
    """PCA of items that share one basis: the covariance is the mean over items. Means and projections are per item.

    A row per group, time and item; items need all features at all times.
    """
    d, p, group = len(features), n_components, list(group)
    rows = df.select(*group, F.col(item).alias("item"), F.col(ts).alias("ts"), *(F.col(f).cast("double") for f in features))
    fields = [f for f in PCA_FIELDS if f[0] not in ("step", "valid")]
    out = _schema(rows, [*group, "item", "ts"], fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        items, times = sorted(pdf["item"].unique()), sorted(pdf["ts"].unique())
        pdf = pdf.sort_values(["item", "ts"], kind="stable")
        if len(pdf) != len(items) * len(times) or not np.isfinite(pdf[list(features)].to_numpy(float)).all():
            raise ValueError("a panel needs every item at every time, without gaps")
        x = pdf[list(features)].to_numpy(float).reshape(len(items), len(times), d)
        n = len(times)
        if halflife is None:
            ends = np.arange(min(window - 1, n), n)
            values, vectors, means, total = moments.flat_windows(x, ends, window, p, corr, ddof)
        else:
            sums, ends, found = moments.Decayed(len(items), d, halflife), np.arange(min(window - 1, n), n), []
            for t in range(n):
                mean, cov = sums.add(x[:, t])
                if t >= window - 1:
                    found.append((*moments.leading(moments.correlation(cov) if corr else cov, p), mean))
            values, vectors, total = (np.stack([f[i] for f in found]) if found else np.empty(0) for i in range(3))
            means = np.stack([f[3] for f in found], axis=1) if found else np.empty((len(items), 0, d))
        chain, made = Chain(matching), []
        for k, t in enumerate(ends):
            v, w, similarity, flips, moves = chain.step(values[k], vectors[k]) if align else (values[k], vectors[k], np.full(p, np.nan), 0, 0)
            for f, name in enumerate(items):
                seen = (x[f, t] - means[f, k]) @ w
                made.append((name, times[t], listed(w.T), listed(v), listed(v / total[k]), listed(similarity), listed(means[f, k]), total[k], listed(seen), flips, moves))
        frame = pd.DataFrame(made, columns=["item", "ts", *(n for n, _ in fields)])
        for g in reversed(group):
            frame.insert(0, g, pdf[g].iloc[0])
        return frame

    return rows.groupBy(*group).applyInPandas(solve, out)


def latest_basis(steps: DataFrame, group: Sequence[str]) -> DataFrame:
    """The last valid step of each group."""
    last = steps.where("valid").groupBy(*group).agg(F.max_by(F.struct("means", "components"), "step").alias("_b"))
    return last.select(*group, F.col("_b.means").alias("_means"), F.col("_b.components").alias("_components"))


def project(steps: DataFrame, rows: DataFrame, group: Sequence[str], features: Sequence[str], into: str = "projections") -> DataFrame:
    """New rows on the latest valid basis of their group, by higher-order functions; inactive coordinates give nothing."""
    x = F.array(*(number(f) for f in features))
    joined = rows.join(latest_basis(steps, group), list(group)) if group else rows.crossJoin(F.broadcast(latest_basis(steps, group)))
    centred = F.zip_with(x, F.col("_means"), lambda a, m: F.coalesce(a - m, F.lit(0.0)))
    dot = lambda c: F.aggregate(F.zip_with(centred, c, lambda a, w: a * F.coalesce(w, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn(into, F.transform("_components", dot)).drop("_means", "_components")


REGIME_FIELDS = (
    ("label", T.LongType()), ("probs", VECTOR), ("raw_probs", VECTOR), ("weights", VECTOR), ("means", MATRIX), ("covariances", T.ArrayType(MATRIX)),
    ("transition", MATRIX), ("log_likelihood", T.DoubleType()), ("n_relabels", T.LongType()), ("switched", T.BooleanType()),
)


def regime_row(found: dict | None, k: int, d: int) -> tuple:
    """A step's result as values of ``REGIME_FIELDS``; label -1 and NULLs while the window fills."""
    if found is None:
        return -1, *[None] * 7, 0, False
    arrays = tuple(listed(found[n]) for n in ("probs", "raw_probs", "weights", "means", "covariances", "transition"))
    return found["label"], *arrays, found["log_likelihood"], found["n_relabels"], found["switched"]


def rolling_regimes(
    df: DataFrame, group: Sequence[str], ts: str, features: Sequence[str], *, with_state: bool = False, states: DataFrame | None = None, **settings
) -> DataFrame:
    """Regimes of a Gaussian hidden Markov model, refitted along time with anchored identities. Features must be there."""
    probe, group, d = RegimeStepper(**settings), list(group), len(features)
    rows = df.select(*group, F.col(ts).alias("ts"), *(F.col(f).cast("double") for f in features))
    out = _schema(rows, [*group, "ts"], (*REGIME_FIELDS, STATE) if with_state else REGIME_FIELDS)

    def run(pdf: pd.DataFrame, held: RegimeStepper | None) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        x = pdf[list(features)].to_numpy(float)
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        stepper = held or RegimeStepper(**settings)
        made = [regime_row(stepper.add(row), probe.k, d) for row in x]
        return _stated(pd.concat([pdf[[*group, "ts"]], pd.DataFrame(made, columns=[n for n, _ in REGIME_FIELDS])], axis=1), stepper, with_state)

    return _by_group(rows, group, run, out, states)


def predict_regimes(steps: DataFrame, rows: DataFrame, group: Sequence[str], features: Sequence[str], reg_covar: float = 1e-6) -> DataFrame:
    """``probs`` and ``label`` of new rows under the latest parameters of their group: no filter, no hysteresis."""
    from evenkeel.kernels.hmm import posterior

    last = steps.where("label >= 0").groupBy(*group).agg(F.max_by(F.struct("means", "covariances"), "ts").alias("_p"))
    joined = rows.join(last, list(group))
    schema = T.StructType([T.StructField("probs", VECTOR), T.StructField("label", T.LongType())])

    @F.pandas_udf(schema)
    def judged(x: pd.Series, p: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row, means, covs in zip(x, p["means"], p["covariances"], strict=True):
            m = np.array([list(v) for v in means], float)
            c = np.array([[list(w) for w in v] for v in covs], float)
            probs = posterior(np.array(row, float)[None], m, c, np.full(len(m), 1 / len(m)), reg_covar)[0]
            made.append((probs.tolist(), int(probs.argmax())))
        return pd.DataFrame(made, columns=["probs", "label"])

    found = joined.withColumn("_f", judged(F.array(*(F.col(f).cast("double") for f in features)), F.col("_p")))
    return found.select(*rows.columns, F.col("_f.probs").alias("probs"), F.col("_f.label").alias("label"))


def filter_regimes(df: DataFrame, group: Sequence[str], ts: str, features: Sequence[str], means, covariances, transition, initial, reg_covar: float = 0.0) -> DataFrame:
    """``probs``: filtered probabilities under fixed parameters, each from all rows of the group up to its own."""
    from evenkeel.kernels.hmm import forward, log_densities

    group = list(group)
    m, c, a, pi = (np.array(v, float) for v in (means, covariances, transition, initial))
    rows = df.select(*group, F.col(ts).alias("ts"), *(F.col(f).cast("double") for f in features))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        logs = log_densities(pdf[list(features)].to_numpy(float), m, c, reg_covar)
        probs = forward(np.exp(logs - logs.max(axis=1, keepdims=True)), a, pi)[0]
        return pdf[[*group, "ts"]].assign(probs=pd.Series(probs.tolist(), index=pdf.index, dtype=object))

    return rows.groupBy(*group).applyInPandas(run, _schema(rows, [*group, "ts"], (("probs", VECTOR),)))


def _periods(pdf: pd.DataFrame, features: Sequence[str]) -> Iterator[tuple[object, pd.DataFrame, np.ndarray]]:
    for period, part in pdf.sort_values(["period", "entity"], kind="stable").groupby("period", sort=True):
        yield period, part, part[list(features)].to_numpy(float)


CLUSTER_FIELDS = (
    ("label", T.LongType()), ("switched", T.BooleanType()), ("dist2", T.DoubleType()), ("centroids", MATRIX), ("inertia", T.DoubleType()),
    ("n_relabels", T.LongType()), ("n_iter", T.LongType()),
)


def rolling_kmeans(
    df: DataFrame, group: Sequence[str], period: str, entity: str, features: Sequence[str], *, with_state: bool = False, states: DataFrame | None = None, **settings
) -> DataFrame:
    """A row per group, period and entity: label, switch, distance; the period's centroids, inertia and counts beside.

    Panels may be unbalanced; an entity switches only between neighbouring periods that both have it.
    """
    KMeansStepper(**settings)
    group = list(group)
    rows = df.select(*group, F.col(period).alias("period"), F.col(entity).cast("string").alias("entity"), *(F.col(f).cast("double") for f in features))
    out = _schema(rows, [*group, "period", "entity"], (*CLUSTER_FIELDS, STATE) if with_state else CLUSTER_FIELDS)

    def run(pdf: pd.DataFrame, held: KMeansStepper | None) -> pd.DataFrame:
        stepper, made = held or KMeansStepper(**settings), []
        for _, part, x in _periods(pdf, features):
            f = stepper.step(part["entity"].tolist(), x)
            c = listed(f["centroids"])
            own = {"label": f["label"], "switched": f["switched"], "dist2": f["dist2"], "centroids": [c] * len(part)}
            made.append(part[[*group, "period", "entity"]].assign(**own, inertia=f["inertia"], n_relabels=f["n_relabels"], n_iter=f["n_iter"]))
        return _stated(pd.concat(made, ignore_index=True), stepper, with_state)

    return _by_group(rows, group, run, out, states)


def kmeans_steps(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row per period of ``rolling_kmeans``."""
    names = ("centroids", "inertia", "n_relabels", "n_iter")
    return labels.groupBy(*group, "period").agg(*(F.first(n).alias(n) for n in names))


EMBEDDING_FIELDS = (("coords", VECTOR), ("displacement", T.DoubleType()), ("disparity", T.DoubleType()))


FACTORED = (("_n", T.LongType()), ("_mean", VECTOR), ("_r", VECTOR))


def _with(table: pa.Table, values: Sequence[list], fields: Sequence[tuple[str, T.DataType]]) -> pa.Table:
    """``table`` with these columns after its own."""
    for column, (name, kind) in zip(values, fields, strict=True):
        table = table.append_column(name, pa.array(column, to_arrow_type(kind)))
    return table


def _factored(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """What ``clusters.factored`` gives for the vectors ``_x`` of each key: made of each batch, then pooled by key."""
    schema = _schema(rows, keys, FACTORED)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            key = np.zeros(batch.num_rows, np.int64)
            for name in keys:  # nulls are a key's value
                code = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
                key = np.unique(key * (int(code.max()) + 1) + code, return_inverse=True)[1]
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
            n, means, factors = zip(*(factored(x[at]) for at in np.split(order, starts[1:])), strict=True)
            arrays = [batch.column(name).take(pa.array(order[starts])) for name in keys]
            arrays += [pa.array(n, pa.int64()), *(pa.array([v.ravel() for v in vs], pa.list_(pa.float64())) for vs in (means, factors))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    def pool(table: pa.Table) -> pa.Table:
        factors = [np.reshape(v, (-1, width)) for v in table["_r"].to_pylist()]
        n, mean, r = pooled(table["_n"].to_numpy(), np.array(table["_mean"].to_pylist()), factors)
        return _with(table.slice(0, 1).select(keys), [[n], [mean.tolist()], [r.ravel().tolist()]], FACTORED)

    return rows.select(*keys, "_x").mapInArrow(parts, schema).groupBy(*keys).applyInArrow(pool, schema)


def _beside(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``other``, which has a row per key; nulls are a key's value."""
    other = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(other, on).drop(*(f"_of_{k}" for k in keys))


def _mapped(x: Column, centre: Column, axes: Column) -> Column:
    """``axes`` (rows) times a vector less its centre."""
    z = F.zip_with(x, centre, lambda a, b: a - b)
    return F.transform(axes, lambda axis: F.aggregate(F.zip_with(axis, z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def _linear_embedding(rows: DataFrame, group: list[str], features: Sequence[str], k: int, scale: bool) -> DataFrame:
    """``rolling_embedding`` by principal axes. Rows are joined with their period's axes, then with its turn."""
    rows = rows.select(*group, "period", "entity", F.array(*features).alias("_x")).where("period is not null")
    if isinstance(rows.schema["period"].dataType, (T.FloatType, T.DoubleType)):
        rows = rows.where(~F.isnan("period"))
    keys, d = [*group, "period"], len(features)

    axes = (("_mean", VECTOR), ("_axes", MATRIX))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factors = [np.reshape(v, (-1, d)) for v in batch.column("_r").to_pylist()]
            own = [leading_axes(r.T @ r / max(1, n - 1), k).T.tolist() for r, n in zip(factors, batch.column("_n").to_pylist(), strict=True)]
            yield from _with(pa.Table.from_batches([batch]).select(keys), [batch.column("_mean").to_pylist(), own], axes).to_batches()

    found = _factored(rows, keys, d).mapInArrow(solve, _schema(rows, keys, axes))
    found = found.withColumn("_step", F.row_number().over(Window.partitionBy(*group).orderBy("period")).cast("long"))
    raw = _beside(rows, found, keys).select(*keys, "entity", "_step", _mapped(F.col("_x"), F.col("_mean"), F.col("_axes")).alias("_raw"))
    before = Window.partitionBy(*group, "entity").orderBy("_step").rangeBetween(-1, -1)
    raw = raw.withColumn("_old", F.max("_raw").over(before))

    pairs = _factored(raw.where("_old is not null").select(*group, "_step", F.concat("_old", "_raw").alias("_x")), [*group, "_step"], 2 * k)
    steps = pairs.unionByName(found.select(*group, "_step"), allowMissingColumns=True)

    fields = (("_turn", MATRIX), ("_shift", VECTOR), ("_turn_old", MATRIX), ("_shift_old", VECTOR), ("disparity", T.DoubleType()))

    def chain(table: pa.Table) -> pa.Table:
        held = {}  # a step without pairs has a row of nulls only
        for step, n, mean, r in zip(*(table[c].to_pylist() for c in ("_step", "_n", "_mean", "_r")), strict=True):
            held[step] = held.get(step) if n is None else (n, np.array(mean), np.reshape(r, (-1, 2 * k)))
        made = list(turned((held[step] for step in sorted(held)), k, scale))
        turns, shifts = [turn.T.tolist() for turn, _, _ in made], [shift.tolist() for _, shift, _ in made]
        own = table.slice(0, 1).select(group).take(pa.array([0] * len(held))).append_column("_step", pa.array(sorted(held), pa.int64()))
        return _with(own, [turns, shifts, turns[:1] + turns[:-1], shifts[:1] + shifts[:-1], [None if x != x else x for *_, x in made]], fields)

    turns = steps.groupBy(*group).applyInArrow(chain, _schema(steps, [*group, "_step"], fields))
    none = F.array_repeat(F.lit(0.0), k)
    moved = lambda x, at: F.zip_with(_mapped(F.col(x), none, F.col(f"_turn{at}")), F.col(f"_shift{at}"), lambda a, b: a + b)
    out = _beside(raw, turns, [*group, "_step"]).select(*keys, "entity", moved("_raw", "").alias("coords"), moved("_old", "_old").alias("_old"), "disparity")
    apart = F.aggregate(F.zip_with("coords", "_old", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return out.select(*keys, "entity", "coords", F.when(F.col("disparity").isNotNull(), F.sqrt(apart)).alias("displacement"), "disparity")


def rolling_embedding(
    df: DataFrame, group: Sequence[str], period: str, entity: str, features: Sequence[str], n_components: int = 2, *,
    backend: str | Callable = "pca", scale: bool = False, seed: int = 0, backend_kwargs: dict | None = None, with_state: bool = False,
    states: DataFrame | None = None,
) -> DataFrame:
    """Low-dimensional coordinates per period, each aligned with the one before: coordinates, how far an entity moved,

    and the period's disparity. ``backend``: "pca", "umap" where installed, or a function ``(x, start) -> coordinates``.

    With "pca" a period's coordinates are a linear map of its rows, so only these maps run along the group: rows stay
    spread over the cluster, however large the cross-section. Other backends, and states, take a group in one task.
    """
    settings = {"n_components": n_components, "backend_name": backend, "scale": scale, "seed": seed, "backend_kwargs": backend_kwargs}
    EmbeddingStepper(**settings)
    if not 1 <= n_components <= len(features):
        raise ValueError(f"n_components must be 1 to {len(features)}; got {n_components}")
    group = list(group)
    rows = df.select(*group, F.col(period).alias("period"), F.col(entity).cast("string").alias("entity"), *(F.col(f).cast("double") for f in features))
    if backend == "pca" and not with_state and states is None:
        return _linear_embedding(rows, group, features, n_components, scale)
    out = _schema(rows, [*group, "period", "entity"], (*EMBEDDING_FIELDS, STATE) if with_state else EMBEDDING_FIELDS)

    def run(pdf: pd.DataFrame, held: EmbeddingStepper | None) -> pd.DataFrame:
        stepper, made = held or EmbeddingStepper(**settings), []
        for _, part, x in _periods(pdf, features):
            f = stepper.step(part["entity"].tolist(), x)
            made.append((part, f))
        frame = pd.concat([part[[*group, "period", "entity"]] for part, _ in made], ignore_index=True)
        own = {"coords": [listed(c) for _, f in made for c in f["coords"]], "displacement": np.concatenate([f["displacement"] for _, f in made])}
        own["disparity"] = np.repeat([float(f["disparity"]) for _, f in made], [len(part) for part, _ in made])
        frame = frame.assign(**own)
        nulls = frame[["displacement", "disparity"]].astype(object)
        frame[["displacement", "disparity"]] = nulls.where(nulls.notna(), None)
        return _stated(frame, stepper, with_state)

    return _by_group(rows, group, run, out, states)


def trajectory(coords: DataFrame, entity: str) -> DataFrame:
    """An entity's way through the periods."""
    return coords.where(F.col("entity") == entity).orderBy("period")


def embedding_frame(coords: DataFrame, period) -> DataFrame:
    """All entities of a period."""
    return coords.where(F.col("period") == F.lit(period)).orderBy("entity")
