"""Model selection: one row per candidate, candidates in parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.kernels.clusters import farthest_first, lloyd
from evenkeel.kernels.hmm import selection_row


def _per_candidate(df: DataFrame, order: str, features: Sequence[str], candidates: Sequence[int], fields: Sequence[tuple[str, T.DataType]], name: str, kernel) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.LongType()), *(T.StructField(n, t) for n, t in fields)])
    rows = df.select(F.col(order).alias("_o"), *(F.col(f).cast("double") for f in features))
    spread = rows.withColumn(name, F.explode(F.array(*(F.lit(int(c)) for c in candidates))))  # a copy for each candidate

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf[name].iloc[0])
        x = pdf.sort_values("_o", kind="stable")[list(features)].to_numpy(float)
        return pd.DataFrame([{name: k} | kernel(x, k)])

    return spread.groupBy(name).applyInPandas(run, schema)


def select_n_regimes(df: DataFrame, ts: str, features: Sequence[str], candidates: Sequence[int] = (1, 2, 3, 4, 5), *, reg_covar=1e-6, p_switch=0.02, max_iter=300, tol=1e-8) -> DataFrame:
    """``n_regimes, log_likelihood, n_params, aic, bic`` of maximum-likelihood fits to the whole series."""
    if any(not 1 <= k <= 32 for k in candidates):
        raise ValueError("candidates must be 1 to 32")
    fields = [("log_likelihood", T.DoubleType()), ("n_params", T.LongType()), ("aic", T.DoubleType()), ("bic", T.DoubleType())]
    return _per_candidate(df, ts, features, candidates, fields, "n_regimes", lambda x, k: selection_row(x, k, reg_covar, p_switch, max_iter, tol))


#: Differences that are held at a time.
ENTRIES = 1 << 22


def _silhouette(x: np.ndarray, label: np.ndarray, k: int) -> float:
    size = np.bincount(label, minlength=k)
    sums, step = np.zeros((len(x), k)), max(1, ENTRIES // x.size)
    for start in range(0, len(x), step):
        far = np.sqrt(((x[start : start + step, None] - x[None]) ** 2).sum(axis=2))
        for c in range(k):
            sums[start : start + step, c] = far[:, label == c].sum(axis=1)
    own = size[label]
    a = sums[np.arange(len(x)), label] / np.maximum(own - 1, 1)
    means = np.where(size > 0, sums / np.maximum(size, 1), np.inf)
    means[np.arange(len(x)), label] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def select_n_clusters(df: DataFrame, entity: str, features: Sequence[str], candidates: Sequence[int] = (2, 3, 4, 5, 6, 7, 8), *, max_iter=300, tol=1e-8) -> DataFrame:
    """``n_clusters, silhouette, inertia`` of a cross-section."""

    def kernel(x: np.ndarray, k: int) -> dict:
        if not 2 <= k <= len(x) - 1:
            raise ValueError(f"invalid candidate n_clusters={k} for {len(x)} points")
        _, label, inertia, _ = lloyd(x, farthest_first(x, k), max_iter, tol)
        return {"silhouette": _silhouette(x, label, k), "inertia": inertia}

    return _per_candidate(df, entity, features, candidates, [("silhouette", T.DoubleType()), ("inertia", T.DoubleType())], "n_clusters", kernel)
