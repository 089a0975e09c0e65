"""Summaries, assignments and scores of models, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.measures import nonzero


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest(points: DataFrame, centroids: DataFrame, features: str = "features", k: str = "k", centre: str = "centre") -> DataFrame:
    """``points`` with ``label`` and ``dist2``; the lowest number among equals. A centroid may have several rows.

    Centroids are gathered into one array: their number is the model's, not the data's.
    """
    held = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), F.col(centre).alias("c")))).alias("_held"))
    far = F.transform("_held", lambda h: F.struct(squared(F.col(features), h["c"]).alias("d"), h["k"].alias("k")))
    best = F.array_min(far)
    out = points.crossJoin(F.broadcast(held)).withColumn("_best", best)
    return out.withColumn("label", F.col("_best.k").cast("long")).withColumn("dist2", F.col("_best.d")).drop("_held", "_best")


def centroid_distances(points: DataFrame, centroids: DataFrame, features: str = "features", k: str = "k", centre: str = "centre") -> DataFrame:
    """A row per point and centroid number: the distance to the nearest of its remembered places. No point is exchanged."""
    keys = [c for c in points.columns if c != features]
    held = bank(centroids, (), k, centre)
    found = points.crossJoin(F.broadcast(held)).select(*keys, F.inline(distances(F.col(features), F.col("_held"))))
    return found.withColumnsRenamed({"_k": "k", "_d": "distance"})


def bank(centroids: DataFrame, group: Sequence[str] = (), k: str = "k", centre: str = "centre") -> DataFrame:
    """``group, _held``: every centroid number with all its places, in one array."""
    places = centroids.groupBy(*group, F.col(k).alias("_k")).agg(F.collect_list(centre).alias("_places"))
    return places.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_k", "_places"))).alias("_held"))


def distances(x: Column, held: Column) -> Column:
    """``_k, _d`` of every centroid: the distance of ``x`` to the nearest of its places."""
    far = lambda places: F.sqrt(F.array_min(F.transform(places, lambda c: squared(x, c))))
    return F.transform(held, lambda h: F.struct(h["_k"].alias("_k"), far(h["_places"]).alias("_d")))


def spells(labels: DataFrame, group: Sequence[str], ts: str, label: str = "label") -> DataFrame:
    """Runs of equal labels: ``group, label, start, end, length``; the last one may still go on."""
    w = Window.partitionBy(*group).orderBy(ts)
    runs = labels.withColumn("_new", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run", label).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def regime_summary(labels: DataFrame, group: Sequence[str], ts: str, features: Sequence[str], label: str = "label") -> DataFrame:
    """Per regime: its share of labelled rows, spells, and each feature's mean and deviation."""
    own = labels.where(F.col(label) >= 0)
    facts = own.groupBy(*group, label).agg(
        F.count(F.lit(1)).alias("_n"), *(x for f in features for x in (F.avg(f).alias(f"mean_{f}"), F.stddev_samp(f).alias(f"std_{f}")))
    )
    total = F.sum("_n").over(Window.partitionBy(*group)) if group else F.sum("_n").over(Window.partitionBy(F.lit(0)))
    facts = facts.withColumn("share", F.col("_n") / total).drop("_n")
    runs = spells(labels, group, ts, label).where(F.col(label) >= 0)
    runs = runs.groupBy(*group, label).agg(F.avg("length").alias("avg_spell"), F.count(F.lit(1)).alias("n_spells"))
    return facts.join(runs, [*group, label])


def moves(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Labels with ``before``: the entity's label in the period just before, NULL where it was absent; ``number``: of periods."""
    periods = labels.select(*group, "period").distinct()
    order = Window.partitionBy(*group).orderBy("period") if group else Window.partitionBy(F.lit(0)).orderBy("period")
    numbered = labels.join(periods.withColumn("number", F.row_number().over(order)), [*group, "period"])
    w = Window.partitionBy(*group, "entity").orderBy("number")
    near = F.lag("number").over(w) == F.col("number") - 1
    return numbered.withColumn("before", F.when(near, F.lag("label").over(w)))


def cluster_summary(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per cluster: share of cells, members at the end, moves in (also from absence), switches per cell.

    Where ``labels`` has the periods' ``centroids``, ``centroid`` is the last period's.
    """
    facts = [F.max("period").alias("_last")]
    if "centroids" in labels.columns:
        facts.append(F.max_by("centroids", "period").alias("_centroids"))
    last = F.broadcast(labels.agg(*facts)) if not group else labels.groupBy(*group).agg(*facts)
    with_last = lambda df: df.join(last, list(group)) if group else df.crossJoin(last)
    rows = with_last(moves(labels.drop("centroids"), group))
    out = rows.groupBy(*group, "label").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("period") == F.col("_last")).alias("n_final"),
        F.count_if((F.col("number") > 1) & (F.col("before").isNull() | (F.col("before") != F.col("label")))).alias("moves_in"),
        F.count_if(F.col("before") != F.col("label")).alias("_switches"),
    )
    total = F.sum("_n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    out = out.withColumn("share", F.col("_n") / total).withColumn("switch_rate", F.col("_switches") / F.col("_n")).drop("_n", "_switches")
    if "centroids" in labels.columns:
        out = with_last(out).withColumn("centroid", F.get("_centroids", F.col("label").cast("int"))).drop("_last", "_centroids")
    return out


def labels_frame(labels: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """Periods by entities; -1 where an entity is absent."""
    wide = labels.groupBy("period").pivot("entity", None if entities is None else list(entities)).agg(F.first("label"))
    return wide.select("period", *(F.coalesce(F.col(f"`{c}`"), F.lit(-1)).alias(c) for c in wide.columns if c != "period"))


#: Points in a side of the grid of distances.
SIDE = 2048


def silhouette(points: DataFrame, key: str, label: str = "label", features: str = "features") -> DataFrame:
    """``key, label, silhouette`` of every point, by distances to all points; a lone member has zero.

    The distances are a grid of blocks of points, one matrix at a time; only their sums per point and cluster leave a
    task. This is quadratic in the points by definition, so it is for cross-sections.
    """
    import numpy as np
    import pandas as pd

    rows = points.select(F.col(key).alias("k"), F.col(label).cast("long").alias("l"), F.col(features).cast("array<double>").alias("x"))
    sides = max(1, -(-rows.count() // SIDE))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("k"), F.lit(sides)).cast("int"))
    all_sides = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    left = rows.withColumnRenamed("side", "i").withColumn("j", all_sides)
    right = rows.withColumnRenamed("side", "j").withColumn("i", all_sides)

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"k": a["k"][:0], "l": a["l"][:0], "other": a["l"][:0], "total": np.empty(0), "n": a["l"][:0]})
        x, y = np.array(a["x"].tolist(), float), np.array(b["x"].tolist(), float)
        names, of = np.unique(b["l"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(x), len(names)))
        for start in range(0, len(x), 16):  # exact differences: no cancellation between points that are close
            part = np.sqrt(((x[start : start + 16, None] - y[None]) ** 2).sum(axis=2))
            for c in range(len(names)):
                sums[start : start + 16, c] = part[:, of == c].sum(axis=1)
        size = np.bincount(of, minlength=len(names))
        return pd.DataFrame(
            {
                "k": np.repeat(a["k"].to_numpy(), len(names)), "l": np.repeat(a["l"].to_numpy(), len(names)), "other": np.tile(names, len(x)),
                "total": sums.ravel(), "n": np.tile(size, len(x)),
            }
        )

    schema = f"k {rows.schema['k'].dataType.simpleString()}, l long, other long, total double, n long"
    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(block, schema)
    sums = sums.groupBy("k", "l", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("l")
    mean = F.col("total") / nonzero((F.col("n") - F.when(own, 1).otherwise(0)).cast("double"))
    ends = sums.groupBy("k", "l").agg(F.min(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    score = F.coalesce((F.col("b") - F.col("a")) / nonzero(F.greatest("a", "b")), F.lit(0.0))
    return ends.select(F.col("k").alias(key), F.col("l").alias(label), F.when(F.col("a").isNull(), 0.0).otherwise(score).alias("silhouette"))


def rotation(pairs: DataFrame, group: Sequence[str], reference: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """The turn that brings points of a plane onto others, about their means, and what is left: ``angle, disparity``.

    The closed form of a Procrustes fit without mirroring: sums only, so it is one aggregation at any size.
    """
    (rx, ry), (cx, cy) = ((F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (reference, current))
    cov = lambda a, b: F.covar_pop(a, b)
    sums = pairs.groupBy(*group).agg(
        (cov(cx, rx) + cov(cy, ry)).alias("_c"), (cov(cx, ry) - cov(cy, rx)).alias("_s"), (F.var_pop(cx) + F.var_pop(cy)).alias("_v"), (F.var_pop(rx) + F.var_pop(ry)).alias("_w")
    )
    left = F.col("_v") + F.col("_w") - 2 * F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    return sums.select(*group, F.atan2("_s", "_c").alias("angle"), F.sqrt(F.greatest(left, F.lit(0.0))).alias("disparity"))


def episodes(df: DataFrame, by: str, n: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the lowest ``by``; a report, so the limit is the point."""
    return df.where(F.col(by).isNotNull()).orderBy(by, *ties).limit(n)


def crosstab(df: DataFrame, rows: str, columns: str, names: Sequence[str] | None = None) -> DataFrame:
    """How many rows have each pair of values; zero where none has. Give the names to save a pass over the data."""
    wide = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows).pivot(columns, None if names is None else list(names)).agg(F.count(F.lit(1)))
    return wide.fillna(0, [c for c in wide.columns if c != rows])


def conditioned(df: DataFrame, by: str, q: float, values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """``group, high``: mean, deviation and count of values where ``by`` is above its quantile ``q``, and where not.

    The quantile is interpolated and exact: its aggregation holds the distinct values of a group, so groups are series.
    """
    at = df.groupBy(*group).agg(F.percentile(by, q).alias("_q"))
    joined = df.join(at, list(group)) if group else df.crossJoin(F.broadcast(at))
    known = joined.where(F.col(by).isNotNull()).withColumn("high", F.col(by) > F.col("_q"))
    facts = (x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"std_{v}"), F.count(v).alias(f"n_{v}")))
    return known.groupBy(*group, "high").agg(*facts)


def inertia(assigned: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return assigned.groupBy(*group).agg(F.sum("dist2").alias("inertia"))
