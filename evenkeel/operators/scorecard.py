"""Scorecard: how series compare with a target, measure by measure, and which is best overall. All in Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.measures import EPS, MEASURES, Measure, measure_table, nonzero
from evenkeel.sources.panels import pivoted

#: The default battery: name → measure of the registry.
BATTERY = {
    "cagr": "cagr", "sharpe": "sharpe", "sortino": "sortino", "calmar": "calmar", "max_drawdown": "max_drawdown", "ann_vol": "ann_vol",
    "cvar_95": "cvar_hist", "skewness": "skewness", "hit_rate": "hit_rate", "information_ratio": "information_ratio",
    "tracking_error": "tracking_error", "up_capture": "up_capture", "down_capture": "down_capture",
}
#: Relative measures whose neutral value is one; the others' is zero.
NEUTRAL_ONE = ("up_capture", "down_capture")


def default_measures() -> dict[str, Measure]:
    return {name: MEASURES[of] for name, of in BATTERY.items()}


class Scorecard:
    """``measures``: name → Measure; ``weights``: name → weight, one where not given."""

    def __init__(self, measures: Mapping[str, Measure] | None = None, weights: Mapping[str, float] | None = None, ppy: float = 252) -> None:
        self.measures = dict(default_measures() if measures is None else measures)
        given = {n: float((weights or {}).get(n, 1.0)) for n in self.measures}
        total = sum(given.values())
        if any(w < 0 for w in given.values()) or total <= 0:
            raise ValueError("weights must not be negative, nor all zero")
        self.weights, self.ppy = {n: w / total for n, w in given.items()}, ppy

    def values(self, returns: DataFrame, target: DataFrame, series: str = "series", ts: str = "ts", ret: str = "ret") -> DataFrame:
        """``asset, measure, value, target_value, score, weight``.

        A score is how much better than the target, relative to the target's size; where that is nothing, relative to
        the mean size over assets.
        """
        names = list(self.measures)
        long = lambda df, value: df.unpivot(["series"], [F.col(n) for n in names if n in df.columns], "measure", value)
        own = long(measure_table(returns, target, names, self.ppy, series, ts, ret, registry=self.measures), "value")
        absolute = [n for n in names if not self.measures[n].relative]
        wanted = target.select(F.lit("target").alias("series"), F.col(ts).alias("ts"), F.col(ret).alias("ret"))
        facts = F.create_map(
            *(
                x
                for n in names
                for x in (
                    F.lit(n),
                    F.struct(
                        F.lit(1.0 if self.measures[n].higher_is_better else -1.0).alias("turn"),
                        F.lit(self.weights[n]).alias("weight"),
                        F.lit(1.0 if n in NEUTRAL_ONE else 0.0).alias("neutral"),
                        F.lit(self.measures[n].relative).alias("relative"),
                    ),
                )
            )
        )
        own = own.withColumn("f", F.element_at(facts, F.col("measure")))
        if absolute:
            aim = long(measure_table(wanted, None, absolute, self.ppy, registry=self.measures), "aim").select("measure", "aim")
            own = own.join(F.broadcast(aim), "measure", "left")  # a row per measure
        else:
            own = own.withColumn("aim", F.lit(None).cast("double"))
        aim = F.when(F.col("f.relative"), F.col("f.neutral")).otherwise(F.col("aim"))
        own = own.withColumn("target_value", aim)
        sizes = own.groupBy("measure").agg(F.avg(F.abs("value")).alias("spread"))
        own, spread = own.join(F.broadcast(sizes), "measure"), F.col("spread")  # a row per measure
        usable = F.col("target_value").isNotNull() & (F.abs("target_value") >= EPS) & (F.abs("target_value") < float("inf"))
        below = F.when(usable, F.abs("target_value")).otherwise(F.when(spread >= EPS, spread).otherwise(1.0))
        score = F.col("f.turn") * (F.col("value") - F.col("target_value")) / below
        return own.select(F.col("series").alias("asset"), "measure", "value", "target_value", score.alias("score"), F.col("f.weight").alias("weight"))

    def summary(self, values: DataFrame) -> DataFrame:
        """``asset, composite, dispersion, rank``: the weighted mean score, its weighted deviation, and the order."""
        given = values.where("score is not null and weight > 0")
        sums = given.groupBy("asset").agg(
            F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("score")).alias("s"),
        )
        sums = sums.withColumn("composite", F.col("s") / nonzero(F.col("w"))).select("asset", "composite", "w")
        apart = given.join(sums, "asset").groupBy("asset").agg(F.sqrt(F.sum(F.col("weight") * F.pow(F.col("score") - F.col("composite"), 2)) / nonzero(F.first("w"))).alias("dispersion"))
        everyone = values.select("asset").distinct()
        out = everyone.join(sums.drop("w"), "asset", "left").join(apart, "asset", "left")
        return ranked(out, "composite", "asset")

    def compare(self, returns: DataFrame, target: DataFrame, names: Sequence[str] | None = None, **columns) -> tuple[DataFrame, DataFrame]:
        """Values and summary, once times (and ``names``, if given) are found to fit."""
        checked(returns, target, columns.get("ts", "ts"), columns.get("series", "series"), names)
        values = self.values(returns, target, **columns)
        return values, self.summary(values)

    def frame(self, values: DataFrame, column: str = "value") -> DataFrame:
        """Assets by measures."""
        return pivoted(values, "asset", "measure", column, list(self.measures))


#: Ranges of scores that are ranked apart.
RANGES = 200


def ranked(df: DataFrame, by: str, tie: str, into: str = "rank") -> DataFrame:
    """Rows numbered from 1, the highest first, ties by name, nulls last. Ranges are ranked apart and their sizes added up."""
    bounds = df.agg(F.percentile_approx(by, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_bounds"))
    above = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b > F.col(by)))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.when(F.col(by).isNull(), RANGES).otherwise(above)).drop("_bounds")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc_nulls_last(by), tie))
    return placed.join(F.broadcast(before), "_range").withColumn(into, (F.col("_before") + own).cast("long")).drop("_range", "_before")


def checked(returns: DataFrame, target: DataFrame, ts: str = "ts", series: str = "series", names: Sequence[str] | None = None) -> None:
    """Raise where times of the target repeat, where a series has other times, or a named series is absent."""
    if not target.groupBy(ts).count().where("count > 1").isEmpty():
        raise ValueError("the target has to have one row for each time")
    if not returns.select(ts).distinct().join(target.select(ts), ts, "left_anti").isEmpty():
        raise ValueError("returns and target differ in their times")
    if names is not None:
        known = {row[0] for row in returns.select(series).distinct().limit(len(set(names)) + 1).collect()}
        if known != set(names):
            raise ValueError("names and series differ")
