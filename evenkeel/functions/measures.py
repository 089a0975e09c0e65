"""The performance measures as columns over a prepared frame.

``prepared`` adds what more than one measure needs: guarded log growth, the benchmark beside each return, centred
products. Each measure is then one aggregate expression; whole tables of measures share a single aggregation. Undefined
values are NULL. Returns are simple and periodic; ``ppy`` is periods per year.

Kept conventions: a growth of -100 % is a log of minus infinity (and total return -1); the peak of a drawdown starts at
the first value of wealth, not before it (a wipe-out in the first row makes the whole path undefined: NULL); beta and
correlation centre each series by its own mean and divide by full variances, also where one of the two is missing;
captures count masked benchmark rows even where the return is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.sources.panels import number

EPS = 1e-12


def log_growth(r: Column) -> Column:
    return F.when(r == -1, F.lit(float("-inf"))).otherwise(F.log1p(r))


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def compounded(logs: Column) -> Column:
    return F.exp(F.coalesce(F.sum(logs), F.lit(0.0))) - 1


def r() -> Column:
    """The return."""
    return F.col("r")


def lr() -> Column:
    return F.col("lr")


def b() -> Column:
    """The benchmark's return."""
    return F.col("b")


def lb() -> Column:
    return F.col("lb")


def total_return() -> Column:
    return compounded(lr())


def cagr(ppy: float = 252) -> Column:
    growth, n = 1 + compounded(lr()), F.count(r())
    return F.when((growth > 0) & (n > 0), F.pow(F.greatest(growth, F.lit(EPS)), F.lit(float(ppy)) / nonzero(n.cast("double"))) - 1)


def ann_return(ppy: float = 252) -> Column:
    return F.avg(r()) * ppy


def _std(x: Column, ddof: int) -> Column:
    return F.stddev_samp(x) if ddof == 1 else F.sqrt(F.var_pop(x) * F.count(x) / nonzero((F.count(x) - ddof).cast("double")))


def ann_vol(ppy: float = 252, ddof: int = 1) -> Column:
    return _std(r(), ddof) * F.sqrt(F.lit(float(ppy)))


def downside_vol(mar: float = 0.0, ppy: float = 252) -> Column:
    return F.sqrt(F.avg(F.when(r().isNotNull(), F.pow(F.least(r() - mar, F.lit(0.0)), 2)))) * F.sqrt(F.lit(float(ppy)))


def sharpe(rf: float = 0.0, ppy: float = 252, of: Column | None = None) -> Column:
    of = r() if of is None else of
    sd = F.stddev_samp(of)
    return F.when(sd > EPS**2, (F.avg(of) - rf / ppy) * F.sqrt(F.lit(float(ppy))) / nonzero(sd))


def sortino(mar: float = 0.0, ppy: float = 252) -> Column:
    return (F.avg(r()) - mar / ppy) * ppy / nonzero(downside_vol(mar / ppy, ppy))


def max_drawdown() -> Column:
    return F.min("dd")


def calmar(ppy: float = 252) -> Column:
    return cagr(ppy) / nonzero(F.abs(F.min("dd")))


def var_hist(alpha: float = 0.05) -> Column:
    return -F.expr(f"percentile_disc({alpha}) within group (order by r)")


def cvar_hist(alpha: float = 0.05) -> Column:
    """Needs ``q``, the series' quantile at ``alpha``."""
    return -F.avg(F.when(r() <= F.col("q"), r()))


def skewness() -> Column:
    return F.when(F.var_pop(r()) > 0, F.skewness(r()))


def kurtosis() -> Column:
    return F.when(F.var_pop(r()) > 0, F.kurtosis(r()))


def hit_rate() -> Column:
    return F.count_if(r() > 0) / nonzero(F.count(r()).cast("double"))


def gain_to_pain() -> Column:
    return F.sum(F.when(r() > 0, r()).when(r().isNotNull(), 0.0)) / nonzero(F.abs(F.sum(F.when(r() < 0, r()).when(r().isNotNull(), 0.0))))


def best_period() -> Column:
    return F.max(r())


def worst_period() -> Column:
    return F.min(r())


def active_return(ppy: float = 252) -> Column:
    return F.avg(r() - b()) * ppy


def tracking_error(ppy: float = 252) -> Column:
    return F.stddev_samp(r() - b()) * F.sqrt(F.lit(float(ppy)))


def information_ratio(ppy: float = 252) -> Column:
    return sharpe(0.0, ppy, r() - b())


def beta() -> Column:
    """Needs ``mr`` and the benchmark's ``mb`` and ``vb``."""
    return F.avg((r() - F.col("mr")) * (b() - F.col("mb"))) / nonzero(F.first("vb"))


def alpha(rf: float = 0.0, ppy: float = 252) -> Column:
    free = rf / ppy
    return ((F.avg(r()) - free) - beta() * (F.first("mb") - free)) * ppy


def _capture(up: bool) -> Column:
    masked = b() > 0 if up else b() < 0
    n = F.first("n_up" if up else "n_down")
    own = F.exp(F.coalesce(F.sum(F.when(masked, lr())), F.lit(0.0)) / nonzero(n.cast("double"))) - 1
    market = F.first("g_up" if up else "g_down")
    return F.when(F.abs(market) > EPS, own / nonzero(market))


def up_capture() -> Column:
    return _capture(True)


def down_capture() -> Column:
    return _capture(False)


def correlation() -> Column:
    return F.avg((r() - F.col("mr")) * (b() - F.col("mb"))) / nonzero(F.sqrt(F.var_pop(r())) * F.sqrt(F.first("vb")))


@dataclass(frozen=True)
class Measure:
    """A measure of the registry. ``needs``: what ``prepared`` has to add. ``make`` may be any Column builder,

    or a grouped-aggregate pandas UDF applied to ``r`` (and ``b``) for functions that Spark can't express.
    """

    make: Callable[..., Column]
    higher_is_better: bool = True
    relative: bool = False
    kwargs: tuple = ()
    needs: frozenset[str] = field(default=frozenset())


def _m(make: Callable[..., Column], better: bool = True, relative: bool = False, needs: str = "") -> Measure:
    return Measure(make, better, relative, (), frozenset(needs.split()))


MEASURES: dict[str, Measure] = {
    "total_return": _m(total_return), "cagr": _m(cagr), "ann_return": _m(ann_return), "ann_vol": _m(ann_vol, False),
    "downside_vol": _m(downside_vol, False), "sharpe": _m(sharpe), "sortino": _m(sortino), "max_drawdown": _m(max_drawdown, needs="path"),
    "calmar": _m(calmar, needs="path"), "var_hist": _m(var_hist, False), "cvar_hist": _m(cvar_hist, False, needs="tail"),
    "skewness": _m(skewness), "kurtosis": _m(kurtosis, False), "hit_rate": _m(hit_rate), "gain_to_pain": _m(gain_to_pain),
    "best_period": _m(best_period), "worst_period": _m(worst_period), "active_return": _m(active_return, relative=True),
    "tracking_error": _m(tracking_error, False, True), "information_ratio": _m(information_ratio, relative=True),
    "beta": _m(beta, relative=True, needs="centre"), "alpha": _m(alpha, relative=True, needs="centre"),
    "up_capture": _m(up_capture, relative=True, needs="centre"), "down_capture": _m(down_capture, False, True, needs="centre"),
    "correlation": _m(correlation, relative=True, needs="centre"),
}
#: Names that are given the periods per year.
PPY_AWARE = ("cagr", "ann_return", "ann_vol", "downside_vol", "sharpe", "sortino", "calmar", "active_return", "tracking_error", "information_ratio", "alpha")


def with_drawdown(df: DataFrame, group: Sequence[str] = ("series",), ts: str = "ts") -> DataFrame:
    """``dd``: the distance from the running peak of wealth. Both windows share one sort."""
    w = Window.partitionBy(*group).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_wealth", F.sum(F.coalesce(lr(), F.lit(0.0))).over(w))
    # a wipe-out from the start has no peak to fall from
    fall = F.when(F.max("_wealth").over(w) > float("-inf"), F.expm1(F.col("_wealth") - F.max("_wealth").over(w)))
    return df.withColumn("dd", fall).drop("_wealth")


def prepared(
    returns: DataFrame, benchmark: DataFrame | None = None, series: str = "series", ts: str = "ts", ret: str = "ret", tail: float = 0.05, needs: frozenset[str] = frozenset(("path", "tail", "centre"))
) -> DataFrame:
    """``series, ts, r, lr`` with what ``needs`` names, and ``b, lb`` beside them where there is a benchmark.

    The benchmark has one row per time; its moments are one row, whatever the number of series.
    """
    df = returns.select(F.col(series).alias("series"), F.col(ts).alias("ts"), number(ret).alias("r")).withColumn("lr", log_growth(r()))
    if benchmark is not None:
        own = benchmark.select(F.col(ts).alias("ts"), number(ret).alias("b")).withColumn("lb", log_growth(b()))
        df = df.join(own, "ts", "left")
        if "centre" in needs:
            growth = lambda on: F.exp(F.sum(F.when(on, lb())) / nonzero(F.count_if(on).cast("double"))) - 1
            moments = own.agg(
                F.avg(b()).alias("mb"), F.var_pop(b()).alias("vb"), F.count_if(b() > 0).alias("n_up"), F.count_if(b() < 0).alias("n_down"),
                growth(b() > 0).alias("g_up"), growth(b() < 0).alias("g_down"),
            )
            df = df.crossJoin(F.broadcast(moments))  # one row
    if "path" in needs:
        df = with_drawdown(df)
    if needs & {"tail", "centre"}:
        stats = df.groupBy("series").agg(F.expr(f"percentile_disc({tail}) within group (order by r)").alias("q"), F.avg(r()).alias("mr"))
        df = df.join(stats, "series")
    return df


def measure_table(
    returns: DataFrame, benchmark: DataFrame | None = None, names: Sequence[str] | None = None, ppy: float = 252, series: str = "series", ts: str = "ts", ret: str = "ret", registry: dict[str, Measure] = MEASURES
) -> DataFrame:
    """One row per series, one column per measure."""
    names = [n for n in registry if benchmark is not None or not registry[n].relative] if names is None else list(names)
    if missing := [n for n in names if registry[n].relative and benchmark is None]:
        raise ValueError(f"without a benchmark there is no {missing[0]}")
    needs = frozenset().union(*(registry[n].needs for n in names)) if names else frozenset()
    df = prepared(returns, benchmark, series, ts, ret, needs=needs)
    build = lambda n: registry[n].make(**({"ppy": ppy} if n in PPY_AWARE else {}) | dict(registry[n].kwargs))
    return df.groupBy("series").agg(*(build(n).cast("double").alias(n) for n in names))
