"""Rolling statistics and features; all windows count rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def rows(group: Sequence[str], ts: str, window: int) -> WindowSpec:
    if window < 1:
        raise ValueError(f"window must be 1 or more; got {window}")
    return Window.partitionBy(*group).orderBy(ts).rowsBetween(-(window - 1), 0)


def full(value: Column, group: Sequence[str], ts: str, window: int) -> Column:
    """NULL until the window has all its rows, whatever is in them."""
    return F.when(F.row_number().over(Window.partitionBy(*group).orderBy(ts)) >= window, value)


def rolling_mean(x: Column, group: Sequence[str], ts: str, window: int) -> Column:
    return full(F.avg(x).over(rows(group, ts, window)), group, ts, window)


def rolling_vol(x: Column, group: Sequence[str], ts: str, window: int, ppy: float = 252) -> Column:
    return full(F.stddev_samp(x).over(rows(group, ts, window)) * F.sqrt(F.lit(float(ppy))), group, ts, window)


def rolling_sharpe(x: Column, group: Sequence[str], ts: str, window: int, rf: float = 0.0, ppy: float = 252) -> Column:
    w = rows(group, ts, window)
    sd = F.stddev_samp(x).over(w)
    return full(F.when(sd > 0, (F.avg(x).over(w) - rf / ppy) * F.sqrt(F.lit(float(ppy))) / F.nullif(sd, F.lit(0.0))), group, ts, window)


def rolling_beta(x: Column, market: Column, group: Sequence[str], ts: str, window: int) -> Column:
    w = rows(group, ts, window)
    return full(F.covar_samp(x, market).over(w) / F.nullif(F.var_samp(market).over(w), F.lit(0.0)), group, ts, window)


def rolling_covariance(x: Column, y: Column, group: Sequence[str], ts: str, window: int) -> Column:
    return full(F.covar_samp(x, y).over(rows(group, ts, window)), group, ts, window)


def rolling_min(x: Column, group: Sequence[str], ts: str, window: int) -> Column:
    """The least of a full window that lacks nothing."""
    w = rows(group, ts, window)
    return F.when(F.count(x).over(w) == window, F.min(x).over(w))


def forward_sum(x: Column, group: Sequence[str], ts: str, n: int) -> Column:
    """The sum of the next ``n`` rows; NULL where there are fewer, or one is NULL."""
    if n < 1:
        raise ValueError(f"n must be 1 or more; got {n}")
    w = Window.partitionBy(*group).orderBy(ts).rowsBetween(1, n)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w))


def active(x: Column, group: Sequence[str], ts: str, window: int) -> Column:
    """The feature is there in every row of a full window."""
    return F.count(x).over(rows(group, ts, window)) == window


def simple_returns(price: Column, group: Sequence[str], ts: str) -> Column:
    return F.try_divide(price, F.lag(price).over(Window.partitionBy(*group).orderBy(ts))) - 1


def zscore(x: Column, period: Sequence[str]) -> Column:
    """Within a period's cross-section, by the population deviation."""
    w = Window.partitionBy(*period)
    return (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))


def period_ends(df: DataFrame, entity: Sequence[str], ts: str, every: str = "month") -> DataFrame:
    """Each entity's last row at or before the end of each period."""
    last = F.row_number().over(Window.partitionBy(*entity, F.date_trunc(every, ts)).orderBy(F.col(ts).desc()))
    return df.withColumn("_last", last).where("_last = 1").drop("_last")


def scaled_exposure(p_calm: Column, group: Sequence[str], ts: str, floor: float = 0.35) -> Column:
    """How much to hold, from the calm probability known the row before."""
    before = F.lag(p_calm).over(Window.partitionBy(*group).orderBy(ts))
    return F.when(before.isNotNull(), F.least(F.greatest(floor + (1 - floor) * before, F.lit(0.0)), F.lit(1.0)))


def ew_volatility(df: DataFrame, group: Sequence[str], ts: str, value: str, span: float = 10, into: str = "ew_vol") -> DataFrame:
    """Bias-corrected exponentially weighted deviation, recursive over each group: a grouped kernel."""
    schema = df.select(*group, ts, value).schema.add(into, "double")

    def kernel(pdf):
        pdf = pdf.sort_values(ts, kind="stable")
        return pdf.assign(**{into: pdf[value].ewm(span=span).std()})

    return df.select(*group, ts, value).groupBy(*group).applyInPandas(kernel, schema)
