"""Named queries over the test tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions import measures as ms
from evenkeel.functions import rolling as ro
from evenkeel.operators import models, select, summaries
from evenkeel.operators.scorecard import Scorecard
from evenkeel.sources import simulate
from evenkeel.sources.panels import market_returns, melted, number, pivoted

PPY = 12
DIGITS = 6


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rounded, with negative zero as zero, so that engines agree."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + 0.0 for c in columns})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_returns(spark, sf_dir, ("l_returnflag",)).where("ret is not null")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_returns(spark, sf_dir, ()).where("ret is not null").select("ts", "ret")


#: The returns of each flag and of the whole market, as ``rr`` and ``mk``.
RETURNS = """
px as (select l_returnflag as series, date_trunc('month', l_shipdate)::date as ts, avg(l_extendedprice) as px from lineitem group by all),
rr as (select * from (select series, ts, px / nullif(lag(px) over (partition by series order by ts), 0) - 1 as r from px) where r is not null),
mpx as (select date_trunc('month', l_shipdate)::date as ts, avg(l_extendedprice) as px from lineitem group by all),
mk as (select * from (select ts, px / nullif(lag(px) over (order by ts), 0) - 1 as b from mpx) where b is not null)
"""


def r_sql(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 as {name}"


CAGR = f"pow(exp(sum(ln(1 + r))), {PPY}.0 / count(r)) - 1"
DOWN = f"sqrt(avg(pow(least(r, 0), 2))) * sqrt({PPY})"
SHARPE = f"avg(r) * sqrt({PPY}) / nullif(stddev_samp(r), 0)"
MOMENT = lambda k: f"avg(pow(r - m, {k}))"
VALUES = {
    "total_return": "exp(sum(ln(1 + r))) - 1", "cagr": CAGR, "ann_return": f"avg(r) * {PPY}", "ann_vol": f"stddev_samp(r) * sqrt({PPY})",
    "downside_vol": DOWN, "sharpe": SHARPE, "sortino": f"avg(r) * {PPY} / nullif({DOWN}, 0)", "var_hist": "-quantile_disc(r, 0.05)",
    "hit_rate": "count(*) filter (where r > 0) / count(r)", "gain_to_pain": "sum(greatest(r, 0)) / nullif(abs(sum(least(r, 0))), 0)",
    "best_period": "max(r)", "worst_period": "min(r)",
}
SHAPES = {"skewness": f"{MOMENT(3)} / nullif(pow({MOMENT(2)}, 1.5), 0)", "kurtosis": f"{MOMENT(4)} / nullif(pow({MOMENT(2)}, 2), 0) - 3"}
PATH = """
wealth as (select *, sum(ln(1 + r)) over (partition by series order by ts) as w from rr),
path as (select *, exp(w - max(w) over (partition by series order by ts)) - 1 as dd from wealth)
"""
STATS = """
st as (select series, avg(r) as mr, quantile_disc(r, 0.05) as q from rr group by series),
mo as (select avg(b) as mb, var_pop(b) as vb, count(*) filter (where b > 0) as n_up, count(*) filter (where b < 0) as n_down,
  exp(sum(ln(1 + b)) filter (where b > 0) / count(*) filter (where b > 0)) - 1 as g_up,
  exp(sum(ln(1 + b)) filter (where b < 0) / count(*) filter (where b < 0)) - 1 as g_down from mk),
jo as (select * from rr left join mk using (ts) join st using (series) cross join mo)
"""
BETA = "avg((r - mr) * (b - mb)) / nullif(first(vb), 0)"
RELATIVE = {
    "active_return": f"avg(r - b) * {PPY}", "tracking_error": f"stddev_samp(r - b) * sqrt({PPY})",
    "information_ratio": f"avg(r - b) * sqrt({PPY}) / nullif(stddev_samp(r - b), 0)", "beta": BETA,
    "alpha": f"(avg(r) - {BETA} * first(mb)) * {PPY}",
    "up_capture": "(exp(sum(ln(1 + r)) filter (where b > 0) / first(n_up)) - 1) / nullif(first(g_up), 0)",
    "down_capture": "(exp(sum(ln(1 + r)) filter (where b < 0) / first(n_down)) - 1) / nullif(first(g_down), 0)",
    "correlation": "avg((r - mr) * (b - mb)) / nullif(sqrt(var_pop(r) * first(vb)), 0)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: Sequence[str] = ()):
    """Register a query; ``dates`` are given as text, which every engine writes alike."""

    def keep(f):
        QUERIES[name] = (lambda s, d: f(s, d).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if sql is not None:
            text = ", ".join(f'"{c}"::varchar as "{c}"' for c in dates)
            ORACLE_SQL[name] = f"select * replace ({text}) from ({sql})" if dates else sql
        return f

    return keep


def _measures(names: Sequence[str], relative: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = ms.measure_table(flags(spark, sf_dir), market(spark, sf_dir) if relative else None, names, PPY)
        return rounded(table, names)

    return run


# measures

query("measures_core", f"with {RETURNS} select series, {', '.join(r_sql(e, n) for n, e in VALUES.items())} from rr group by series")(_measures(list(VALUES)))
query(
    "measures_shape",
    f"with {RETURNS}, c as (select *, avg(r) over (partition by series) as m from rr) select series, {', '.join(r_sql(e, n) for n, e in SHAPES.items())} from c group by series",
)(_measures(list(SHAPES)))
query(
    "measures_drawdown",
    f"with {RETURNS}, {PATH} select series, {r_sql('min(dd)', 'max_drawdown')}, {r_sql(f'({CAGR}) / nullif(abs(min(dd)), 0)', 'calmar')} from path group by series",
)(_measures(["max_drawdown", "calmar"]))
query("measures_cvar", f"with {RETURNS}, {STATS} select series, {r_sql('-avg(r) filter (where r <= q)', 'cvar_hist')} from jo group by series")(_measures(["cvar_hist"]))
query("measures_relative", f"with {RETURNS}, {STATS} select series, {', '.join(r_sql(e, n) for n, e in RELATIVE.items())} from jo group by series")(
    _measures(list(RELATIVE), relative=True)
)


@query("drawdown_path", f"with {RETURNS}, {PATH} select series, ts, {r_sql('dd', 'drawdown')} from path", dates=["ts"])
def drawdown_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms.prepared(flags(spark, sf_dir), needs=frozenset(("path",)))
    return rounded(rows.select("series", "ts", F.col("dd").alias("drawdown")), ["drawdown"])


W = 12


@query(
    "rolling_measures",
    f"""with {RETURNS}, n as (select *, row_number() over (partition by series order by ts) as k,
    avg(r) over w as m, stddev_samp(r) over w as s from rr window w as (partition by series order by ts rows {W - 1} preceding))
    select series, ts, round(case when k >= {W} then m end, 6) + 0.0 as mean, round(case when k >= {W} then s * sqrt({PPY}) end, 6) + 0.0 as vol,
    round(case when k >= {W} then m * sqrt({PPY}) / nullif(s, 0) end, 6) + 0.0 as sharpe from n""", dates=["ts"])
def rolling_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, g, x = flags(spark, sf_dir), ["series"], F.col("ret")
    found = rows.select(
        "series", "ts", ro.rolling_mean(x, g, "ts", W).alias("mean"), ro.rolling_vol(x, g, "ts", W, PPY).alias("vol"),
        ro.rolling_sharpe(x, g, "ts", W, 0.0, PPY).alias("sharpe"),
    )
    return rounded(found, ["mean", "vol", "sharpe"])


@query(
    "rolling_beta",
    f"""with {RETURNS}, n as (select series, ts, row_number() over (partition by series order by ts) as k, covar_samp(r, b) over w / nullif(var_samp(b) over w, 0) as beta
    from rr join mk using (ts) window w as (partition by series order by ts rows {W - 1} preceding))
    select series, ts, round(case when k >= {W} then beta end, 6) + 0.0 as beta from n""", dates=["ts"])
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir).join(market(spark, sf_dir).withColumnRenamed("ret", "b"), "ts")
    return rounded(rows.select("series", "ts", ro.rolling_beta(F.col("ret"), F.col("b"), ["series"], "ts", W).alias("beta")), ["beta"])


@query(
    "simple_returns",
    f"""select series, ts, {r_sql("px / nullif(lag(px) over (partition by series order by ts), 0) - 1", "ret")} from
    (select l_returnflag as series, date_trunc('month', l_shipdate)::date as ts, avg(l_extendedprice) as px from lineitem group by all)""", dates=["ts"])
def simple_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market_returns(spark, sf_dir).select("series", "ts", "ret"), ["ret"])


@query(
    "rolling_low",
    f"with {RETURNS} select series, ts, round(case when row_number() over (partition by series order by ts) >= 10 then min(r) over (partition by series order by ts rows 9 preceding) end, 6) + 0.0 as low from rr", dates=["ts"])
def rolling_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir)
    return rounded(rows.select("series", "ts", ro.rolling_min(F.col("ret"), ["series"], "ts", 10).alias("low")), ["low"])


FORWARD = f"""with {RETURNS}, fw as (select series, ts, r, case when count(r) over w = 3 then sum(r) over w end as ahead from rr
  window w as (partition by series order by ts rows between 1 following and 3 following))"""


def ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir)
    return rows.select("series", "ts", "ret", ro.forward_sum(F.col("ret"), ["series"], "ts", 3).alias("ahead"))


@query("forward_returns", FORWARD + f" select series, ts, {r_sql('ahead', 'ahead')} from fw", dates=["ts"])
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ahead(spark, sf_dir).drop("ret"), ["ahead"])


@query(
    "conditioned_returns",
    FORWARD + f""", q as (select series, quantile_cont(r, 0.8) as q from fw group by series)
    select series, r > q as high, {r_sql("avg(ahead)", "mean_ahead")}, {r_sql("stddev_samp(ahead)", "std_ahead")}, count(ahead) as n_ahead from fw join q using (series) group by all""",
)
def conditioned_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.conditioned(ahead(spark, sf_dir), "ret", 0.8, ["ahead"], ["series"]), ["mean_ahead", "std_ahead"])


# scorecard

BATTERY_SQL = {
    "cagr": CAGR, "sharpe": SHARPE, "sortino": VALUES["sortino"], "calmar": f"({CAGR}) / nullif(abs(min(dd)), 0)", "max_drawdown": "min(dd)",
    "ann_vol": VALUES["ann_vol"], "cvar_95": "-avg(r) filter (where r <= q)", "skewness": "avg(pow(r - mr, 3)) / nullif(pow(avg(pow(r - mr, 2)), 1.5), 0)",
    "hit_rate": VALUES["hit_rate"],
}
RELATIVE_SQL = {n: RELATIVE[n] for n in ("information_ratio", "tracking_error", "up_capture", "down_capture")}
LESS_IS_BETTER = ("ann_vol", "cvar_95", "tracking_error", "down_capture")
SCORES = f"""with {RETURNS},
al as (select series, ts, r from rr union all select '~', ts, b from mk),
w1 as (select *, sum(ln(1 + r)) over (partition by series order by ts) as w from al),
w2 as (select *, exp(w - max(w) over (partition by series order by ts)) - 1 as dd from w1),
w3 as (select * from w2 join (select series, avg(r) as mr, quantile_disc(r, 0.05) as q from al group by series) using (series)),
ab as (unpivot (select series, {", ".join(f"({e})::double as {n}" for n, e in BATTERY_SQL.items())} from w3 group by series) on columns(* exclude series) into name measure value value),
{STATS},
re as (unpivot (select series, {", ".join(f"({e})::double as {n}" for n, e in RELATIVE_SQL.items())} from jo group by series) on columns(* exclude series) into name measure value value),
va as (select a.series as asset, a.measure, a.value, t.value as target_value from ab a left join ab t on t.series = '~' and t.measure = a.measure where a.series <> '~'
  union all select series, measure, value, case when measure in ('up_capture', 'down_capture') then 1.0 else 0.0 end from re),
sp as (select *, avg(abs(value)) over (partition by measure) as spread from va),
sc as (select asset, measure, value, target_value, case when measure in {LESS_IS_BETTER} then -1 else 1 end * (value - target_value)
  / case when abs(target_value) >= 1e-12 then abs(target_value) when spread >= 1e-12 then spread else 1.0 end as score, 1 / 13.0::double as weight from sp)
"""


def _scores(spark: SparkSession, sf_dir: str) -> tuple[Scorecard, DataFrame]:
    card = Scorecard(ppy=PPY)
    return card, card.values(flags(spark, sf_dir), market(spark, sf_dir))


@query("scorecard_values", SCORES + f"select asset, measure, {', '.join(r_sql(c, c) for c in ('value', 'target_value', 'score', 'weight'))} from sc")
def scorecard_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir)[1], ["value", "target_value", "score", "weight"])


@query(
    "scorecard_rank",
    SCORES
    + f""", co as (select asset, sum(weight * score) / sum(weight) as composite from sc where score is not null group by asset),
di as (select asset, composite, sqrt(sum(weight * pow(score - composite, 2)) / sum(weight)) as dispersion from sc join co using (asset) where score is not null group by all)
select asset, {r_sql("composite", "composite")}, {r_sql("dispersion", "dispersion")}, row_number() over (order by composite desc nulls last, asset) as rank from di""",
)
def scorecard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    card, values = _scores(spark, sf_dir)
    return rounded(card.summary(values), ["composite", "dispersion"])


@query(
    "scorecard_frame",
    SCORES + "select asset, " + ", ".join(f"round(max(score) filter (where measure = '{n}'), 6) + 0.0 as {n}" for n in (*BATTERY_SQL, *RELATIVE_SQL)) + " from sc group by asset",
)
def scorecard_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    card, values = _scores(spark, sf_dir)
    return rounded(card.frame(values, "score"), list(card.measures))


# features

EVENTS = "select user_id, date_trunc('day', ts)::date as day, count(*)::double as n, avg(value) as mean, max(value) as top from events group by all"


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.date_trunc("day", "ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")
    )


@query(
    "cross_section_zscore",
    f"""with p as ({EVENTS}) select user_id, day, {r_sql("(mean - avg(mean) over (partition by day)) / nullif(stddev_pop(mean) over (partition by day), 0)", "z")} from p""", dates=["day"])
def cross_section_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(user_days(spark, sf_dir).select("user_id", "day", ro.zscore(F.col("mean"), ["day"]).alias("z")), ["z"])


@query("period_ends", f"with p as ({EVENTS}) select user_id, max(day) as day, {r_sql('arg_max(mean, day)', 'mean')} from p group by user_id, date_trunc('week', day)", dates=["day"])
def period_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ro.period_ends(user_days(spark, sf_dir), ["user_id"], "day", "week")
    return rounded(ends.select("user_id", "day", "mean"), ["mean"])


@query("exposure", f"with {RETURNS} select series, ts, round(case when before is not null then least(greatest(0.35 + 0.65 * before, 0), 1) end, 6) + 0.0 as exposure from (select *, lag(abs(r)) over (partition by series order by ts) as before from rr)", dates=["ts"])
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir)
    return rounded(rows.select("series", "ts", ro.scaled_exposure(F.abs("ret"), ["series"], "ts").alias("exposure")), ["exposure"])


@query(
    "ew_volatility",
    f"""with recursive {RETURNS}, n as (select *, row_number() over (partition by series order by ts) as k from rr),
    e as (select series, k, ts, 1.0::double as w, 1.0::double as w2, r as s1, r * r as s2 from n where k = 1
      union all select n.series, n.k, n.ts, w * (9 / 11.0::double) + 1, w2 * pow(9 / 11.0::double, 2) + 1, s1 * (9 / 11.0::double) + r, s2 * (9 / 11.0::double) + r * r from e join n on n.series = e.series and n.k = e.k + 1)
    select series, ts, round(sqrt(greatest((s2 / w - pow(s1 / w, 2)), 0) / nullif(1 - w2 / (w * w), 0)), 6) + 0.0 as ew_vol from e""", dates=["ts"])
def ew_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ro.ew_volatility(flags(spark, sf_dir), ["series"], "ts", "ret")
    return rounded(rows.select("series", "ts", number("ew_vol").alias("ew_vol")), ["ew_vol"])


# principal components


FLAGS = ("A", "N", "R")


def flag_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns of all flags beside each other."""
    rows = market_returns(spark, sf_dir).where("ret is not null")
    return pivoted(rows, "ts", "series", "ret", list(FLAGS)).select(F.lit("all").alias("g"), "ts", *FLAGS)


#: Eigenvalues of symmetric matrices of three rows, in closed form, largest first.
EIGEN = """
q as (select *, (xx + yy + zz) / 3 as m, sqrt((pow(xx - (xx + yy + zz) / 3, 2) + pow(yy - (xx + yy + zz) / 3, 2) + pow(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as s from mat),
t as (select *, acos(least(greatest(((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / nullif(2 * s * s * s, 0), -1), 1)) / 3 as phi from q),
eig as (select *, m + 2 * s * cos(phi) as e1, m - 2 * s * cos(phi) - 2 * s * cos(phi + 2 * pi() / 3) as e2, m + 2 * s * cos(phi + 2 * pi() / 3) as e3 from t)
"""
TRIPLE = f"""with {RETURNS}, ab as (select ts, max(r) filter (where series = 'A') as a, max(r) filter (where series = 'N') as n, max(r) filter (where series = 'R') as f from rr group by ts),
mo as (select ts, row_number() over (order by ts) as k, count(a) over w as na, count(n) over w as nn, count(f) over w as nf, count(a) over w = 24 and count(n) over w = 24 and count(f) over w = 24 as ok,
  var_samp(a) over w as va, var_samp(n) over w as vn, var_samp(f) over w as vf, covar_samp(a, n) over w as can, covar_samp(a, f) over w as caf, covar_samp(n, f) over w as cnf
  from ab window w as (order by ts rows 23 preceding))
"""
E123 = ", ".join(f"round(case when ok then e{i} end, 6) + 0.0 as e{i}" for i in (1, 2, 3))


@query(
    "pca_eigenvalues",
    TRIPLE + f""", mat as (select ts, ok, va as xx, vn as yy, vf as zz, can as xy, caf as xz, cnf as yz from mo), {EIGEN}
    select ts, {E123}, round(case when ok then e1 / (3 * m) end, 6) + 0.0 as share from eig""", dates=["ts"])
def pca_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = models.rolling_pca(flag_series(spark, sf_dir), ["g"], "ts", FLAGS, window=24, n_components=3, align=False)
    found = steps.select("ts", *(F.get("eigenvalues", i).alias(f"e{i + 1}") for i in range(3)), F.get("explained_variance_ratio", 0).alias("share"))
    return rounded(found, ["e1", "e2", "e3", "share"])


@query(
    "pca_correlation",
    TRIPLE + f""", mat as (select ts, ok, 1.0::double as xx, 1.0::double as yy, 1.0::double as zz, can / sqrt(va * vn) as xy, caf / sqrt(va * vf) as xz, cnf / sqrt(vn * vf) as yz from mo), {EIGEN}
    select ts, {E123} from eig""", dates=["ts"])
def pca_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = models.rolling_pca(flag_series(spark, sf_dir), ["g"], "ts", FLAGS, window=24, n_components=3, corr=True, align=False)
    return rounded(steps.select("ts", *(F.get("eigenvalues", i).alias(f"e{i + 1}") for i in range(3))), ["e1", "e2", "e3"])


@query("pca_active", TRIPLE + "select ts, na = 24 as active_a, nn = 24 as active_n, nf = 24 as active_r from mo", dates=["ts"])
def pca_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flag_series(spark, sf_dir)
    return rows.select("ts", *(ro.active(F.col(c), ["g"], "ts", 24).alias(f"active_{c.lower()}") for c in FLAGS))


@query(
    "rolling_covariance",
    TRIPLE + "select ts, " + ", ".join(f"round(case when k >= 24 then {c} end, 6) + 0.0 as {n}" for c, n in (("can", "cov_an"), ("caf", "cov_ar"), ("cnf", "cov_nr"))) + " from mo", dates=["ts"])
def rolling_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flag_series(spark, sf_dir)
    pairs = [(a, b) for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :]]
    names = [f"cov_{a}{b}".lower() for a, b in pairs]
    return rounded(rows.select("ts", *(ro.rolling_covariance(F.col(a), F.col(b), ["g"], "ts", 24).alias(n) for (a, b), n in zip(pairs, names, strict=True))), names)


def daily_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Daily returns of flag and status series beside each other: gaps make the universe vary."""
    rows = market_returns(spark, sf_dir, ("l_returnflag", "l_linestatus"), "day")
    names = [r[0] for r in rows.select("series").distinct().orderBy("series").collect()]
    wide = pivoted(rows, "ts", "series", "ret", names)
    return wide.select(F.lit("all").alias("g"), "ts", *(F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names))), [f"f{i}" for i in range(len(names))]


@query("pca_variable_universe")
def pca_variable_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = daily_series(spark, sf_dir)
    return models.rolling_pca(rows, ["g"], "ts", names, window=20, n_components=2).select("ts", "valid", "eigenvalues", "similarity", "projections", "n_flips", "n_reorders")


def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's number of events and their mean value."""
    days = _table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("ts"))
    return days.agg(F.count(F.lit(1)).cast("double").alias("a"), F.avg("value").alias("b")).withColumn("g", F.lit("all"))


def flattened(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps of two components of two features as plain columns."""
    one = lambda c, i: F.get(c, i)
    found = {"e1": one("eigenvalues", 0), "e2": one("eigenvalues", 1), "share": one("explained_variance_ratio", 0), "s1": one("similarity", 0), "s2": one("similarity", 1)}
    found |= {f"c{i + 1}{j + 1}": one(one("components", i), j) for i in range(2) for j in range(2)} | {"p1": one("projections", 0), "p2": one("projections", 1)}
    return rounded(steps.select(*keys, *(v.alias(k) for k, v in found.items()), "n_reorders"), list(found))


def aligned_sql(moments: str, first: int) -> str:
    """Eigenpairs of two rows in closed form, and the chain of alignments; ``moments`` gives ``mo (k, ts, x, y, c)``."""
    plus = lambda x, y: f"case when (case when abs({x}) >= abs({y}) then {x} else {y} end) < 0 then -1 else 1 end"
    return f"""{moments},
ev as (select *, (x + y) / 2 + sqrt(pow((x - y) / 2, 2) + c * c) as l1, (x + y) / 2 - sqrt(pow((x - y) / 2, 2) + c * c) as l2, cos(atan2(2 * c, x - y) / 2) as ux, sin(atan2(2 * c, x - y) / 2) as uy from mo where k >= {first}),
al as (select k, ts, l1, l2, ux * {plus("ux", "uy")} as px, uy * {plus("ux", "uy")} as py, -uy * {plus("-uy", "ux")} as qx, ux * {plus("-uy", "ux")} as qy, null::double as s1, null::double as s2, 0::bigint as n_reorders from ev where k = {first}
  union all select k, ts, case when keep then l1 else l2 end, case when keep then l2 else l1 end,
    case when keep then ux * sign(au) else -uy * sign(aw) end, case when keep then uy * sign(au) else ux * sign(aw) end,
    case when keep then -uy * sign(bw) else ux * sign(bu) end, case when keep then ux * sign(bw) else uy * sign(bu) end,
    abs(case when keep then au else aw end), abs(case when keep then bw else bu end), case when keep then 0 else 2 end
  from (select *, abs(au) + abs(bw) >= abs(aw) + abs(bu) as keep from (select ev.*, px * ux + py * uy as au, py * ux - px * uy as aw, qx * ux + qy * uy as bu, qy * ux - qx * uy as bw from al join ev on ev.k = al.k + 1)))
"""


ALIGNED = ", ".join(r_sql(e, n) for e, n in (("l1", "e1"), ("l2", "e2"), ("l1 / (l1 + l2)", "share"), ("s1", "s1"), ("s2", "s2"), ("px", "c11"), ("py", "c12"), ("qx", "c21"), ("qy", "c22")))
SEEN = ", ".join(r_sql(f"(a - ma) * {c}x + (b - mb) * {c}y", n) for c, n in (("p", "p1"), ("q", "p2")))
DAY_FEATURES = "d as (select date_trunc('day', ts)::date as ts, count(*)::double as a, avg(value) as b from events group by 1)"
FLAT = f"""with recursive {DAY_FEATURES},
mo as (select ts, a, b, row_number() over (order by ts) as k, avg(a) over w as ma, avg(b) over w as mb, var_samp(a) over w as x, var_samp(b) over w as y, covar_samp(a, b) over w as c from d window w as (order by ts rows 9 preceding))"""


@query("pca_steps", aligned_sql(FLAT, 10) + f"select mo.ts, {ALIGNED}, {SEEN}, coalesce(n_reorders, 0) as n_reorders from mo left join al using (k)", dates=["ts"])
def pca_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flattened(models.rolling_pca(day_features(spark, sf_dir), ["g"], "ts", ["a", "b"], window=10, n_components=2), ["ts"])


@query(
    "pca_exponential",
    aligned_sql(f"""with recursive {DAY_FEATURES}, n as (select *, row_number() over (order by ts) as k from d),
    sm as (select i.k, i.ts, i.a, i.b, sum(w) as sw, sum(w * j.a) as sa, sum(w * j.b) as sb, sum(w * j.a * j.a) as saa, sum(w * j.b * j.b) as sbb, sum(w * j.a * j.b) as sab
      from n i join n j on j.k <= i.k, lateral (select pow(0.5::double, (i.k - j.k) / 6.0::double) as w) group by all),
    mo as (select k, ts, a, b, sa / sw as ma, sb / sw as mb, saa / sw - pow(sa / sw, 2) as x, sbb / sw - pow(sb / sw, 2) as y, sab / sw - sa / sw * sb / sw as c from sm)""", 8)
    + f"select mo.ts, {ALIGNED}, {SEEN}, coalesce(n_reorders, 0) as n_reorders from mo left join al using (k)", dates=["ts"])
def pca_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flattened(models.rolling_pca(day_features(spark, sf_dir), ["g"], "ts", ["a", "b"], window=8, n_components=2, halflife=6.0), ["ts"])


@query(
    "pca_panel",
    aligned_sql("""with recursive d as (select event_type as item, date_trunc('day', ts)::date as ts, avg(value) as a, stddev_pop(value) as b from events group by all),
    it as (select item, ts, a, b, row_number() over (partition by item order by ts) as k, avg(a) over w as ma, avg(b) over w as mb, var_samp(a) over w as vx, var_samp(b) over w as vy, covar_samp(a, b) over w as vc
      from d window w as (partition by item order by ts rows 9 preceding)),
    mo as (select k, ts, avg(vx) as x, avg(vy) as y, avg(vc) as c from it group by all)""", 10)
    + f"select it.item, it.ts, {ALIGNED}, {SEEN}, n_reorders from it join al using (k)", dates=["ts"])
def pca_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    rows = events.groupBy(F.lit("all").alias("g"), "event_type", F.date_trunc("day", "ts").cast("date").alias("ts")).agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"))
    return flattened(models.panel_pca(rows, ["g"], "event_type", "ts", ["a", "b"], window=10, n_components=2), ["item", "ts"])


@query(
    "pca_project",
    aligned_sql(FLAT, 10) + f""", la as (select px, py, qx, qy, ma, mb from al join mo using (k) order by k desc limit 1)
    select ts, {SEEN} from d cross join la""", dates=["ts"])
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days on the last day's basis."""
    rows = day_features(spark, sf_dir)
    steps = models.rolling_pca(rows, ["g"], "ts", ["a", "b"], window=10, n_components=2)
    found = models.project(steps, rows, ["g"], ["a", "b"])
    return rounded(found.select("ts", F.get("projections", 0).alias("p1"), F.get("projections", 1).alias("p2")), ["p1", "p2"])


# clusters


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))


CENTRES = "select label as k, list(v order by i) as c from (select label, i, avg(embedding[i]::double) as v from embeddings, range(1, 65) t(i) group by all) group by label"


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label."""
    items = cross_section(spark, sf_dir).select("label", F.posexplode("features").alias("i", "v"))
    means = items.groupBy("label", "i").agg(F.avg("v").alias("v"))
    return means.groupBy(F.col("label").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))


@query(
    "kmeans_predict",
    f"""with c as ({CENTRES}), d as (select vec_id, k, list_sum(list_transform(list_zip(embedding::double[], c), lambda z: pow(z[1] - z[2], 2))) as d from embeddings, c)
    select vec_id, arg_min(k, (d, k))::bigint as label, round(min(d), 4) + 0.0 as dist2 from d group by vec_id""",
)
def kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.nearest(cross_section(spark, sf_dir).drop("label"), centres(spark, sf_dir))
    return found.select("vec_id", "label", (F.round("dist2", 4) + 0.0).alias("dist2"))


@query(
    "kmeans_distances",
    f"""with c as ({CENTRES}) select vec_id, k::bigint as k, round(sqrt(list_sum(list_transform(list_zip(embedding::double[], c), lambda z: pow(z[1] - z[2], 2)))), 4) + 0.0 as distance from embeddings, c""",
)
def kmeans_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.centroid_distances(cross_section(spark, sf_dir).drop("label"), centres(spark, sf_dir))
    return found.select("vec_id", F.col("k").cast("long").alias("k"), (F.round("distance", 4) + 0.0).alias("distance"))


@query(
    "kmeans_memory",
    """with c as (select label as k, list(v order by i) as c from (select label, vec_id % 2 as half, i, avg(embedding[i]::double) as v from embeddings, range(1, 65) t(i) group by all) group by label, half)
    select vec_id, k::bigint as k, round(min(sqrt(list_sum(list_transform(list_zip(embedding::double[], c), lambda z: pow(z[1] - z[2], 2))))), 4) + 0.0 as distance from embeddings, c group by all""",
)
def kmeans_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the nearer of two remembered places of each cluster."""
    points = cross_section(spark, sf_dir)
    items = points.select("label", (F.col("vec_id") % 2).alias("half"), F.posexplode("features").alias("i", "v")).groupBy("label", "half", "i").agg(F.avg("v").alias("v"))
    places = items.groupBy(F.col("label").alias("k"), "half").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))
    found = summaries.centroid_distances(points.drop("label"), places)
    return found.select("vec_id", F.col("k").cast("long").alias("k"), (F.round("distance", 4) + 0.0).alias("distance"))


@query(
    "silhouette",
    """with v as (select vec_id, label::bigint as label, embedding::double[] as e from embeddings),
    m as (select a.vec_id, a.label, b.label as l, avg(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(z[1] - z[2], 2))))) as m from v a join v b on a.vec_id <> b.vec_id group by all),
    s as (select vec_id, label, min(m) filter (where l = label) as a, min(m) filter (where l <> label) as b from m group by all)
    select vec_id, label, round(case when a is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end, 6) + 0.0 as silhouette from s""",
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.silhouette(cross_section(spark, sf_dir), "vec_id"), ["silhouette"])


@query(
    "kmeans_inertia",
    f"""with c as ({CENTRES}), d as (select vec_id, min(list_sum(list_transform(list_zip(embedding::double[], c), lambda z: pow(z[1] - z[2], 2)))) as d from embeddings, c group by all)
    select round(sum(d), 3) as inertia from d""",
)
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.nearest(cross_section(spark, sf_dir).drop("label"), centres(spark, sf_dir))
    return summaries.inertia(found).select(F.round("inertia", 3).alias("inertia"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_days(spark, sf_dir).select(F.lit("all").alias("g"), "day", "user_id", "n", "mean", "top")
    return models.rolling_kmeans(rows, ["g"], "day", "user_id", ["n", "mean", "top"], n_clusters=3, centroid_memory=2)


def far(x: str, y: str) -> str:
    return " + ".join(f"pow({x}[{i}] - {y}[{i}], 2)" for i in (1, 2, 3))


#: Lloyd's iterations day by day as one recursion: a row is an iteration, or a day's start from the centres before.
NEAREST = f"list_transform(xs, lambda x: list_position(list_transform(c, lambda y: {far('x', 'y')}), list_min(list_transform(c, lambda y: {far('x', 'y')}))))"
FARTHEST = f"list_sort(list_transform(list_zip(xs, range(1, len(xs) + 1)), lambda z: [-list_min(list_transform(c, lambda y: {far('z[1]', 'y')})), z[2]::double]))"
PERMS = "[[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]"
COST = " + ".join(f"({far(f'p[{i}]', f'c[q[{i}]]')})" for i in (1, 2, 3))
PERM = f"case when p is null then [1, 2, 3] else {PERMS}[list_position(list_transform({PERMS}, lambda q: {COST}), list_min(list_transform({PERMS}, lambda q: {COST})))] end"
ALIGNED = f"case when p is null then list_sort(c) else list_transform({PERM}, lambda i: c[i]) end"
LLOYD = f"""with recursive pe as ({EVENTS}),
pt as (select day, row_number() over (order by day) as k, list([n, mean, top] order by user_id::varchar) as xs from pe group by day),
f1 as (select *, [list_avg(list_transform(xs, lambda x: x[1])), list_avg(list_transform(xs, lambda x: x[2])), list_avg(list_transform(xs, lambda x: x[3]))] as m from pt where k = 1),
f2 as (select *, list_transform(xs, lambda x: {far('x', 'm')}) as d from f1),
f3 as (select xs, xs[list_position(d, list_min(d))] as c1 from f2),
f4 as (select *, list_transform(xs, lambda x: {far('x', 'c1')}) as d from f3),
f5 as (select *, xs[list_position(d, list_max(d))] as c2 from f4),
f6 as (select *, list_transform(xs, lambda x: least({far('x', 'c1')}, {far('x', 'c2')})) as e from f5),
st as (select 1::bigint as k, 0 as it, [c1, c2, xs[list_position(e, list_max(e))]] as c, null::double[][] as p, false as done from f6
  union all select case when done then k + 1 else k end, case when done then 0 else it + 1 end,
    case when done then {ALIGNED} else nc end, case when done then {ALIGNED} else p end,
    not done and (list_max(list_transform([1, 2, 3], lambda j: {far('nc[j]', 'c[j]')})) <= 1e-16 or it + 1 >= case when p is null then 300 else 100 end)
  from (select st.*, list_transform([1, 2, 3], lambda j: case when list_contains(near, j) then list_transform([1, 2, 3], lambda i: list_avg(list_transform(list_filter(list_zip(xs, near), lambda z: z[2] = j), lambda z: z[1][i])))
      else xs[far[list_position(list_filter([1, 2, 3], lambda i: not list_contains(near, i)), j)][2]::bigint] end) as nc
    from (select st.*, xs, {NEAREST} as near, {FARTHEST} as far from st join pt on pt.k = st.k where not (done and st.k = (select max(k) from pt))) st)),
ce as (select k, it, p is null as first, {ALIGNED} as centres, {PERM} as perm from st where done),
me as (select a.*, case when b.k is null then [a.centres] else [a.centres, b.centres] end as memory from ce a left join ce b on b.k = a.k - 1),
fa as (select pe.day, me.k, pe.user_id::varchar as entity, list_transform([1, 2, 3], lambda j: list_min(list_transform(memory, lambda g: {far('[n, mean, top]', 'g[j]')}))) as d
  from pe join pt using (day) join me using (k)),
la as (select day, k, entity, list_position(d, list_min(d)) - 1 as label, list_min(d) as dist2 from fa)
"""


@query(
    "kmeans_labels",
    LLOYD + f"""select a.day as period, a.entity, a.label::bigint as label, coalesce(b.label <> a.label, false) as switched, {r_sql("a.dist2", "dist2")}
    from la a left join la b on b.entity = a.entity and b.k = a.k - 1""", dates=["period"])
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustered(spark, sf_dir).select("period", "entity", "label", "switched", "dist2"), ["dist2"])


@query(
    "kmeans_steps",
    LLOYD + f"""select day as period, {", ".join(r_sql(f"centres[{j}][{i}]", f"c{j}{i}") for j in (1, 2, 3) for i in (1, 2, 3))}, {r_sql("inertia", "inertia")},
    len(list_filter([1, 2, 3], lambda i: perm[i] <> i))::bigint as n_relabels, case when first then 0 else it end::bigint as n_iter
    from ce join (select day, k, sum(dist2) as inertia from la group by all) using (k)""", dates=["period"])
def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = models.kmeans_steps(clustered(spark, sf_dir))
    centres = {f"c{j + 1}{i + 1}": F.get(F.get("centroids", j), i) for j in range(3) for i in range(3)}
    return rounded(steps.select("period", *(c.alias(n) for n, c in centres.items()), "inertia", "n_relabels", "n_iter"), [*centres, "inertia"])


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed rule's labels of users by day: how many events they have."""
    return user_days(spark, sf_dir).select(F.col("day").alias("period"), F.col("user_id").cast("string").alias("entity"), F.least(F.col("n"), F.lit(3.0)).cast("long").alias("label"))


@query(
    "cluster_summary",
    f"""with p as ({EVENTS}), l as (select day, user_id, least(n, 3)::bigint as label, dense_rank() over (order by day) as k from p),
    b as (select l.*, o.label as before, max(l.k) over () as last from l left join l o on o.user_id = l.user_id and o.k = l.k - 1)
    select label, round(count(*) / (sum(count(*)) over ()), 6) + 0.0 as share, count(*) filter (where k = last) as n_final,
    count(*) filter (where k > 1 and (before is null or before <> label)) as moves_in, round(count(*) filter (where before <> label) / count(*), 6) + 0.0 as switch_rate from b group by label""",
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.cluster_summary(sized(spark, sf_dir)), ["share", "switch_rate"])


@query(
    "cluster_switches",
    f"""with p as ({EVENTS}), l as (select day, user_id, least(n, 3)::bigint as label, dense_rank() over (order by day) as k from p)
    select l.day as period, l.user_id::varchar as entity, coalesce(o.label <> l.label, false) as switched from l left join l o on o.user_id = l.user_id and o.k = l.k - 1""", dates=["period"])
def cluster_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.moves(sized(spark, sf_dir)).select("period", "entity", F.coalesce(F.col("before") != F.col("label"), F.lit(False)).alias("switched"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "cluster_crosstab",
    f"""with l as (select e.event_type, least(p.n, 3)::bigint as label from events e join ({EVENTS}) p on p.user_id = e.user_id and p.day = date_trunc('day', e.ts)::date)
    select label, {", ".join(f"count(*) filter (where event_type = '{e}') as {e}" for e in EVENT_TYPES)} from l group by label""",
)
def cluster_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of users by day against the types of their events."""
    labels = sized(spark, sf_dir).withColumnRenamed("period", "day")
    events = _table(spark, sf_dir, "events").select("event_type", F.date_trunc("day", "ts").cast("date").alias("day"), F.col("user_id").cast("string").alias("entity"))
    return summaries.crosstab(events.join(labels, ["day", "entity"]), "label", "event_type", EVENT_TYPES)


@query(
    "labels_frame",
    "with l as (select date_trunc('day', ts)::date as period, event_type as entity, count(*) % 4 as label from events group by all) select period, "
    + ", ".join(f"coalesce(max(label) filter (where entity = '{e}'), -1) as {e}" for e in EVENT_TYPES)
    + " from l group by period",
    dates=["period"],
)
def labels_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("period"), F.col("event_type").alias("entity"))
    return summaries.labels_frame(days.agg((F.count(F.lit(1)) % 4).alias("label")), EVENT_TYPES)


@query("select_n_clusters")
def select_n_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    return select.select_n_clusters(users, "user_id", ["n", "mean", "top"], (2, 3, 4))


# embeddings and regimes


def mean_of(items: str, i: int) -> str:
    return f"list_avg(list_transform(known, lambda j: {items}[j][{i}]))"


def cross(i: int, j: int) -> str:
    return f"list_sum(list_transform(known, lambda j: (xs[j][{i}] - c{i}) * (old[j][{j}] - r{j})))"


#: A day's points, centred on its principal axes on the first day, then turned (or mirrored) onto the day before.
EMBEDDED = f"""with recursive pe as ({EVENTS}),
pt as (select day, row_number() over (order by day) as k, list(user_id::varchar order by user_id::varchar) as names, list([n, mean] order by user_id::varchar) as xs,
  avg(n) as mn, avg(mean) as mm, atan2(2 * covar_samp(n, mean), var_samp(n) - var_samp(mean)) / 2 as phi from pe group by day),
em as (select k, names, list_transform(xs, lambda x: [
    ((x[1] - mn) * cos(phi) + (x[2] - mm) * sin(phi)) * case when (case when abs(cos(phi)) >= abs(sin(phi)) then cos(phi) else sin(phi) end) < 0 then -1 else 1 end,
    (-(x[1] - mn) * sin(phi) + (x[2] - mm) * cos(phi)) * case when (case when abs(sin(phi)) >= abs(cos(phi)) then -sin(phi) else cos(phi) end) < 0 then -1 else 1 end]) as xy,
    null::double[][] as old, null::double as disparity from pt where k = 1
  union all select k, names, xy, old, sqrt(list_avg(list_transform(known, lambda j: pow(xy[j][1] - old[j][1], 2) + pow(xy[j][2] - old[j][2], 2))))
  from (select *, list_transform(xs, lambda x: [(x[1] - c1) * ta + (x[2] - c2) * case when turn then -tb else tb end + r1, (x[1] - c1) * tb + (x[2] - c2) * case when turn then ta else -ta end + r2]) as xy
    from (select *, case when turn then m11 + m22 else m11 - m22 end / size as ta, case when turn then m12 - m21 else m12 + m21 end / size as tb
      from (select *, m11 * m22 - m12 * m21 >= 0 as turn, greatest(sqrt(pow(m11 + m22, 2) + pow(m12 - m21, 2)), sqrt(pow(m11 - m22, 2) + pow(m12 + m21, 2))) as size
        from (select *, {", ".join(f"{cross(i, j)} as m{i}{j}" for i in (1, 2) for j in (1, 2))}
          from (select *, {", ".join(f"{mean_of('xs', i)} as c{i}, {mean_of('old', i)} as r{i}" for i in (1, 2))}
            from (select *, list_filter(range(1, len(xs) + 1), lambda j: old[j] is not null) as known
              from (select pt.k, pt.names, pt.xs, list_transform(pt.names, lambda e: em.xy[list_position(em.names, e)]) as old from em join pt on pt.k = em.k + 1))))))))
"""


@query(
    "embedding_coords",
    EMBEDDED + f"""select day as period, names[i] as entity, {r_sql("xy[i][1]", "x")}, {r_sql("xy[i][2]", "y")},
    {r_sql("sqrt(pow(xy[i][1] - old[i][1], 2) + pow(xy[i][2] - old[i][2], 2))", "displacement")}, {r_sql("disparity", "disparity")}
    from (select em.*, pt.day, unnest(range(1, len(em.names) + 1)) as i from em join pt using (k))""", dates=["period"])
def embedding_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_days(spark, sf_dir).select(F.lit("all").alias("g"), "day", "user_id", "n", "mean")
    found = models.rolling_embedding(rows, ["g"], "day", "user_id", ["n", "mean"], n_components=2)
    found = found.select("period", "entity", F.get("coords", 0).alias("x"), F.get("coords", 1).alias("y"), "displacement", "disparity")
    return rounded(found, ["x", "y", "displacement", "disparity"])


@query("regime_steps")
def regime_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir).select("series", "ts", "ret")
    return models.rolling_regimes(rows, ["series"], "ts", ["ret"], n_regimes=2, window=36, reg_covar=1e-8)


@query("regime_predict")
def regime_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir).select("series", "ts", "ret")
    steps = models.rolling_regimes(rows, ["series"], "ts", ["ret"], n_regimes=2, window=36, reg_covar=1e-8)
    return models.predict_regimes(steps, rows, ["series"], ["ret"], reg_covar=1e-8)


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("series", "ts", "ret", (F.col("ret") < 0).cast("long").alias("label"))


SPELLS = f"""with {RETURNS}, l as (select series, ts, r, (r < 0)::bigint as label from rr),
n as (select *, row_number() over (partition by series order by ts) - row_number() over (partition by series, label order by ts) as island from l),
s as (select series, label, min(ts) as start, max(ts) as "end", count(*) as length from n group by series, label, island)
"""


@query("regime_spells", SPELLS + 'select series, label, start, "end", length from s', dates=["start", "end"])
def regime_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.spells(signed(spark, sf_dir), ["series"], "ts")


@query(
    "regime_summary",
    SPELLS
    + f"""select f.series, f.label, round(share, 6) + 0.0 as share, round(avg_spell, 6) + 0.0 as avg_spell, n_spells, round(mean_ret, 6) + 0.0 as mean_ret, round(std_ret, 6) + 0.0 as std_ret
    from (select series, label, count(*) / sum(count(*)) over (partition by series) as share, avg(r) as mean_ret, stddev_samp(r) as std_ret from l group by series, label) f
    join (select series, label, avg(length) as avg_spell, count(*) as n_spells from s group by series, label) g using (series, label)""",
)
def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.regime_summary(signed(spark, sf_dir), ["series"], "ts", ["ret"]), ["share", "avg_spell", "mean_ret", "std_ret"])


@query(
    "select_one_regime",
    f"""with {RETURNS}, f as (select count(*) as n, var_pop(b * 100) as v, stddev_pop(b) as s from mk), g as (select *, v + 2e-4 as w from f),
    h as (select n, -0.5 * n * (ln(2 * pi() * w) + v / w) as ll from g)
    select 1::bigint as n_regimes, round(ll, 3) + 0.0 as log_likelihood, 2::bigint as n_params, round(4 - 2 * ll, 3) + 0.0 as aic, round(2 * ln(n) - 2 * ll, 3) + 0.0 as bic from h""",
)
def select_one_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market(spark, sf_dir).select("ts", (F.col("ret") * 100).alias("x"))
    found = select.select_n_regimes(rows, "ts", ["x"], (1,), reg_covar=1e-4)
    return found.withColumns({c: F.round(c, 3) + 0.0 for c in ("log_likelihood", "aic", "bic")})


@query("select_n_regimes")
def select_n_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market(spark, sf_dir).select("ts", (F.col("ret") * 100).alias("x"))
    return select.select_n_regimes(rows, "ts", ["x"], (1, 2, 3))


@query(
    "regime_filter",
    f"""with recursive {RETURNS}, n as (select series, ts, r, row_number() over (partition by series order by ts) as k,
      exp(-pow(r - 0.01, 2) / (2 * 0.0004)) / sqrt(0.0004) as b0, exp(-pow(r + 0.01, 2) / (2 * 0.0025)) / sqrt(0.0025) as b1 from rr),
    f as (select series, k, ts, b0 / (b0 + b1) as p0 from n where k = 1
      union all select n.series, n.k, n.ts, (p0 * 0.95 + (1 - p0) * 0.1) * b0 / ((p0 * 0.95 + (1 - p0) * 0.1) * b0 + (p0 * 0.05 + (1 - p0) * 0.9) * b1)
      from f join n on n.series = f.series and n.k = f.k + 1)
    select series, ts, round(p0, 6) + 0.0 as p_calm from f""",
    dates=["ts"],
)
def regime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flags(spark, sf_dir).select("series", "ts", "ret")
    found = models.filter_regimes(rows, ["series"], "ts", ["ret"], [[0.01], [-0.01]], [[[0.0004]], [[0.0025]]], [[0.95, 0.05], [0.1, 0.9]], [0.5, 0.5])
    return rounded(found.select("series", "ts", F.get("probs", 0).alias("p_calm")), ["p_calm"])


@query(
    "procrustes_rotation",
    f"""with p as ({EVENTS}), k as (select *, dense_rank() over (order by day) as k from p),
    s as (select a.day, b.n as rx, b.mean as ry, a.n as cx, a.mean as cy from k a join k b on a.user_id = b.user_id and a.k = b.k + 1),
    t as (select day, covar_pop(cx, rx) + covar_pop(cy, ry) as c, covar_pop(cx, ry) - covar_pop(cy, rx) as s, var_pop(cx) + var_pop(cy) as v, var_pop(rx) + var_pop(ry) as w from s group by day)
    select day, round(atan2(s, c), 6) + 0.0 as angle, round(sqrt(greatest(v + w - 2 * sqrt(c * c + s * s), 0)), 6) + 0.0 as disparity from t""",
    dates=["day"],
)
def procrustes_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_days(spark, sf_dir)
    days = rows.select("day").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")))
    rows = rows.join(days, "day")
    before = rows.select("user_id", (F.col("k") + 1).alias("k"), F.col("n").alias("rx"), F.col("mean").alias("ry"))
    pairs = rows.select("user_id", "k", "day", F.col("n").alias("cx"), F.col("mean").alias("cy")).join(before, ["user_id", "k"])
    return rounded(summaries.rotation(pairs, ["day"], ("rx", "ry"), ("cx", "cy")), ["angle", "disparity"])


@query("drawdown_episodes", f"with {RETURNS}, {PATH} select series, ts, {r_sql('dd', 'drawdown')} from path order by dd, series, ts limit 10", dates=["ts"])
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ms.prepared(flags(spark, sf_dir), needs=frozenset(("path",))).select("series", "ts", F.col("dd").alias("drawdown"))
    return rounded(summaries.episodes(rows, "drawdown", 10, ("series", "ts")), ["drawdown"])


# shapes and generators


@query(
    "melted_returns",
    f"with {RETURNS} select ts, series, {r_sql('r', 'ret')} from rr", dates=["ts"])
def melted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market_returns(spark, sf_dir)
    wide = pivoted(rows, "ts", "series", "ret")
    return rounded(melted(wide, ["ts"]).where("ret is not null"), ["ret"])


@query("latest_universe", f"with p as ({EVENTS}) select user_id, min(day) as first_day, max(day) as last_day, count(*) as n_days from p group by user_id", dates=["first_day", "last_day"])
def latest_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days"))


@query(
    "shared_universe",
    f"""with p as ({EVENTS}), k as (select user_id, day, dense_rank() over (order by day) as k from p)
    select a.day as day, count(*) as n_shared from k a join k b on a.user_id = b.user_id and a.k = b.k + 1 group by a.day""", dates=["day"])
def shared_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries.moves(sized(spark, sf_dir)).where("before is not null")
    return rows.groupBy(F.col("period").alias("day")).agg(F.count(F.lit(1)).alias("n_shared"))


def uniform_sql(seed: int, name: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{name}', {', '.join(keys)})), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double"


def normal_sql(seed: int, name: str, *keys: str) -> str:
    return f"sqrt(-2 * ln({uniform_sql(seed, name + '.r', *keys)})) * cos(2 * pi() * ({uniform_sql(seed, name + '.a', *keys)}))"


@query(
    "simulate_rotating_cloud",
    f"""with s as (select step, cos(step * 0.01::double) as c, sin(step * 0.01::double) as s, 3 * {normal_sql(1, "long", "step")} as l, 0.5::double * {normal_sql(1, "short", "step")} as h
      from (select unnest(range(200)) as step))
    select step, {r_sql(f"c * l - s * h + 0.05::double * {normal_sql(1, 'noise0', 'step')}", "x0")}, {r_sql(f"s * l + c * h + 0.05::double * {normal_sql(1, 'noise1', 'step')}", "x1")}, {r_sql("c", "d0")}, {r_sql("s", "d1")} from s""",
)
def simulate_rotating_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.rotating_cloud(spark, 200, seed=1), ["x0", "x1", "d0", "d1"])


@query(
    "simulate_regime_returns",
    f"""with s as (select step, {uniform_sql(1, "leave", "step")} > 0.99::double as leaves, 0.7::double * {normal_sql(1, "common", "step")} as shock from (select unnest(range(300)) as step)),
    t as (select *, coalesce(count(*) filter (where leaves) over (order by step rows between unbounded preceding and 1 preceding), 0) % 2 as state from s)
    select step, {", ".join(r_sql(f"case state when 0 then 8e-4 else -6e-4 end::double + case state when 0 then 0.008 else 0.02 end::double * (shock + sqrt(1 - 0.49::double) * {normal_sql(1, f'asset{i}', 'step')})", f"a{i}") for i in range(5))}, state from t""",
)
def simulate_regime_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.regime_returns(spark, 300, seed=1), [f"a{i}" for i in range(5)])


@query(
    "simulate_drifting_blobs",
    f"""with s as (select period, number, number % 3 as membership from (select unnest(range(20)) as period), (select unnest(range(90)) as number)),
    t as (select *, membership * (2 * pi() / 3) + period * 0.02::double as angle, 3 / sin(pi() / 3) as far from s)
    select period, printf('e%04d', number) as entity, {r_sql(f"far * cos(angle) + 0.5::double * {normal_sql(1, 'f0', 'period', 'number')}", "f0")},
    {r_sql(f"far * sin(angle) + 0.5::double * {normal_sql(1, 'f1', 'period', 'number')}", "f1")}, membership from t""",
)
def simulate_drifting_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.drifting_blobs(spark, 20, seed=1), ["f0", "f1"])
