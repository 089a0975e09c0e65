"""Readers, writers and shapes of return and feature panels.

Everything inside is long: one row per series (or entity) and time. NaN becomes NULL on the way in, because Spark's
aggregates skip the one and not the other. Windows count rows, in the order of time; nothing depends on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def number(col: Column | str) -> Column:
    """A double whose NaN is NULL."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(value), value)


def read_prices(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A wide table of prices from CSV with a header; give the schema where files are large."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any source that Spark's readers know: parquet, orc, json, csv, jdbc."""
    return spark.read.format(kind).options(**options).load(path)


def write_steps(steps: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Step tables are the model's checkpoint; partition them by what readers filter on."""
    steps.write.mode(mode).partitionBy(*partition_by).parquet(path)


def melted(wide: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None, name: str = "series", value: str = "ret") -> DataFrame:
    """Wide to long; column names become strings."""
    values = [c for c in wide.columns if c not in keys] if values is None else list(values)
    return wide.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in values], name, value).withColumn(value, number(value))


def pivoted(long: DataFrame, key: str, name: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """Long to wide; give the names to save a pass over the data."""
    grouped = long.groupBy(key)
    return (grouped.pivot(name, list(names)) if names else grouped.pivot(name)).agg(F.first(value, ignorenulls=True))


def with_step(df: DataFrame, group: Sequence[str], ts: str, into: str = "step") -> DataFrame:
    """Row numbers from 0 within each group, by time."""
    return df.withColumn(into, (F.row_number().over(Window.partitionBy(*group).orderBy(ts)) - 1).cast("int"))


def require_finite(df: DataFrame, columns: Sequence[str], where: str) -> DataFrame:
    """``df``, failing at run time where a feature is missing; the message names the row."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    told = F.concat(F.lit("missing feature in "), F.col(where).cast("string"))
    return df.withColumn(columns[0], F.when(bad, F.raise_error(told).cast("double")).otherwise(F.col(columns[0]).cast("double")))


def require_balanced(df: DataFrame, period: str, entity: str) -> None:
    """Raise unless every period has the same number of entities, each once."""
    sizes = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("u"))
    found = sizes.agg(F.min("u").alias("a"), F.max("n").alias("b")).first()
    entities = df.agg(F.count_distinct(entity).alias("n")).first()["n"]
    if found["a"] is not None and not found["a"] == found["b"] == entities:
        raise ValueError("the panel is not balanced")


def market_returns(spark: SparkSession, sf_dir: str, by: Sequence[str] = ("l_returnflag",), every: str = "month") -> DataFrame:
    """``series, ts, px, ret``: the average price of line items by period, and its change."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    series = F.concat_ws("-", *by) if by else F.lit("all")
    prices = lines.groupBy(series.alias("series"), F.date_trunc(every, "l_shipdate").cast("date").alias("ts")).agg(F.avg("l_extendedprice").alias("px"))
    before = F.lag("px").over(Window.partitionBy("series").orderBy("ts"))
    return prices.withColumn("ret", F.try_divide("px", before) - 1)
