"""Ordered operators: as-of lookup, newest wins, runs since a reset, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of(points: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """The points with the value of the largest start that is not after them, or null: one shuffle by the keys
    and a running last value, instead of a range join."""
    empty_value = starts.schema[value].dataType
    p = points.withColumn("_at", F.col(at)).withColumn("_start", F.lit(False)).withColumn("_value", F.lit(None).cast(empty_value))
    s = starts.select(*keys, F.col(start).alias("_at"), F.lit(True).alias("_start"), F.col(value).alias("_value"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where(~F.col("_start")).drop("_at", "_start", "_value")


def since_reset(df: DataFrame, keys: list[str], order: str, reset: Column, to: str) -> DataFrame:
    """Numbers rows from the last reset value on: reset, reset + 1, ..."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_reset", reset).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    last = F.last("_reset", ignorenulls=True).over(w)
    at = F.last(F.when(F.col("_reset").isNotNull(), F.col("_n")), ignorenulls=True).over(w)
    return marked.withColumn(to, last + F.col("_n") - at).drop("_reset", "_n")


def line_breaks(df: DataFrame, keys: list[str], order: str, y: str, tolerance: float = 1e-3) -> DataFrame:
    """``breaks``: whether a run's baseline differs from that of the run before."""
    before = F.lag(y).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("breaks", F.coalesce(F.abs(F.col(y) - before) > tolerance, F.lit(False)))


def integral(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """``total``: the sum of values at no larger x and y, as two running sums."""
    rows = df.withColumn("_row", F.sum(value).over(Window.partitionBy(y).orderBy(x)))
    return rows.withColumn("total", F.sum("_row").over(Window.partitionBy(x).orderBy(y))).drop("_row")
