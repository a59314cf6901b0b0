"""Positions within a group whatever its size: a window never covers more than one range of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that one window covers.
WIDTH = 1 << 14


def _ranges(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.coalesce(F.col(order), F.lit(0)) / width))


def with_previous(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str = "previous", width: int = WIDTH) -> DataFrame:
    """df with `out`: the struct of `columns` of the row before by the whole-numbered order; null for the first of a group."""
    value = F.struct(*columns)
    last = _ranges(df, order, width).groupBy(*keys, "_range").agg(F.max_by(value, F.col(order)).alias("_last"))
    before = last.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_before"))
    rows = _ranges(df, order, width).withColumn("_own", F.lag(value).over(Window.partitionBy(*keys, "_range").orderBy(order)))
    return _rejoin(rows, before, keys).withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before", "_range")


def running_sum(df: DataFrame, keys: list[str], order: str, amount: Column, out: str, width: int = WIDTH) -> DataFrame:
    """df with `out`: the sum of `amount` up to and with the row, by the whole-numbered order, which has no ties."""
    rows = _ranges(df, order, width).withColumn("_amount", amount)
    before = rows.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_total"))
    before = before.select(*keys, "_range", F.sum("_total").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = rows.withColumn("_own", F.sum("_amount").over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return _rejoin(rows, before, keys).withColumn(out, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_own", "_before", "_amount", "_range")


def _rejoin(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the value of their range; groups without a key are a group of their own."""
    named = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same).drop("_r", *[f"_k{i}" for i in range(len(keys))])
