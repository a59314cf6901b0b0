"""Keyed changes to tables kept as plain files: anti join and union, then a new version of the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same key; columns missing in changes become null."""
    keys = [key] if isinstance(key, str) else key
    kept = base.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True).select(*base.columns)


def keep_existing(base: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """base with the rows of changes whose key it does not have yet."""
    keys = [key] if isinstance(key, str) else key
    return base.unionByName(changes.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_group(base: DataFrame, changes: DataFrame, group: str) -> DataFrame:
    """base with all rows of the groups that occur in changes replaced."""
    return base.join(changes.select(group).distinct(), group, "left_anti").unionByName(changes, allowMissingColumns=True)


def last_n(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each group by order, given as columns with the newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
