"""Duplicates by content: equal bytes or equal normalised text; incremental skipping and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(docs: DataFrame, key: str, binary: str = "binary_hash", normal: str = "normal_hash", order: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """docs with is_duplicate and reason. The first of each normalised hash is accepted, unless history (binary, normal) has it.

    Hash groups are aggregated, not sorted in one task: the first row of a group is a min of a struct.
    """
    first = docs.groupBy(normal).agg(F.min(F.struct(F.col(order or key).alias("o"), F.col(key).alias("k"), F.col(binary).alias("b"))).alias("first"))
    if history is not None:
        known = history.groupBy(normal).agg(F.min(binary).alias("known"))
        first = first.join(known, normal, "left")
    else:
        first = first.withColumn("known", F.lit(None).cast("string"))
    out = docs.join(first, normal, "left")
    repeated = F.col("known").isNotNull() | (F.col(key) != F.col("first.k"))
    same = F.col(binary) == F.coalesce("known", F.col("first.b"))
    dup = F.coalesce(repeated, F.lit(False))
    return out.select(*docs.columns, dup.alias("is_duplicate"), F.when(dup, F.when(same, "binary-match").otherwise("normalized-content-match")).alias("reason"))


def binary_duplicates(docs: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, first_key) of rows whose hash occurred before."""
    firsts = docs.groupBy(hash_col).agg(F.min(key).alias("first_key"))
    return docs.join(firsts, hash_col).where(F.col(key) != F.col("first_key")).select(key, "first_key")


def changed(current: DataFrame, saved: DataFrame, key: str = "source_path", digest: str = "fingerprint") -> DataFrame:
    """Rows of current whose (key, digest) saved does not have."""
    return current.join(saved.select(key, digest).distinct(), [key, digest], "left_anti")


def run_stats(results: DataFrame) -> DataFrame:
    """results: (status: indexed, skipped or error). One row: scanned, indexed, skipped, errors."""
    return results.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the greatest by order; aggregated, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in rows.columns if c != key])
