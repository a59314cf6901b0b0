"""Queries of the incremental operator: files whose content differs from what the succeeded runs recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.operators.merkle import IncrementalStore, snapshot
from tomeforge.runtime import shared_path, table


def committed_files(state: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_path, fingerprint) as the succeeded run with the greatest run_no left it; index_runs has 12 rows at every scale."""
    good = runs.where(F.col("status") == "succeeded").select("run_no")
    last = state.join(F.broadcast(good), "run_no", "left_semi").groupBy("source_path").agg(F.max(F.struct("run_no", "indexed_at", F.lower("fingerprint").alias("fingerprint"))).alias("r"))
    return last.select("source_path", F.col("r.fingerprint").alias("fingerprint"))


def observed_files(scans: DataFrame) -> DataFrame:
    """(source_path, fingerprint) of each path's last observation; files last seen as absent are left out."""
    last = scans.groupBy("source_path").agg(F.max(F.struct("seen_at", "scan_no", F.lower("fingerprint").alias("fingerprint"))).alias("r"))
    return last.select("source_path", F.col("r.fingerprint").alias("fingerprint")).where(F.col("fingerprint").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the succeeded runs recorded is published as a version of a store; pending are the files that differ from it."""
    store = IncrementalStore(spark, shared_path(spark, "p1-store"))
    store.run(snapshot(committed_files(table(spark, sf_dir, "index_state"), table(spark, sf_dir, "index_runs")), "source_path", "fingerprint"), lambda pending: pending.groupBy("change").count())
    found = store.pending(snapshot(observed_files(table(spark, sf_dir, "file_scans")), "source_path", "fingerprint"))
    return found.where(F.col("change").isin("new", "changed")).select(F.col("key").alias("source_path"), F.col("digest").alias("fingerprint"))


QUERIES = {"p1_found": p1_found}

ORACLES = {
    "p1_found": """
WITH committed AS (
  SELECT source_path, lower(arg_max(fingerprint, s.run_no)) AS fp
  FROM index_state s JOIN index_runs r ON r.run_no = s.run_no AND r.status = 'succeeded' GROUP BY source_path),
seen AS (SELECT source_path, max(seen_at) AS at FROM file_scans GROUP BY source_path),
last AS (SELECT DISTINCT f.source_path, lower(f.fingerprint) AS fingerprint
  FROM file_scans f JOIN seen ON seen.source_path = f.source_path AND seen.at = f.seen_at)
SELECT l.source_path, l.fingerprint FROM last l LEFT JOIN committed c ON c.source_path = l.source_path
WHERE l.fingerprint IS NOT NULL AND (c.fp IS NULL OR c.fp <> l.fingerprint)"""
}
