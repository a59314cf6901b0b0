"""Folder watching: file arrivals as a stream, debounce, serial batches with recorded errors."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomeforge.sources.files import SUPPORTED

BINARY = "path string, modificationTime timestamp, length long, content binary"
QUIET_SECONDS = 2.0


def wanted(path: Column) -> Column:
    """Book files in their final form; part files, hidden and backup files are not."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(name).rlike(r"\.(pdf|epub|fb2|txt)$") & ~name.rlike(r"^[.~]|~$|\.(tmp|part)\b")


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """New files of one folder, not of its subfolders."""
    if not os.path.isdir(folder.removeprefix("file://")) and "://" not in folder:
        raise ValueError(f"{folder} is no folder")
    return spark.readStream.format("binaryFile").schema(BINARY).load(folder).where(wanted(F.col("path")))


def debounce_stream(events: DataFrame, ts: str, key: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, first_at, last_at, n): one row per burst of events, when `quiet` has passed without another."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, quiet).alias("w"), key).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n")).drop("w")


def debounce_batch(events: DataFrame, ts: str, key: str, quiet_seconds: float = QUIET_SECONDS) -> DataFrame:
    """The same over a finished log: gaps and islands."""
    w = Window.partitionBy(key).orderBy(ts, *[c for c in ("event_id",) if c in events.columns])
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    burst = F.sum((F.coalesce(gap, F.lit(1 << 60)) > int(quiet_seconds * 1_000_000)).cast("int")).over(w)
    return events.withColumn("burst", burst).groupBy(key, "burst").agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"))


def consume(stream: DataFrame, pipeline: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Batches one after the other; a failing batch is reported and the stream goes on."""

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            pipeline(batch, epoch)
        except Exception as e:  # noqa: BLE001 - the stream outlives a broken batch
            if failed is None:
                raise
            failed(epoch, e)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def parse_payloads(lines: DataFrame, col: str = "json") -> DataFrame:
    """(ok, stage, error, is_duplicate, reason) of an ingestion report {results: [...], errors: [...]}, also of broken ones."""
    schema = "path string, results array<struct<source_path:string,is_duplicate:boolean,reason:string>>, errors array<struct<path:string,error:string>>, _broken string"
    j = F.from_json(col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    first_error, first = F.get(j["errors"], 0)["error"], F.get(j["results"], 0)
    error = F.when(j.isNull() | j["_broken"].isNotNull(), "the report is no JSON object").when(F.size(j["errors"]) > 0, F.coalesce(first_error, F.lit("unknown error"))).when(F.coalesce(F.size(j["results"]), F.lit(0)) < 1, "the report has no results").when(first["source_path"].isNull(), "the report's entry is broken")
    return lines.select(col, error.isNull().alias("ok"), F.when(error.isNotNull(), "ingest").alias("stage"), error.alias("error"), F.coalesce(first["is_duplicate"], F.lit(False)).alias("is_duplicate"), first["reason"].alias("reason"))
