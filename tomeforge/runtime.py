"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tomeforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan assumes: AQE, UTC, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None, spread: bool = False) -> DataFrame:
    """One table of a data folder; only the named columns are read.

    spread: for stages with much work per row; a table read in fewer splits than there are cores is dealt out to all of them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tomeforge-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(_forget)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tomeforge/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there.

    The table survives the loss of any executor, is columnar and compressed, and is removed when the driver ends or by drop().
    by: a column whose values become folders, so that a filter on it reads only theirs.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            delete_path(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
