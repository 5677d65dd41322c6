"""Tables that end lineage: written once in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode (as in tests), and on
    a cluster the warehouse, if that is no driver's own disk: each executor would write to its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        found = spark.conf.get("spark.sql.warehouse.dir")
        where = spark._jvm.org.apache.hadoop.fs.Path(found)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-shared-"))
        found = _own[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends
    there, so neither a lost executor nor a second use computes ``df`` again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


@contextmanager
def bucketed(df: DataFrame, name: str, *keys: str) -> Iterator[DataFrame]:
    """``df`` written once, dealt and sorted by ``keys``: joins on them deal their other side only.  The table is gone after the block."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, table)
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove((spark, path))


def drop(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it any more (a round that the next has replaced)."""
    _remove(df.sparkSession, df._written_at)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return
