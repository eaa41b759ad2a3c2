"""Shared plumbing of the training-data operators: column access and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space, tab, LF, VT, FF, CR.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only where all run in one process may it be unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quarrylight-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Lists that take note of the tables staged while they are open, innermost last.
_watchers: list[list[DataFrame]] = []


@contextmanager
def watched() -> Iterator[list[DataFrame]]:
    """The tables that are staged, and not yet deleted, inside the block."""
    mine: list[DataFrame] = []
    _watchers.append(mine)
    try:
        yield mine
    finally:
        _watchers[:] = [w for w in _watchers if w is not mine]  # the list itself, not one equal to it


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stage(df: DataFrame, tag: str, batch: int = 2000) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends here, and a lost executor costs only a re-read.

    ``batch`` bounds the rows of an Arrow batch while the table is made: what a Python worker holds follows it.
    The job's shuffle files go as it ends. The table itself goes with ``unstage``, or else with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}-{tag}"
    delete_at_exit(spark, path)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    with _settings(
        spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(min(rows, batch) if rows > 0 else batch), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    ):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    for mine in _watchers:
        mine.append(out)
    return out


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete a folder when the application ends."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any longer."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)
            for mine in _watchers:
                mine[:] = [x for x in mine if x._staged_path != path]


def text_of(name: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def salts(spark: SparkSession) -> int:
    """Salt buckets for hot keys: they follow the cluster's shuffle width."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
