"""Places that every executor sees, and tables that are written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []
_OWN: list[str] = []


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get(_SETTING, None)


def _hadoop_path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with the scheme of its file system.

    A path without scheme belongs to Hadoop's default file system, as for Spark itself: Python workers, which open files
    on their own, get the whole address. Where the setting is missing, one machine makes a new temporary folder, and a
    cluster is refused with ValueError: its executors have no folder in common.
    """
    found = _named(spark)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='refloom-')}")
        found = _OWN[0]
    path, system = _hadoop_path(spark, found)
    whole = system.makeQualified(path).toString()
    return ("file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """A new folder name below shared_dir(); nothing is made."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_places(spark: SparkSession, since: int = 0) -> int:
    """Deletes what was written to places of new_place (but the first `since` of them), once no result that reads them is needed any more; gives their number."""
    gone = 0
    while len(_MADE) > since:
        path, system = _hadoop_path(spark, _MADE.pop())
        gone += bool(system.delete(path, True))
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, tables may be written to the shared folder as needed; at its end those are deleted. What is computed from them has to be written elsewhere, or collected, before."""
    before = len(_MADE)
    try:
        yield
    finally:
        remove_places(spark, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as the session shuffles to, by keys if given: for much work on rows that take little space, which adaptive execution would put into few tasks."""
    spark = df.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(many, *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back.

    This cuts the lineage in a way that outlives lost executors, and gives Spark the true size: joins with the
    table are broadcast only if that is below spark.sql.autoBroadcastJoinThreshold. What was shuffled for it goes as soon
    as it is written; else it stays on disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    place = new_place(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(place)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once, as materialize does it."""
    return materialize(df, "settled")
