"""Tables written on the way: lineage is cut by a table in the folder all executors share, never by a local copy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. Only a local master may do without: it gets a temporary one;
    on a cluster each executor would write to a disk of its own, so that is an error."""
    path = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mathloom-")
        spark.conf.set(_CONF, path)
    return path.rstrip("/")


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def expire(spark: SparkSession, path: str) -> None:
    """Have a written path removed when the session's process ends, as a lazy result may be read until then."""
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)


def discard(spark: SparkSession, keep: int = 0) -> int:
    """Remove the tables this process wrote (but the first ``keep``), once their results have been read; returns how
    many there were."""
    n = len(_WRITTEN) - keep
    while len(_WRITTEN) > keep:
        where, system = _file_system(spark, _WRITTEN.pop())
        system.delete(where, True)
    return n


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end, whatever happens; results must have been read or written by then."""
    keep = len(_WRITTEN)
    try:
        yield
    finally:
        discard(spark, keep)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a stage that lost executors cannot undo. The table is removed
    at the end of ``tables`` or with the process."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    expire(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
