"""Metrics of runs as a table that only grows: one row a run, step and name."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.operators.keyed import last_by_key

SCHEMA = "run string, step bigint, name string, value double"


def setup_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(asctime)s [%(levelname)s] %(name)s: %(message)s", datefmt="%Y-%m-%d %H:%M:%S")


class Metrics:
    """The metrics of one run at a path. A failure to write is logged and does not stop the run."""

    def __init__(self, spark: SparkSession, path: str, run: str) -> None:
        self.spark, self.path, self.run = spark, path, run

    def log(self, metrics: Mapping[str, float], step: int | None = None) -> bool:
        rows = [(self.run, step, k, float(v)) for k, v in metrics.items() if v is not None and math.isfinite(v)]
        try:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        except Exception as e:  # noqa: BLE001 - whatever the file system raises
            logging.getLogger(__name__).warning("metrics of %s not written: %s", self.run, e)
            return False
        return True

    def log_row(self, df: DataFrame, step: int | None = None) -> bool:
        """The numbers of a one-row result, such as ``evaluate.accuracy`` gives."""
        row = df.first().asDict()
        return self.log({k: v for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}, step)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last value of each metric of each run."""
    rows = spark.read.schema(SCHEMA).parquet(path).withColumn("_key", F.struct("run", "name"))
    return last_by_key(rows, "_key", "step").drop("_key")
