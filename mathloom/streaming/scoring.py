"""Incoming completions scored as a stream: the same functions on an unbounded table, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mathloom.functions.answers import with_extracted_answer
from mathloom.functions.rewards import with_rewards


def read_completions(spark: SparkSession, folder: str, schema: str = "id string, question string, completion string, answer string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def scored(stream: DataFrame) -> DataFrame:
    """Extracted answer, its level and all scores of each completion."""
    return with_extracted_answer(with_rewards(stream, "completion", "answer", "question"), "completion")


def write_scored(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that is there, once each (the checkpoint remembers what was read): the streaming form of a resumed job."""
    return scored(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
