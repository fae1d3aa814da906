"""Accuracy of predictions, histograms and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.functions.numbers import values_equal, with_normal


def eval_details(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Add the normal forms of both and ``correct``."""
    staged = with_normal(df, pred_normalized=prediction, ref_normalized=reference)
    return staged.withColumn("correct", values_equal(F.col("pred_normalized"), F.col("ref_normalized")))


def accuracy(details: DataFrame, *by: str) -> DataFrame:
    """correct, total and accuracy (0 without rows), for each group of ``by`` if given."""
    right, total = F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)), F.count("*")
    return details.groupBy(*by).agg(right.alias("correct"), total.alias("total")).withColumn("accuracy", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("correct") / F.col("total")))


def evaluate(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Details of predictions (id, ret) against references (id, answer). References without prediction don't count."""
    return eval_details(references.join(predictions, "id"), "ret", "answer")


def zipped(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Predictions and references (pos, value) by position; a difference in length is an error."""
    a, b = predictions.count(), references.count()
    if a != b:
        raise ValueError(f"{a} predictions, {b} references")
    return eval_details(predictions.select("pos", F.col("value").alias("prediction")).join(references.select("pos", F.col("value").alias("reference")), "pos"), "prediction", "reference")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; the total is a scalar over the counts, not over the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def match_rate(df: DataFrame) -> DataFrame:
    """total, matched, not_ok and rate (0 without rows)."""
    row = df.agg(F.count("*").alias("total"), F.count_if(F.coalesce("answer_match", F.lit(False))).alias("matched"), F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("not_ok"))
    return row.withColumn("rate", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("matched") / F.col("total")))
