"""Files of the data model: JSON arrays, submissions, snapshots, and the resolution of checkpoints."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions.text import strip, variant_text


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(pos, v VARIANT): the elements of one JSON array, in file order; a missing field stays apart from a null one."""
    whole = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path)
    return whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("pos", F.col("value").alias("v"))


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, question, answer, instruction) as text, whatever the fields hold."""
    rows = read_json_array(spark, path)
    field = lambda k: F.expr(variant_text(f"try_variant_get(v, '$.{k}', 'variant')")).alias(k)
    return rows.select("pos", F.expr("try_variant_get(v, '$.id', 'string')").alias("id"), *(field(k) for k in ("question", "answer", "instruction")))


def missing_field(path: str) -> "F.Column":
    """True where the field is absent; an explicit null is there."""
    return F.expr(f"try_variant_get(v, '$.{path}', 'variant') IS NULL")


def parse_submission(lines: DataFrame) -> DataFrame:
    """(id, ret) of lines ``value``: blank lines and lines that begin with id are no rows, nor are lines without comma."""
    v = strip(F.col("value"))
    parts = F.split(v, ",", 2)
    return lines.where((v != "") & ~v.startswith("id")).where(F.size(parts) == 2).select(*(c for c in lines.columns if c != "value"), parts[0].alias("id"), parts[1].alias("ret"))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Submission file as (pos, id, ret), pos in file order."""
    return parse_submission(spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value"))


def write_submission(df: DataFrame, path: str) -> None:
    """id,ret with a header, answers on one line."""
    df.select("id", strip(F.regexp_replace("ret", "\n", " ")).alias("ret")).write.option("header", True).option("escape", '"').csv(path)


def write_snapshot(df: DataFrame, path: str, key: str = "id") -> None:
    """Snapshot sorted by the key as a number, into a new path (what is read is never overwritten)."""
    df.orderBy(F.col(key).try_cast("bigint"), F.col(key)).write.mode("error").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_pretty_array(df: DataFrame, path: str) -> None:
    """One indented JSON array at a path or URI, for small exports: rows are streamed through the driver one partition at a time."""
    import json

    import pyarrow.fs as fs

    where, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    where.create_dir(os.path.dirname(inside))
    with where.open_output_stream(inside) as f:
        f.write(b"[")
        for i, row in enumerate(df.toLocalIterator()):
            item = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2)
            f.write(((",\n  " if i else "\n  ") + item.replace("\n", "\n  ")).encode())
        f.write(b"\n]\n")


def resume(spark: SparkSession, rows: DataFrame, path: str, key: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """(rows still to do, rows done): what a snapshot at ``path`` holds is done."""
    from mathloom.operators.keyed import todo

    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no snapshot yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows, None
    return todo(rows, done, key), done


def latest_checkpoint(path: str) -> str | None:
    """The folder itself if it holds an adapter's configuration; else the highest checkpoint-N in it (beside it, if it
    is named best); else None."""
    path = path.rstrip("/")
    if os.path.isfile(os.path.join(path, "adapter_config.json")):
        return path
    folder = os.path.dirname(path) if os.path.basename(path) == "best" else path
    found = [(int(m.group(1)), x) for x in (os.listdir(folder) if os.path.isdir(folder) else []) if (m := re.fullmatch(r"checkpoint-(\d+)", x)) and os.path.isdir(os.path.join(folder, x))]
    return os.path.join(folder, max(found)[1]) if found else None
