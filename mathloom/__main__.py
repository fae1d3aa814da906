"""Command line: registered queries, and the jobs on files.

    python -m mathloom                                 the names of the queries
    python -m mathloom query NAME TABLES OUT           rows of a query as Parquet
    python -m mathloom build PROBLEMS OUT              solutions and wrong solutions; goes on where OUT stops
    python -m mathloom repair ROWS OUT                 repair of annotated rows; prints the counters
    python -m mathloom augment PROBLEMS OUT            problems with redrawn numbers
    python -m mathloom preprocess ROWS OUT             supervised rows and pairs, split in train and val
    python -m mathloom infer PROBLEMS OUT              answers as a submission

PROBLEMS is a JSON array or Parquet, ROWS are Parquet. ``--generator module:factory`` names what makes the generator;
without it a stub answers.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.operators import curate, repair
from mathloom.plans import jobs
from mathloom.plans.queries import QUERIES
from mathloom.plans.ship import ship
from mathloom.sources import files
from mathloom.sources.generate import stub
from mathloom.sources.shared import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mathloom", description="Jobs and queries on school maths word problems")
    kinds = p.add_subparsers(dest="job")
    q = kinds.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("tables")
    q.add_argument("out")
    for name in ("build", "repair", "augment", "preprocess", "infer"):
        j = kinds.add_parser(name)
        j.add_argument("input")
        j.add_argument("out")
        if name in ("build", "repair", "infer"):
            j.add_argument("--generator", help="module:factory of the generator")
            j.add_argument("--workers", type=int, default=4)
            j.add_argument("--limit", type=int, default=0, help="the first rows only, for a trial (0: all)")
        if name == "build":
            j.add_argument("--wrong", choices=["scdpo", "simple", "none"], default="simple")
            j.add_argument("--save-every", type=int, default=10_000)
        if name == "augment":
            j.add_argument("--copies", type=int, default=1)
            j.add_argument("--ratio", type=float, default=0.3)
        if name == "preprocess":
            j.add_argument("--val-ratio", type=float, default=0.1)
        if name == "infer":
            j.add_argument("--direct", action="store_true", help="the text itself is the answer")
    return p


def _factory(name: str | None) -> Callable:
    if name is None:
        return lambda: stub
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _rows(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    rows = files.read_problems(spark, path) if path.endswith(".json") else spark.read.parquet(path)
    if not limit:
        return rows
    return curate.head(rows, limit) if "pos" in rows.columns else rows.limit(limit)


def main(args: list[str]) -> None:
    a = parser().parse_args(args)
    if a.job is None:
        print("\n".join(QUERIES))
        return
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    with tables(spark):
        if a.job == "query":
            QUERIES[a.name](spark, a.tables).write.parquet(a.out)
        elif a.job == "build":
            problems = _rows(spark, a.input, a.limit).select("id", "question", "answer", "instruction")
            jobs.annotate(problems, _factory(a.generator), a.out, a.workers, wrong=None if a.wrong == "none" else a.wrong, save_every=a.save_every)
        elif a.job == "repair":
            done = jobs.repaired(_rows(spark, a.input, a.limit), _factory(a.generator), a.workers)
            files.write_snapshot(done.drop("repair_type", "phase", "recycled", "solved"), a.out)
            repair.counters(done).show(truncate=False)
        elif a.job == "augment":
            curate.augment(_rows(spark, a.input), a.copies, a.ratio).write.parquet(a.out)
        elif a.job == "preprocess":
            rows = _rows(spark, a.input)
            curate.split(curate.supervised_rows(rows), "id", a.val_ratio).write.partitionBy("split").parquet(f"{a.out}/supervised")
            curate.preference_pairs(rows).write.parquet(f"{a.out}/pairs")
        else:
            answers = jobs.infer(_rows(spark, a.input, a.limit), _factory(a.generator), not a.direct, a.workers)
            files.write_submission(curate.by_number(answers).select("id", F.col("answer").alias("ret")), a.out)


if __name__ == "__main__":
    main(sys.argv[1:])
