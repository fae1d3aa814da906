"""Queries of the text operators, each over its whole tables. They have no SQL twin: tests compare them otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.defects import defects

    return defects(_read(spark, d, "train_cot_raw"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.simjoin import key_pairs, near_duplicates

    return key_pairs(*near_duplicates(_read(spark, d, "train_cot_raw")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row an id: its class (ids of one text share it) and the number of other classes it is linked to."""
    from mathloom.llm.simjoin import near_duplicates

    pairs, members = near_duplicates(_read(spark, d, "train_cot_raw"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(F.col("key").alias("id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.overlap import cross_split

    splits = [_read(spark, d, s).select("id", "question", F.lit(s).alias("split")) for s in ("val_split", "test")]
    pairs, members = cross_split(_read(spark, d, "train"), splits[0].unionByName(splits[1]), tags=("split",))
    return pairs.join(members, "rep").select("train_id", F.col("key").alias("eval_id"), "split", "coverage")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("train_id", "eval_id", "split").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records that occur in train, by split and source of the evaluation record: how many there are, how many
    occur, in how many pairs, and which mean share of their characters the training text nearest to them covers.

    A record that stands under several sources counts under the least of them."""
    hit = _overlaps(spark, d).groupBy("eval_id", "split").agg(F.countDistinct("train_id").alias("copies"), F.max("coverage").alias("coverage"))
    rows = [_read(spark, d, s).select(F.expr("try_cast(id AS bigint)").alias("eval_id"), "source", F.lit(s).alias("split")) for s in ("val_split", "test")]
    records = rows[0].unionByName(rows[1]).groupBy("eval_id", "split").agg(F.min("source").alias("source"))
    return (
        records.join(hit, ["eval_id", "split"], "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("copies").alias("overlapping"), F.coalesce(F.sum("copies"), F.lit(0)).alias("pairs"), F.avg("coverage").alias("coverage"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.defects import truncated

    return truncated(_read(spark, d, "train_cot_raw")).select("pos", "field")


def p4_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates each field: values, truncated values and their share, and how many of the
    truncated values are strict prefixes of a longer copy elsewhere."""
    from mathloom.llm.defects import truncated

    cot = _read(spark, d, "train_cot_raw")
    found = truncated(cot).select("pos", "field", F.col("longer_copy").cast("int").alias("copy"))
    values = cot.select("pos", "source", F.explode(F.map_from_arrays(F.array(F.lit("cot"), F.lit("wrong_cot")), F.array("cot", "wrong_cot"))).alias("field", "value")).where("trim(value) <> ''")
    n = values.join(found, ["pos", "field"], "left").groupBy("source", "field").agg(F.count("*").alias("n"), F.count("copy").alias("truncated"), F.coalesce(F.sum("copy"), F.lit(0)).alias("with_longer_copy"))
    return n.withColumn("share", F.col("truncated") / F.col("n"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.canonical import canonical_values, fields

    return canonical_values(fields(_read(spark, d, "train"), _read(spark, d, "train_cot_raw")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).where("odd").select("field", "rec_key").distinct()


def p5_plain(spark: SparkSession, d: str) -> DataFrame:
    """The canonical form of every value that is not plain."""
    return _canonical(spark, d).where("odd").select("field", "rec_key", "value", "plain")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.tokenize import encode_texts

    return encode_texts(_read(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.packing import pack
    from mathloom.llm.tokenize import token_counts

    return pack(token_counts(_read(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from mathloom.llm.spam import spam_pages

    return spam_pages(_read(spark, d, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_report, p4_found, p4_by_source, p5_found, p5_plain, p6_ids, p7_containers, p8_found)
}
