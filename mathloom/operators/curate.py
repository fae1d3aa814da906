"""Training tables from annotated rows: supervised rows, preference pairs, splits, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathloom.functions.numbers import drawn, float_text, rounded, to_double
from mathloom.functions.prompts import STEPWISE, tagged
from mathloom.functions.text import D, numbers, present


def supervised_rows(cot: DataFrame, matched_only: bool = True) -> DataFrame:
    """Rows whose answer matches (unknown counts as a match) as id, question, instruction, answer, cot."""
    rows = cot.where(F.coalesce("answer_match", F.lit(True))) if matched_only else cot
    return rows.select("id", "question", F.lit(STEPWISE).alias("instruction"), "answer", F.coalesce("cot", F.lit("")).alias("cot"))


def preference_pairs(cot: DataFrame) -> DataFrame:
    """Rows with a right and a wrong solution as chosen and rejected text. A null answer is written None, a null wrong answer 0."""
    rows = cot.where(present(F.col("cot")) & present(F.col("wrong_cot")) & F.coalesce("answer_match", F.lit(True)))
    return rows.select(
        "id",
        F.coalesce("question", F.lit("")).alias("question"),
        F.lit(STEPWISE).alias("instruction"),
        tagged(F.col("cot"), F.coalesce("answer", F.lit("None"))).alias("chosen"),
        tagged(F.col("wrong_cot"), F.coalesce("wrong_answer", F.lit("0"))).alias("rejected"),
    )


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense position (from 1) in a total order, without one task for all rows.

    Rows are range-partitioned and sorted in one shuffle and numbered as they stand (a row's number holds its partition
    in the high bits); the counts of earlier partitions, one row a partition, are added to each row's position in its
    own. ``order`` must be total for the result to be the same each time.
    """
    from mathloom.sources.shared import materialize

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def split(df: DataFrame, key: str, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly int(n * (1 - ratio)) rows are train, the rest val, drawn by key and seed."""
    ranked = with_rank(df, [drawn(F.lit(seed), F.col(key)), F.col(key)])
    head = int(ranked.count() * (1 - val_ratio))  # counted over the table just written
    return ranked.withColumn("split", F.when(F.col("rank") <= head, "train").otherwise("val")).drop("rank")


def eligible(question: Column) -> Column:
    return F.coalesce(F.size(numbers(question)) >= 2, F.lit(False))


def perturbed(number: Column, draw: Column, ratio: float) -> Column:
    """The number moved by up to ``ratio`` of itself, as ``draw`` in [0, 1) says: whole stays whole and at least 1,
    decimals keep their places; 0 becomes 1 to 10."""
    v = to_double(number)
    new = v + v * ratio * (draw * 2 - 1)
    whole = F.greatest(F.lit(1).cast("bigint"), F.rint(new).cast("bigint")).cast("string")
    places = F.char_length(F.element_at(F.split(number, r"\."), -1))
    text = float_text(rounded(new, F.when(F.contains(number, F.lit(".")), places).otherwise(F.lit(0))), point=True)
    return F.when(v.isNull(), number).when(v == 0, (F.floor(draw * 10) + 1).cast("string")).when(number.contains("."), text).otherwise(whole)


def augment(df: DataFrame, copies: int = 1, ratio: float = 0.3, seed: int = 42, start: int | None = None) -> DataFrame:
    """``copies`` of each row with two numbers or more, every number of the question redrawn by id, copy and place.

    New ids go on from ``start`` (the number of rows), in the order of the old ones. The answer is left empty.
    """
    start = df.count() if start is None else start
    rows = df.where(eligible(F.col("question"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    found = numbers(F.col("question"))
    pieces = F.split(F.col("question"), rf"{D}+\.?{D}*", -1)

    def draw(i: Column) -> Column:
        return drawn(F.lit(seed), F.col("id"), F.col("_copy"), i)

    fresh = F.transform("_found", lambda x, i: perturbed(x, draw(i), ratio))
    text = F.array_join(F.zip_with("_pieces", F.concat(fresh, F.array(F.lit(""))), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    made = rows.withColumns({"_found": found, "_pieces": pieces}).withColumn("_text", text)
    ranked = with_rank(made, [F.col("id").try_cast("bigint"), F.col("id"), F.col("_copy"), F.col("question")])
    return ranked.select(
        (F.col("rank") - 1 + start).cast("string").alias("id"),
        F.col("_text").alias("question"),
        F.lit("").alias("answer"),
        F.coalesce("instruction", F.lit("")).alias("instruction"),
        F.col("id").alias("source_id"),
        F.lit(True).alias("augmented"),
    )


def by_number(df: DataFrame, key: str = "id") -> DataFrame:
    """Sorted by the key as a number (so 2 comes before 10)."""
    return df.orderBy(F.col(key).try_cast("bigint"), F.col(key))


def head(df: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """The first n rows in file order: a top-k, not a full sort."""
    return df.orderBy(position).limit(n)
