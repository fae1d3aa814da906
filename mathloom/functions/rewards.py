"""Scores of completions: five parts, their sum, and the older two-part score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions.answers import with_extracted_answer
from mathloom.functions.numbers import with_normal, with_round_match
from mathloom.functions.text import has_latex

# Words and limits of the scores (fixed values).
BASIC = ("即", "所以", "因此", "得到", "那么")
STRUCTURE = ("首先", "已知", "题意", "设", "因为", "由于", "根据")
TAGS = ("<think>", "</think>", "<answer>", "</answer>")
SHORTEST, LONGEST = 30, 300
PARTS = ("correctness", "format", "logic", "length", "latex")


def _double(x: float) -> Column:
    return F.lit(float(x))


def format_score(text: Column) -> Column:
    every = F.lit(True)
    for tag in TAGS:
        every = every & text.contains(tag)
    return F.when(every, _double(0.2)).otherwise(_double(0))


def logic_score(text: Column) -> Column:
    def hits(words: tuple[str, ...]) -> Column:
        return sum((text.contains(w).cast("int") for w in words), F.lit(0))

    basic, structure = hits(BASIC), hits(STRUCTURE)
    return F.when(basic + structure == 0, _double(-0.3)).otherwise(basic * _double(0.05) + structure * _double(0.1))


def length_score(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n < SHORTEST, _double(-0.3)).when(n > LONGEST, _double(-0.2)).otherwise(_double(0))


def latex_score(text: Column) -> Column:
    return F.when(has_latex(text), _double(-0.3)).otherwise(_double(0))


def correctness_score(pred: Column, gold: Column, near: Column, question: Column) -> Column:
    """``pred`` and ``gold`` in normal form, ``near`` if they round to the same; null means that one can't be read."""
    exact = F.coalesce(F.coalesce(question, F.lit("")).rlike("保留|精确到"), F.lit(False))
    return F.when(pred.isNull() | gold.isNull(), _double(-0.5)).when(pred == gold, _double(1)).when(~exact & near, _double(0.3)).otherwise(_double(-0.5))


def with_rewards(df: DataFrame, text: str, gold: str, question: str) -> DataFrame:
    """Add the five scores and ``reward``; a row without gold answer scores 0 for correctness; null text counts as "None"."""
    staged = with_extracted_answer(df.withColumn("_c", F.coalesce(F.col(text), F.lit("None"))), "_c", "_e", "_l")
    staged = with_round_match(with_normal(staged, _p="_e", _g=gold), "_r", "_p", "_g")
    c = F.col("_c")
    scores = (
        F.when(F.col(gold).isNull(), _double(0)).otherwise(correctness_score(F.col("_p"), F.col("_g"), F.col("_r"), F.col(question))),
        format_score(c),
        logic_score(c),
        length_score(c),
        latex_score(c),
    )
    staged = staged.withColumns(dict(zip(PARTS, scores)))
    total = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    return staged.withColumn("reward", total).drop("_c", "_e", "_l", "_p", "_g", "_r")


def reward_functions(spark: SparkSession, parts: Sequence[str] = PARTS) -> list[Callable[..., list[float]]]:
    """The scores as functions that a trainer can take: each gets lists of completions (texts, or lists of messages),
    answers and prompts of one batch and gives a list of numbers in the same order. They run the same Column code."""

    def one(part: str) -> Callable[..., list[float]]:
        def score(completions: Sequence, answer: Sequence[str | None] | None = None, prompt: Sequence[str | None] | None = None, **_) -> list[float]:
            n = len(completions)
            text = [c if c is None or isinstance(c, str) else (c[0].get("content") or "" if c else "") for c in completions]
            rows = list(zip(range(n), text, answer or [None] * n, prompt or [None] * n))
            df = spark.createDataFrame(rows, "i int, completion string, answer string, question string").coalesce(1)
            return [r[0] for r in with_rewards(df, "completion", "answer", "question").orderBy("i").select(part).collect()]

        score.__name__ = f"{part}_reward"
        return score

    return [one(p) for p in parts]


def with_legacy_reward(df: DataFrame, text: str, gold: str, format_weight: float = 0.2, correctness_weight: float = 1.0, pattern: str = r"(?s)<think>.*?</think>\s*<answer>.*?</answer>") -> DataFrame:
    """Add ``legacy_reward``: weighted format match and equality of the normal forms."""
    staged = with_normal(with_extracted_answer(df, text, "_e", "_l"), _p="_e", _g=gold)
    form = F.coalesce(F.col(text).rlike(pattern), F.lit(False)).cast("double")
    right = F.coalesce(F.col("_p") == F.col("_g"), F.lit(False)).cast("double")
    return staged.withColumn("legacy_reward", form * _double(format_weight) + right * _double(correctness_weight)).drop("_e", "_l", "_p", "_g")
