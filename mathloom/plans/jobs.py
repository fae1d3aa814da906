"""Jobs that chain the operators around a generator: annotate, repair, infer. Each pass of a generator is written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions import answers, numbers, prompts, text
from mathloom.operators import evaluate, keyed, repair
from mathloom.sources.files import resume
from mathloom.sources.generate import Generator, generate
from mathloom.sources.shared import tables

Make = Callable[[], Generator]
# Adds parsed_cot and parsed_answer of a reply column; tells whether two answers are the same.
Parse = Callable[[DataFrame, str], DataFrame]
Match = Callable[[Column, Column], Column]
# Prompt texts of these jobs.
RIGHT = "请一步一步解答下面的小学数学题，写出推理过程，并以“答案：”给出不带单位的数字。\n"
WRONG = "请解答下面的小学数学题，但在某一步犯一个自然的计算错误，并以“答案：”给出数字。\n"
CONTINUE = "下面是一道小学数学题和前几步正确的推理。请接着往下写，并在后面某一步犯一个自然的错误，使答案与 {correct_answer} 不同。先写“继续推理：”和推理，再写“答案：”和数字。\n"
HARD = WRONG + "正确答案是 {correct_answer}，你的答案必须与之不同。\n"


def _replies(rows: DataFrame, make: Make, prompt: Column, parallel: int, parse: Parse = answers.with_parsed_response) -> DataFrame:
    """(id, new_cot, new_answer) of each row's reply; an unreadable reply has an empty answer."""
    asked = rows.select("id", prompt.alias("prompt"))
    parsed = parse(generate(asked, "id", "prompt", make, parallel), "reply")
    return parsed.select("id", F.col("parsed_cot").alias("new_cot"), F.col("parsed_answer").alias("new_answer"))


def stepwise_wrong(rows: DataFrame, make: Make, parallel: int = 4, parse: Parse = answers.with_parsed_response, seed: int = 42) -> DataFrame:
    """(id, new_cot, new_answer, new_step): right solutions of two steps or more, kept up to a drawn step and continued
    wrongly. What a reply says after its mark of continuation follows the kept steps, else its reasoning."""
    steps = answers.split_steps(F.col("cot"))
    n, prefix = answers.error_prefix(F.col("_steps"), F.col("id"), seed)
    cut = rows.withColumn("_steps", steps).withColumns({"_n": n, "_prefix": prefix}).where("_n IS NOT NULL")
    prompt = F.concat(prompts.wrong_prompt(CONTINUE, F.coalesce("answer", F.lit(""))), F.lit("题目："), text.sanitize_question(F.col("question")), F.lit("\n\n已有的正确推理：\n"), F.col("_prefix"))
    asked = cut.select("id", "_n", "_prefix", prompt.alias("prompt"))
    replies = generate(asked, "id", "prompt", make, parallel).join(asked.select("id", "_n", "_prefix"), "id")
    return joined_steps(parse(replies, "reply"))


def joined_steps(parsed: DataFrame) -> DataFrame:
    """Kept steps and continuation of parsed replies (id, _n, _prefix, reply, parsed_cot, parsed_answer) as one text."""
    suffix = F.coalesce(answers.continued(F.col("reply")), F.col("parsed_cot"), F.lit(""))
    return parsed.select("id", F.concat("_prefix", F.lit("\n"), suffix).alias("new_cot"), F.col("parsed_answer").alias("new_answer"), F.col("_n").alias("new_step"))


def annotate(
    problems: DataFrame,
    make: Make,
    done_path: str | None = None,
    parallel: int = 4,
    retry: Make | None = None,
    wrong: str | None = "simple",
    parse: Parse = answers.with_parsed_response,
    match: Match = numbers.answers_match,
    save_every: int = 10_000,
) -> DataFrame:
    """Solutions for the problems (id, question, answer, instruction) that a snapshot does not hold yet, with a second
    round for those that don't match (by ``retry``, a generator of lower temperature, if given), and wrong solutions for
    those that do: ``wrong`` is "scdpo" (continue a right beginning wrongly, then simple), "simple" or None.

    With a ``done_path``, rows are taken up in parts of about ``save_every`` and each part is added to the snapshot
    when it is done, so a stop loses one part at most.
    """
    spark = problems.sparkSession
    if done_path is None:
        return _annotated(problems, make, parallel, retry or make, wrong, parse, match)
    todo, _ = resume(spark, problems, done_path)
    parts = max(1, -(-todo.count() // save_every))
    which = F.pmod(F.xxhash64("id"), F.lit(parts))
    for i in range(parts):
        with tables(spark):
            _annotated(todo.where(which == i), make, parallel, retry or make, wrong, parse, match).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def _annotated(todo: DataFrame, make: Make, parallel: int, retry: Make, wrong: str | None, parse: Parse, match: Match) -> DataFrame:
    question = text.sanitize_question(F.col("question"))
    first = _replies(todo, make, F.concat(F.lit(RIGHT), question), parallel, parse)
    rows = _matched(todo.join(first, "id", "left"), match)
    again = repair.retry_rows(rows).select("id", "question", "instruction", "answer")
    second = _matched(again.join(_replies(again, retry, F.concat(F.lit(RIGHT), question), parallel, parse), "id", "left"), match)
    rows = accept_retry(rows, second)
    none = {c: F.lit(None).cast("string") for c in ("wrong_cot", "wrong_answer", "wrong_status")}
    rows = rows.withColumns({**none, "wrong_error_step": F.lit(None).cast("int")})
    return rows if wrong is None else add_wrong(rows, make, parallel, scdpo=wrong == "scdpo", parse=parse)


def _matched(rows: DataFrame, match: Match = numbers.answers_match) -> DataFrame:
    named = rows.withColumnsRenamed({"new_cot": "cot", "new_answer": "api_answer"})
    status = F.when(F.col("api_answer").isNull(), "api_failed").when(text.filled(F.col("api_answer")), "ok").otherwise("parse_error:no_answer_extracted")
    return named.withColumns({"answer_match": match(F.col("api_answer"), F.col("answer")), "status": status})


def accept_retry(old: DataFrame, new: DataFrame) -> DataFrame:
    """A second answer replaces the first only if it matches."""
    good = new.where("answer_match AND status = 'ok'")
    return old.join(good.select("id"), "id", "left_anti").unionByName(good.select(*old.columns))


def add_wrong(rows: DataFrame, make: Make, parallel: int = 4, rounds: int = 3, scdpo: bool = False, parse: Parse = answers.with_parsed_response) -> DataFrame:
    """Wrong solutions for matched rows without one: continued right beginnings if wanted, some rounds of the simple
    prompt, then the one that names the answer."""
    open_ = F.coalesce("answer_match", F.lit(False)) & ~text.filled(F.col("wrong_cot"))
    question = text.sanitize_question(F.col("question"))
    for _ in range(rounds if scdpo else 0):
        rows = repair.apply_wrong(rows, stepwise_wrong(rows.where(open_), make, parallel, parse), "scdpo")
    for i in range(1, rounds + 1):
        rows = repair.apply_wrong(rows, _replies(rows.where(open_), make, F.concat(F.lit(WRONG), question), parallel, parse), f"simple_try{i}")
    hard = F.concat(prompts.wrong_prompt(HARD, F.coalesce("answer", F.lit(""))), question)
    rows = repair.apply_wrong(rows, _replies(rows.where(open_), make, hard, parallel, parse), "hard_fallback")
    return rows.withColumn("wrong_status", F.when(open_, "failed").otherwise(F.col("wrong_status")))


def repaired(rows: DataFrame, make: Make, parallel: int = 4, parse: Parse = answers.with_parsed_response) -> DataFrame:
    """Plan, recycle, solve again what has no right solution, then add wrong ones. Keys are made unique first. The
    columns of the plan stay, for ``repair.counters``."""
    planned = repair.recycle(repair.plan(keyed.last_by_key(rows, "id", "pos")))
    question = text.sanitize_question(F.col("question"))
    right = _replies(planned.where("phase = 1"), make, F.concat(F.lit(RIGHT), question), parallel, parse)
    return add_wrong(repair.apply_right(planned, right), make, parallel, parse=parse)


def repair_job(rows: DataFrame, make: Make, parallel: int = 4) -> DataFrame:
    return repaired(rows, make, parallel).drop("repair_type", "phase", "recycled", "solved")


def infer(problems: DataFrame, make: Make, use_cot: bool = True, parallel: int = 4) -> DataFrame:
    """(id, raw_output, answer, level) for each problem."""
    asked = problems.select("id", F.concat(F.lit(prompts.TEMPLATES["cn_step_by_step"] + "\n"), F.coalesce("question", F.lit(""))).alias("prompt"))
    out = answers.with_extracted_answer(generate(asked, "id", "prompt", make, parallel), "reply")
    return out.select("id", F.col("reply").alias("raw_output"), prompts.plain_or_extracted(use_cot, F.coalesce("reply", F.lit("")), F.col("extracted")).alias("answer"), "level")


def sampled_accuracy(problems: DataFrame, make: Make, n: int = 100, position: str = "pos") -> DataFrame:
    """Accuracy on the first n problems: a check while a model is trained."""
    first = problems.orderBy(position).limit(n)
    predictions = infer(first, make).select("id", F.col("answer").alias("ret"))
    return evaluate.accuracy(evaluate.evaluate(predictions, first.select("id", "answer")))
