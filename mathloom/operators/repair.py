"""Which annotated rows need work: demotion, consensus and classes, and the merge of what generators give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathloom.functions.numbers import answers_match, with_match
from mathloom.functions.text import filled, has_latex

LEAST_LENGTH = 10


def demote_latex(df: DataFrame) -> DataFrame:
    """Solutions with LaTeX become wrong ones where none (or only one with LaTeX) is there; they are blanked either way."""
    latex = has_latex(F.col("cot"))
    move = latex & (~filled(F.col("wrong_cot")) | has_latex(F.col("wrong_cot")))
    pick = lambda new, old: F.when(move, new).otherwise(F.col(old))
    blank = lambda c: F.when(latex, F.lit("")).otherwise(F.col(c))
    return df.withColumns(
        {
            "wrong_cot": pick(F.col("cot"), "wrong_cot"),
            "wrong_answer": pick(F.col("api_answer"), "wrong_answer"),
            "wrong_status": pick(F.lit("latex_demoted"), "wrong_status"),
            "cot": blank("cot"),
            "api_answer": blank("api_answer"),
            "answer_match": F.when(latex, F.lit(False)).otherwise(F.col("answer_match")),
        }
    )


def consensus(df: DataFrame) -> DataFrame:
    """Unmatched rows with two answers: where they agree they become the answer, else the row goes. Run after demotion."""
    open_ = ~F.coalesce("answer_match", F.lit(False)) & filled(F.col("api_answer")) & filled(F.col("wrong_answer"))
    kept = with_match(df.withColumn("_open", open_), "_agree", "api_answer", "wrong_answer").where(~F.col("_open") | F.col("_agree"))
    fixed = F.col("_open") & F.col("_agree")
    return kept.withColumns({"answer": F.when(fixed, F.col("api_answer")).otherwise(F.col("answer")), "answer_match": F.when(fixed, F.lit(True)).otherwise(F.col("answer_match"))}).drop("_open", "_agree")


def classify(df: DataFrame) -> DataFrame:
    """Add ``repair_type``: A (no solution), B-fresh and B-failed (no wrong one), C (wrong, nothing to show), or ok."""
    right = filled(F.col("cot")) & filled(F.col("api_answer"))
    matched = F.coalesce("answer_match", F.lit(False))
    wrong = filled(F.col("wrong_cot"))
    failed = F.coalesce(F.col("wrong_status") == "failed", F.lit(False))
    kind = F.when(~right, "A").when(matched & ~wrong & failed, "B-failed").when(matched & ~wrong, "B-fresh").when(~matched & ~wrong, "C").otherwise("ok")
    return df.withColumn("repair_type", kind)


def plan(df: DataFrame) -> DataFrame:
    """Demotion, consensus and class of each row, in that order, with the phase that takes it up."""
    phase = F.when(F.col("repair_type").isin("A", "C"), 1).when(F.col("repair_type") == "B-fresh", 2).when(F.col("repair_type") == "B-failed", 3)
    return classify(consensus(demote_latex(df))).withColumn("phase", phase)


def first_of_each(df: DataFrame, n: int, kind: str = "repair_type", position: str = "pos") -> DataFrame:
    """The first n rows of each class. Spark keeps n rows a class and partition before the shuffle (window group limit)."""
    w = Window.partitionBy(kind).orderBy(position)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recycle(df: DataFrame) -> DataFrame:
    """Class C rows with a solution of some length keep it as their wrong one; add ``recycled``."""
    use = (F.col("repair_type") == "C") & (F.coalesce("api_answer", F.lit("")) != "") & (F.char_length("cot") >= LEAST_LENGTH)
    use = F.coalesce(use, F.lit(False))
    pick = lambda new, old: F.when(F.col("recycled"), new).otherwise(F.col(old))
    return df.withColumn("recycled", use).withColumns({"wrong_cot": pick(F.col("cot"), "wrong_cot"), "wrong_answer": pick(F.col("api_answer"), "wrong_answer"), "wrong_status": pick(F.lit("recycled"), "wrong_status")})


def apply_right(df: DataFrame, replies: DataFrame) -> DataFrame:
    """First phase: put new solutions (id, new_cot, new_answer) into recycled rows; a reply without answer changes nothing.

    ``solved`` tells whether a row got a new answer. A recycled row whose new answer is the wrong one again is marked ``ground_truth_suspect`` and loses its wrong part.
    """
    j = df.join(replies.select("id", "new_cot", "new_answer"), "id", "left").withColumn("_got", filled(F.col("new_answer")))
    j = j.withColumn("_match", answers_match(F.col("new_answer"), F.col("answer")))
    j = j.withColumn("_suspect", F.col("_got") & ~F.col("_match") & F.col("recycled") & answers_match(F.col("new_answer"), F.col("wrong_answer")))
    new = lambda v, c: F.when(F.col("_got"), v).otherwise(F.col(c))
    sus = lambda v, c: F.when(F.col("_suspect"), F.lit(v)).otherwise(F.col(c))
    out = j.withColumns(
        {
            "cot": new(F.col("new_cot"), "cot"),
            "api_answer": new(F.col("new_answer"), "api_answer"),
            "answer_match": new(F.col("_match"), "answer_match"),
            "status": new(F.lit("ok"), "status"),
            "wrong_cot": sus("", "wrong_cot"),
            "wrong_answer": sus("", "wrong_answer"),
            "wrong_status": sus("ground_truth_suspect", "wrong_status"),
            "solved": F.col("_got"),
        }
    )
    return out.drop("new_cot", "new_answer", "_got", "_match", "_suspect")


def accepted_wrong(answer: str, gold: str):
    """A wrong answer counts if it is one: not blank and not the right one."""
    return filled(F.col(answer)) & ~answers_match(F.col(answer), F.col(gold))


def apply_wrong(df: DataFrame, replies: DataFrame, status: str) -> DataFrame:
    """Later phases: put accepted wrong solutions (id, new_cot, new_answer) in place under ``status``.

    Replies with a ``new_step`` (from which step on they are wrong) set ``wrong_error_step``; others null it, if it is
    a column of the table.
    """
    stepped = "new_step" in replies.columns
    new = ["new_cot", "new_answer", *(["new_step"] if stepped else [])]
    j = df.join(replies.select("id", *new), "id", "left").withColumn("_ok", accepted_wrong("new_answer", "answer"))
    put = lambda v, c: F.when(F.col("_ok"), v).otherwise(F.col(c))
    out = {"wrong_cot": put(F.col("new_cot"), "wrong_cot"), "wrong_answer": put(F.col("new_answer"), "wrong_answer"), "wrong_status": put(F.lit(status), "wrong_status")}
    if stepped or "wrong_error_step" in df.columns:
        old = F.col("wrong_error_step") if "wrong_error_step" in df.columns else F.lit(None).cast("int")
        out["wrong_error_step"] = F.when(F.col("_ok"), F.col("new_step") if stepped else F.lit(None).cast("int")).otherwise(old)
    return j.withColumns(out).drop(*new, "_ok")


def counters(df: DataFrame) -> DataFrame:
    """One row about a repaired table that still has ``repair_type``, ``phase``, ``recycled`` and ``solved``: rows to
    repair, rows solved again, recycled, suspected, wrong solutions by simple and hard prompts, all fixed, still failed."""
    status = F.coalesce("wrong_status", F.lit(""))
    open_ = F.col("repair_type") != "ok"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    row = df.agg(
        n(open_).alias("failures"),
        n(F.col("phase") == 1).alias("phase1"),
        n((F.col("phase") == 1) & F.col("solved")).alias("solved"),
        n(F.col("recycled")).alias("recycled"),
        n((F.col("phase") == 1) & (status == "ground_truth_suspect")).alias("suspect"),
        n(open_ & status.startswith("simple_try")).alias("simple"),
        n(open_ & (status == "hard_fallback")).alias("hard"),
        n((F.col("repair_type") == "A") & F.coalesce(F.col("status") != "ok", F.lit(True))).alias("still_failed_right"),
        n(open_ & (status == "failed")).alias("still_failed_wrong"),
    )
    return row.withColumn("fixed", F.col("solved") + F.col("simple") + F.col("hard"))


def retry_rows(df: DataFrame) -> DataFrame:
    """Rows for a second round: not matched, or not ok."""
    return df.where(~F.coalesce("answer_match", F.lit(False)) | F.coalesce(F.col("status") != "ok", F.lit(True)))
