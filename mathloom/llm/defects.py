"""Broken prompt and response pairs (problem 1) and truncated values (problem 4).

Each value gets the first kind of defect that holds: empty, refusal, question_copy, other_language, truncated.
Language is decided by naive Bayes posteriors of prompt and response (``language``), truncation by the end-of-text
n-gram likelihood (``truncation``); the short answers of ``api_answer`` get their ends from the trusted answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm import language, refusal, truncation
from mathloom.llm import plainform as pf

FIELDS = ("cot", "api_answer", "wrong_cot")
# Statuses of rows for which a wrong text was made (fixed values of the data model).
MADE = ("scdpo", "simple_try1", "simple_try2", "simple_try3", "hard_fallback", "latex_demoted", "recycled")

# Words that say that nothing is there (fixed values).
NOTHING = frozenset(
    "无 暂无 没有 空 空白 缺 缺失 略 未知 无内容 无答案 待补 待补充 待填 待定 未填 未填写 未提供 na null none nil nan undefined empty blank missing tbd todo unknown".split()
)
# More letters and digits than any of them has.
_MANY = re.compile(r"(?:[\W_]*[^\W_]){12}")
# Wording of a refusal (fixed values); it counts only in a text that works nothing out.
_REFUSAL = re.compile(
    "无法(?!一步)|不能(?!直接写出|整除)|不便|不会(?!做)|没有能力|没有办法|没办法|拒绝|不提供|禁止|暂不|跳过|帮不上|难从命|没有学会|答不了|做不了|不在我的|自行思考|没有可以说|只能由老师|不想回答|不予"
    r"|\b(?:cannot|can't|can not|unable|declin\w+|refus\w+|would rather not|won't|not able|isn't something|outside my scope|no solution can|not allowed)\b"
    r"|\b(?:ne peux pas|ne puis|désolé|no puedo|lo siento|kann (?:ich )?\w* ?nicht|leider|tut mir leid|não posso|desculpe|non posso|mi dispiace|tidak (?:dapat|bisa)|maaf|nie mogę|üzgünüm)\b"
    "|できません|お答えでき|申し訳|할 수 없|답할 수|죄송|không thể|xin lỗi|не могу|извин|لا أستطيع|لا يمكن",
    re.IGNORECASE,
)
_WORKED = re.compile(r"[0-9}）)][^\W\d]{0,3}\s*(?:[×÷+*=]|-(?=[0-9])|\\times|\\div)\s*[0-9（(\\]|=\s*[0-9\\]")
_DIGIT = re.compile("[0-9]")
_RESULT = re.compile(r"(?:答案|结果|得到|应填|(?<![回解作])答)\D{0,4}[0-9]")
# A number announced as the result; the last number at the end of a value; all numbers.
_FINAL = re.compile(r"(?:答案|应填|最终|最后得到|得出结果|综上|答[:：]|answer is)[^0-9。！!]{0,10}[0-9][0-9./%:{}]*+(?![^0-9，。；,;！!]{0,8}[=＝×÷+*/-])", re.IGNORECASE)
_LAST_NUMBER = re.compile(r"([0-9]+(?:[./:][0-9]+)*)[^0-9=＝×÷+*/-]{0,8}$")
_NUMBERS = re.compile(r"[0-9]+(?:[./:][0-9]+)*")
_ANSWER = re.compile(r"^[^\w]*[0-9]+(?:[.:/][0-9]+)*(?:%|[^\W\d]{1,4}[23]?)?[。.！!]?$")


def is_nothing(plain: str) -> bool:
    """Null apart, a value says that nothing is there if it is blank, only marks, or one of the words for nothing."""
    plain = plain.strip()
    if _MANY.match(plain):
        return False
    bare = re.sub(r"[\W_]+", "", plain).lower()
    return bare in NOTHING or (bare == "" and len(plain) < 8 and not re.search(r"[…�\\]|\.\.\.", plain))


def copy_shares(values: list[str], questions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the value's trigrams that the question has, of the question's that the value has; same beginning."""
    out = np.zeros((3, len(values)))
    for i, (v, q) in enumerate(zip(values, questions)):
        v, q = pf.similarity_form(v), pf.similarity_form(q)
        a = {v[j : j + 3] for j in range(len(v) - 2)}
        b = {q[j : j + 3] for j in range(len(q) - 2)}
        if a and b:
            both = len(a & b)
            out[:, i] = both / len(a), both / len(b), q[2:10] in v[:24]
    return out[0], out[1], out[2]


class Judge:
    """All that is needed to name the defect of a value; small enough to be sent to every task."""

    def __init__(self, odds: np.ndarray, refusals: np.ndarray, cot_ends: truncation.EndModel, answer_ends: truncation.EndModel) -> None:
        self.odds, self.refusals, self.cot_ends, self.answer_ends = odds, refusals, cot_ends, answer_ends

    def defects(self, field: str, values: pd.Series, questions: pd.Series) -> np.ndarray:
        """Kind of defect of each value, None if there is none; null values are empty."""
        n = len(values)
        kind = np.full(n, None, dtype=object)
        null = values.isna().to_numpy()
        plain = [pf.fold_text(v) if v is not None and v == v else "" for v in values]
        kind[null | np.fromiter(map(is_nothing, plain), bool, n)] = "empty"

        left = np.flatnonzero(kind == None)  # noqa: E711
        worked = np.fromiter((bool(_WORKED.search(plain[i]) or _RESULT.search(plain[i])) for i in left), bool, len(left))
        # a wording of refusal beside no digit at all, or a refusal by the model, where nothing is worked out
        no = np.fromiter((not w and not _DIGIT.search(plain[i]) and bool(_REFUSAL.search(plain[i])) for i, w in zip(left, worked)), bool, len(left))
        ask = np.flatnonzero(~worked & ~no)
        no[ask] = refusal.refuses([plain[i] for i in left[ask]], self.refusals)
        kind[left[no]] = "refusal"
        left, worked = left[~no], worked[~no]
        asked = questions.fillna("").tolist()
        long = np.fromiter((len(plain[i]) >= 12 for i in left), bool, len(left)) & (~worked)
        some = left[long]
        of_value, of_question, begins = copy_shares([plain[i] for i in some], [asked[i] for i in some])
        copies = ((of_value >= 0.75) & (of_question >= 0.75)) | ((of_value >= 0.85) & (begins > 0))
        kind[some[copies]] = "question_copy"

        left = np.flatnonzero(kind == None)  # noqa: E711
        maybe = np.flatnonzero(~language.surely_chinese([plain[i] for i in left]))
        score, letters = language.posterior_other(pd.Series([plain[left[i]] for i in maybe], dtype=object), self.odds)
        foreign = np.zeros(len(left), bool)
        foreign[maybe] = (letters >= 3) & (score > 0)
        # the response is in another language than its prompt
        some = np.flatnonzero(foreign)
        foreign[some] = language.posterior_other(pd.Series([asked[left[i]] for i in some], dtype=object), self.odds)[0] <= 0
        kind[left[foreign]] = "other_language"

        left = left[~foreign]
        squashed = [truncation.squash(plain[i]) for i in left]
        marks = np.fromiter((truncation.cut_mark(plain[i].rstrip()) for i in left), bool, len(left))
        numbers = np.fromiter((truncation.number_cut(plain[i].rstrip()) for i in left), bool, len(left))
        model = self.answer_ends if field == "api_answer" else self.cot_ends
        unlikely = ~model.likely(squashed)
        if field == "api_answer":  # a number with a unit is whole, even with a unit that no trusted answer has
            unlikely &= np.fromiter((not _ANSWER.match(re.sub(r"\s", "", plain[i])) for i in left), bool, len(left))
            numbers[:] = False
            marks |= np.fromiter((bool(re.search(r"[0-9]\.$", plain[i].rstrip())) for i in left), bool, len(left))
        else:  # a sound solution ends with its result, however often a cut copy is repeated
            numbers |= np.fromiter(("0" not in t[-truncation.NEAR - 1 :] for t in squashed), bool, len(left))
        kind[left[marks | unlikely | numbers]] = "truncated"
        return kind


def answer_model(cot: DataFrame) -> truncation.EndModel:
    """Ends of trusted answers: every end of the answer column that is seen often enough, its likelihood 1."""
    texts = cot.select(F.col("answer").alias("v")).where("v IS NOT NULL")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = []
        for b in batches:
            s = [x for x in (truncation.squash(v).lstrip() for v in b["v"]) if x]
            if s:
                codes.append(truncation.tail_hashes(s, truncation.ORDERS[0]))
        u, c = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pd.DataFrame({"code": u.view(np.int64), "n": c})

    counted = texts.mapInPandas(ends, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    total = texts.count()
    got = counted.where(F.col("n") >= F.lit(truncation.LEAST_SHARE * total)).toPandas()
    codes = np.sort(got["code"].to_numpy(np.int64).view(np.uint64))
    return truncation.EndModel(codes, np.ones(len(codes)), np.zeros(len(codes)))


def judge(cot: DataFrame) -> Judge:
    """Fit all models on the table: language on a bounded sample of prompts, ends on every value."""
    texts = cot.select(F.explode(F.array("cot", "wrong_cot")).alias("value"))
    values = cot.select(F.explode(F.array(*FIELDS)).alias("value"))
    refusals = refusal.fit(values, lambda t: bool(_REFUSAL.search(t)))
    return Judge(language.fit(cot, "question"), refusals, truncation.fit_ends(texts), answer_model(cot))


def defects(cot: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(pos, field, defect): one row per defective value.

    Null, empty and blank values are ``empty``; wrong_cot is judged empty only where wrong_status says that a wrong
    text was made. Repeated rows count each by its pos; an empty table gives no rows; values are judged whole; other
    columns are not looked at. A null question makes no copy.
    """
    known = cot.sparkSession.sparkContext.broadcast(judge(cot))
    # positions pass Python as text: a null among them would make floats of large integers
    rows = cot.select(F.col("pos").cast("string").alias("pos"), "question", F.lower(F.regexp_replace("wrong_status", r"\s", "")).isin(*MADE).alias("made"), *fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in fields:
                kind = known.value.defects(f, b[f], b["question"])
                keep = kind != None  # noqa: E711
                if f == "wrong_cot":
                    keep &= (kind != "empty") | (b["made"] == True).to_numpy(bool)  # noqa: E712 - null is no status
                yield pd.DataFrame({"pos": b["pos"][keep], "field": f, "defect": kind[keep]})

    found = rows.mapInPandas(run, "pos string, field string, defect string")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def breaks_off(value: str, longer: str) -> bool:
    """Whether a strict prefix of ``longer`` breaks off: what follows is more than marks, and it has no result yet.

    A result is a number announced as the result, or the last number of the longer value, at the end of the prefix.
    """
    plain, rest = pf.fold_text(value).rstrip(), pf.fold_text(longer[len(value) :])
    if is_nothing(plain) or not re.search(r"\w", rest):
        return False
    if re.search(r"[0-9]$", plain) and re.match(r"[./:]?[0-9]", rest):
        return True  # within a number
    if _FINAL.search(plain):
        return False
    own, last = _LAST_NUMBER.search(plain), _NUMBERS.findall(rest)
    return own is None or bool(last) and last[-1] != own.group(1)


def truncated(cot: DataFrame) -> DataFrame:
    """(pos, field, longer_copy): truncated values of cot and wrong_cot, and whether a longer copy is in the table.

    A value with a longer copy elsewhere breaks off unless it has its result (the longer copy then merely goes on), is
    empty, a refusal, a copy of the question or in another language; besides, values are judged by their end.
    """
    found = defects(cot, ("cot", "wrong_cot"))
    values = cot.select("pos", F.explode(F.map_from_arrays(F.array(F.lit("cot"), F.lit("wrong_cot")), F.array("cot", "wrong_cot"))).alias("field", "value")).where("value IS NOT NULL")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["pos", "field"]].assign(longer_copy=True, cut=[breaks_off(v, w) for v, w in zip(b["value"], b["longer"])])

    copies = truncation.prefixes(values).where("pos IS NOT NULL").mapInPandas(check, "pos bigint, field string, longer_copy boolean, cut boolean")
    both = found.join(copies, ["pos", "field"], "full").where("defect = 'truncated' OR defect IS NULL AND cut")
    return both.select("pos", "field", F.coalesce("longer_copy", F.lit(False)).alias("longer_copy"))
