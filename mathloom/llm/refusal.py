"""Refusals, told from other values by character n-gram naive Bayes (part of problem 1).

The model is fitted on a bounded sample of distinct values (``SAMPLE_ROWS``, a documented bound, those of least hash).
A value counts as a refusal for the fit if it has a wording of refusal and no digit; the sentences below, written for
this module, are added to those. Other values without such a wording are the rest. A value is a refusal by its mean
log-odds per n-gram, whatever words and digits it has, if it gives no solution.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm import language
from mathloom.llm import plainform as pf
from mathloom.llm.shingles import mix

SLOTS = 1 << 16
SAMPLE_ROWS = 10_000
# Least mean log-odds per n-gram of a refusal; in the corpus refusals have 3 and more, other values under 1.3.
LEAST = 1.6
# Least sum of them: shorter texts tell too little.
LEAST_SUM = 50.0

# Seed sentences written for this module.
SEEDS = [
    "抱歉，我没办法回答这道题。", "对不起，这个问题我不能解答，请另请高明。", "不好意思，这题我答不出来。", "很遗憾，我无法完成第0题的解答。", "这道题我懒得做，你问别人吧。",
    "作为助手，我不方便给出答案。", "恕我不能提供这道题的解法。", "超出了我的能力范围，请咨询老师。", "我拒绝回答这个问题。", "这个请求我不予处理，请自己完成作业。",
    "Sorry, I cannot solve this problem for you.", "I'm unable to answer question 0, please ask your teacher.", "I won't do this homework for you.", "As an assistant I can't provide a solution to problem 0.", "I must decline to answer this request.",
    "Désolé, je ne peux pas résoudre le problème 0.", "Je refuse de répondre à cette question.", "Lo siento, no puedo resolver el problema 0.", "No me es posible responder a esta pregunta.", "Leider kann ich diese Aufgabe nicht lösen.",
    "Es tut mir leid, Aufgabe 0 kann ich nicht beantworten.", "Mi dispiace, non posso rispondere a questa domanda.", "Desculpe, não posso resolver este problema.", "Извините, я не могу решить эту задачу.", "申し訳ありませんが、この問題にはお答えできません。",
    "죄송하지만 이 문제에는 답할 수 없습니다.", "Xin lỗi, tôi không thể giải bài này.", "Maaf, saya tidak dapat menjawab soal ini.", "Przykro mi, nie mogę rozwiązać tego zadania.", "Üzgünüm, bu soruyu cevaplayamam.", "آسف، لا أستطيع الإجابة عن هذا السؤال",
]
_DIGITS = re.compile("[0-9]+")


def grams(plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of the character bigrams and trigrams of each text, numbers made alike."""
    texts = [f" {_DIGITS.sub('0', t.lower())} " for t in plain]
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (cp[:-1] << np.uint64(21)) | cp[1:]
    three = (two[:-1] << np.uint64(21)) | cp[2:]
    in2, in3 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    slot = np.concatenate([mix(two[in2]), mix(three[in3] + np.uint64(7))]) % np.uint64(SLOTS)
    return slot.astype(np.int64), np.concatenate([doc[1:][in2], doc[2:][in3]])


def log_odds(refusals: list[str], others: list[str]) -> np.ndarray:
    """Log of P(gram | refusal) / P(gram | other) for each slot."""
    table = []
    for texts in (refusals, others):
        n = np.bincount(grams(texts)[0], minlength=SLOTS).astype(float)
        table.append(np.log((n + 0.1) / (n.sum() + 0.1 * SLOTS)))
    return (table[0] - table[1]).astype(np.float32)


def refuses(plain: list[str], odds: np.ndarray) -> np.ndarray:
    """Whether each text is a refusal by the model."""
    slot, doc = grams(plain)
    total = np.bincount(doc, odds[slot], minlength=len(plain))
    return (total >= LEAST_SUM) & (total >= LEAST * np.bincount(doc, minlength=len(plain)))


def fit(values: DataFrame, worded: Callable[[str], bool], column: str = "value", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fit on the distinct values of least hash; a hot value is one of them at most."""
    rows = values.select(F.col(column).alias("v")).where("v IS NOT NULL").withColumn("h", F.pmod(F.xxhash64("v"), F.lit(1 << 30)))
    share = min(1.0, 6 * sample_rows / max(1, rows.count()))
    least = rows.where(F.col("h") <= int(share * (1 << 30))).distinct().orderBy("h", "v").limit(sample_rows)
    plain = [pf.fold_text(v) for v in least.toPandas()["v"]]
    said = [worded(t) for t in plain]
    refusals = [t for t, yes in zip(plain, said) if yes and not _DIGITS.search(t)]
    return log_odds(SEEDS + refusals, language.SEEDS + [t for t, yes in zip(plain, said) if not yes])
