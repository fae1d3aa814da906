"""Language posteriors from character n-gram naive Bayes (part of problem 1).

Two classes: Chinese, fitted on a bounded sample of prompts (``sample_rows``, a documented bound), and any other
language, fitted on the short seed sentences below. Features are hashed unigrams and bigrams of
letters and the blocks of 256 code points they come from.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm.shingles import mix

SLOTS = 1 << 16
SAMPLE_ROWS = 5_000
# Texts of Han and ASCII letters alone, with a larger share of Han letters than this, are not scored: the posterior of
# such a text is Chinese anyhow. Texts with a letter of any other script, kana for one, always are.
MAINLY = 0.6

# Seed sentences written for this module, on the subject of the corpus.
SEEDS = [
    "First we look at the numbers given in the problem. Then we multiply and add step by step and keep the units. So the answer is twenty four apples in total, about half of it equals eighty pieces.",
    "one two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand percent kilograms metres hours",
    "Les données du problème sont connues. Ensuite on calcule la valeur et on trouve finalement le résultat, cela fait quinze euros. Je ne sais pas vingt-quatre mètres, cent, mille, la moitié.",
    "Zuerst betrachten wir die gegebenen Zahlen. Danach rechnen wir Schritt für Schritt, das macht fünfzehn Stück, also ist die Antwort dreiundzwanzig. Der Preis beträgt zwölf Euro und die Hälfte bleibt.",
    "El enunciado nos da los datos. Después calculamos con cuidado el valor intermedio, luego sumamos o restamos. Así obtenemos la respuesta: cuarenta y dos, ocho kilos, son veinte en total.",
    "Prima guardiamo i numeri del problema. Poi calcoliamo il valore passo dopo passo e quindi la risposta è ventiquattro, in totale dodici mele e otto euro.",
    "Primeiro olhamos os dados do problema. Depois calculamos passo a passo e portanto a resposta é vinte e quatro, no total são doze maçãs e oito reais.",
    "Eerst kijken we naar de gegeven getallen. Daarna rekenen we stap voor stap en dus is het antwoord vierentwintig stuks in totaal.",
    "Сначала посмотрим на данные числа. Затем вычислим промежуточное значение по шагам. Значит, ответ двадцать четыре штуки, всего двенадцать яблок.",
    "わかっている数を見ます。つぎに、途中の値を求めます。したがって、答えはにじゅうよんです。さんじゅうに こです。",
    "먼저 문제에 나온 수를 적습니다. 다음으로 중간 값을 구합니다. 그다음 차례대로 계산합니다. 따라서 정답은 스물네 개입니다. 그러므로 됩니다.",
    "Đề bài cho biết các số. Sau đó tính giá trị trung gian. Vậy đáp số là hai mươi bốn quả, tất cả mười hai mét.",
    "Pertama kita catat angka dari soal. Kemudian kita kerjakan langkah berikutnya. Hasil akhirnya dua puluh empat buah, jadi semuanya delapan.",
    "Najpierw patrzymy na dane liczby. Potem liczymy krok po kroku, więc odpowiedź to dwadzieścia cztery sztuki razem.",
    "Önce verilen sayılara bakalım. Sonra adım adım hesaplarız ve sonuç yirmi dört tane olur.",
    "ننظر أولا إلى الأعداد المعطاة ثم نحسب خطوة بخطوة والجواب هو أربعة وعشرون",
    "ก่อนอื่นดูตัวเลขที่ให้มา จากนั้นคำนวณทีละขั้น ดังนั้นคำตอบคือยี่สิบสี่",
    "पहले दी गई संख्याएँ देखते हैं। फिर चरण दर चरण गणना करते हैं और उत्तर चौबीस है",
]

# Letters that are no language: units of numbers, markup, step labels (fixed values).
_UNIT_AFTER_NUMBER = re.compile(r"(?<=\d)\s*(?:[kcdm]?m[²³23]?|[km]?g|[km]?l|km/h|min|t|h|s)(?![A-Za-z])", re.IGNORECASE)
_STEP = re.compile(r"\\[A-Za-z]+|\bstep\s*\d*|\bste?\W*$", re.IGNORECASE)
_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's letters, words parted by one space; markup, units of numbers and step labels left out."""
    return _LETTERS.sub(" ", _STEP.sub(" ", _UNIT_AFTER_NUMBER.sub(" ", text))).strip().lower()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of the letter unigrams and bigrams of each text."""
    padded = [f" {t} " for t in texts]
    cp = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(padded)), np.fromiter(map(len, padded), dtype=np.int64, count=len(padded)))
    if not len(cp):
        return np.zeros(0, np.int64), doc
    two = (cp[:-1] << np.uint64(21)) | cp[1:]
    inside = (doc[1:] == doc[:-1]) & ((cp[:-1] != 32) | (cp[1:] != 32))
    one = cp != 32
    block = mix((cp[one] >> np.uint64(8)) + np.uint64(1 << 55))  # the script, for letters that no class has seen
    slot = np.concatenate([mix(cp[one]), block, mix(two[inside] + np.uint64(1 << 50))]) % np.uint64(SLOTS)
    return slot.astype(np.int64), np.concatenate([doc[one], doc[one], doc[1:][inside]])


def log_odds(chinese: list[str], other: list[str] = SEEDS) -> np.ndarray:
    """Log of P(gram | other language) / P(gram | Chinese) for each slot, with add-one smoothing by class size."""
    table = []
    for texts in (other, chinese):
        slot, _ = grams([letters(t) for t in texts])
        n = np.bincount(slot, minlength=SLOTS).astype(float)
        table.append(np.log((n + 0.05) / (n.sum() + 0.05 * SLOTS)))
    return (table[0] - table[1]).astype(np.float32)


def fit(prompts: DataFrame, column: str, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fit on a bounded sample of prompts: the ``sample_rows`` of least hash, so the same on every run.

    Rows that can't be among them (by the number of rows) are left out first, so a task hands on few of them.
    """
    rows = prompts.select(F.col(column).alias("p")).where("p IS NOT NULL").withColumn("h", F.xxhash64("p"))
    share = min(1.0, 3 * sample_rows / max(1, rows.count()))
    least = rows.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod("h", F.lit(1 << 30)), "p").limit(sample_rows)
    return log_odds([x for x in least.toPandas()["p"]] or ["题目给出了几个数，下面逐个使用，求一共有多少？"])


def surely_chinese(texts: list[str]) -> np.ndarray:
    """Whether a text has no letters but Han and ASCII ones, and over ``MAINLY`` of them Han even if units count."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    han = (cp >= 0x3400) & (cp <= 0x9FFF)
    plain_mark = (cp < 65) | ((cp > 90) & (cp < 97)) | ((cp > 122) & (cp < 0xC0)) | ((cp >= 0x2000) & (cp < 0x2C00)) | ((cp >= 0x3000) & (cp < 0x3040)) | ((cp >= 0xFF00) & (cp < 0xFF20)) | (cp == 0xD7) | (cp == 0xF7)
    chinese = np.bincount(of[han], minlength=len(texts))
    other = np.bincount(of[~han & ~plain_mark], minlength=len(texts))
    script = np.bincount(of[~han & ~plain_mark & (cp >= 0x250)], minlength=len(texts))
    return (chinese > MAINLY * (chinese + other)) & (script == 0)


def posterior_other(texts: pd.Series, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of another language, number of letters) of each text."""
    kept = [letters(t) for t in texts]
    slot, doc = grams(kept)
    score = np.bincount(doc, odds[slot], minlength=len(kept)) if len(slot) else np.zeros(len(kept))
    n = np.array([len(k) - k.count(" ") for k in kept], dtype=np.int64)
    return score, n
