"""One spelling for texts that look the same (problem 5).

The corpus gives the vocabulary: its words in plain characters, with counts. Words of suspicious values (those with a
character outside the plain ones) are looked up in tries of that vocabulary by a weighted edit automaton in which
stepping from a look-alike to its plain twin and passing over an invisible character cost nothing and all else is
barred; of the words reached, the most frequent is the canonical spelling. Words that reach none are normalised by
the table of ``plainform``, as is all between words.

Vocabulary and suspicious words meet in buckets of equal skeletons, one bucket for about ``BUCKET_TOKENS`` distinct
suspicious words, so no task sees more of the vocabulary than its buckets need, and nothing is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.llm import plainform as pf
from mathloom.sources.shared import materialize

BUCKET_TOKENS = 5_000
_HAN = "㐀-䶿一-鿿"
# A word: letters and digits that are not Chinese, with the marks and invisible characters among them.
_TOKEN = re.compile(rf"(?:(?![{_HAN}⺀-⿕豈-﫿])[^\W_]|[̀-ͯ­͏؜᠎​-‏⁠-⁤︀-️﻿])+")
_SKELETON = ("OolI|", "00111")
_SKEL = str.maketrans(*_SKELETON)
_VOCABULARY_WORD = r"[A-Za-z0-9À-ÖØ-öø-ſẠ-ỹ]+"


def suspicious(c: Column) -> Column:
    """Holds a character outside the surely plain ones; decided in the JVM, so most values never reach Python."""
    return c.rlike(f"[^{pf.SURE}]")


def twins(c: str) -> tuple[str, ...]:
    """What a character may stand for at no cost; "" stands for being passed over."""
    if pf.TABLE[ord(c)] == "":
        return ("",)
    plain = c.translate(pf.TABLE)
    return (plain, pf.DIGIT_TWIN[c]) if c in pf.DIGIT_TWIN else (plain,)


class Trie:
    """Vocabulary words; ``nearest`` runs the zero-cost edit automaton over it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = n

    def nearest(self, token: str) -> str | None:
        states = [(self.root, "")]
        for c in token:
            after = []
            for node, path in states:
                for t in twins(c):
                    at = node
                    for x in t:
                        at = at.get(x) if at is not None else None
                    if at is not None:
                        after.append((at, path + t))
            states = after
            if not states:
                return None
        ends = [(node[""], path) for node, path in states if "" in node]
        return max(ends, key=lambda e: (e[0], e[1]))[1] if ends else None


def skeleton(token: str) -> str:
    return pf.unicodedata.normalize("NFC", token.translate(pf.TABLE)).translate(_SKEL)


def _compose(value: str) -> str:
    """Combining accents composed with their letters, so that a word's letters are single characters."""
    return pf.unicodedata.normalize("NFC", value) if pf._COMBINING.search(value) else value


def tokens(value: str) -> list[str]:
    return [t for t in _TOKEN.findall(_compose(value)) if pf._UNSURE.search(t)]


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """(word, n): words of all values that are plain, counted over the whole table."""
    words = values.where(~suspicious(F.col(column))).select(F.explode(F.regexp_extract_all(F.col(column), F.lit(f"({_VOCABULARY_WORD})"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def spellings(odd: DataFrame, words: DataFrame) -> DataFrame:
    """(token, canonical): the vocabulary word that each distinct suspicious token reaches at no cost, if any."""
    left = odd.select("token", "skeleton").distinct()
    bucket = F.pmod(F.xxhash64("skeleton"), F.lit(max(1, -(-left.count() // BUCKET_TOKENS))))
    left = left.withColumn("bucket", bucket)
    keys = left.select("skeleton").distinct()
    right = words.withColumn("skeleton", F.translate("word", *_SKELETON)).join(keys, "skeleton", "left_semi").withColumn("bucket", bucket)

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in zip(b["word"], b["n"]):
            trie.add(w, n)
        return pd.DataFrame({"token": a["token"], "canonical": [trie.nearest(t) for t in a["token"]]}, dtype=object)

    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(look, "token string, canonical string")


def _only_other_script(token: str) -> bool:
    """Letters of one other script only: a word of that script, as far as its letters tell."""
    letters = [c for c in token if pf.TABLE[ord(c)] != ""]
    scripts = {pf.unicodedata.name(c, "?").split(" ")[0] for c in letters}
    return bool(letters) and all(pf._FOREIGN.match(c) for c in letters) and len(scripts) == 1


def rewrite(value: str, spelling: dict[str, str | None]) -> tuple[str, bool]:
    """(plain form, whether the value was not in plain form)."""
    composed = _compose(value)
    out, end, odd = [], 0, composed != value
    for m in _TOKEN.finditer(composed):
        between = composed[end : m.start()]
        out.append(pf.fold_text(between) if not pf._PICTURE.search(between) else between)
        t = m.group()
        if not pf._UNSURE.search(t) or pf.foreign_word(t) or t in "‍️" and pf._PICTURE.search(composed[m.start() - 1 : m.end()]):
            out.append(t if not pf.foreign_word(t) else "".join(c for c in t if pf.TABLE[ord(c)] != ""))
        elif (known := spelling.get(t)) is not None:
            out.append(known)
        elif _only_other_script(t):
            out.append("".join(c for c in t if pf.TABLE[ord(c)] != ""))
        else:
            out.append(pf.fold_text(t))
        end = m.end()
    between = composed[end:]
    out.append(pf.fold_text(between) if not pf._PICTURE.search(between) else between)
    plain = "".join(out)
    return plain, odd or plain != composed


def canonical_values(values: DataFrame) -> DataFrame:
    """(field, rec_key, value, plain, odd) for each distinct suspicious row of ``values`` (field, rec_key, value).

    ``plain`` is the value's canonical form, ``odd`` tells whether the value had to change. Values of plain characters
    only, null and empty values are plain as they stand and give no row; an empty table gives none. Repeated rows give
    one. Very long values are treated whole.
    """
    # keys pass Python as text: a null among them would make floats of large integers
    values = values.select("field", F.col("rec_key").cast("string").alias("rec_key"), "value")
    odd = values.where(suspicious(F.col("value"))).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, v, t, None if t is None else skeleton(t)) for f, k, v in zip(b["field"], b["rec_key"], b["value"]) for t in dict.fromkeys(tokens(v)) or [None]]
            yield pd.DataFrame(rows, columns=["field", "rec_key", "value", "token", "skeleton"])

    pieces = materialize(odd.mapInPandas(split, "field string, rec_key string, value string, token string, skeleton string"), "tokens")
    known = spellings(pieces.where("token IS NOT NULL"), vocabulary(values, "value"))
    rows = pieces.join(known, "token", "left").groupBy("field", "rec_key", "value").agg(F.collect_list(F.when(F.col("canonical").isNotNull(), F.struct("token", "canonical"))).alias("known"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [rewrite(v, {x["token"]: x["canonical"] for x in k}) for v, k in zip(b["value"], b["known"])]
            yield b[["field", "rec_key", "value"]].assign(plain=[p for p, _ in done], odd=[o for _, o in done])

    done = rows.mapInPandas(finish, "field string, rec_key string, value string, plain string, odd boolean")
    return done.withColumn("rec_key", F.col("rec_key").cast("bigint"))


def fields(train: DataFrame, cot: DataFrame) -> DataFrame:
    """The three fields that get compared, as (field, rec_key, value)."""
    key = F.expr("try_cast(id AS bigint)").alias("rec_key")
    return (
        train.select(F.lit("train.question").alias("field"), key, F.col("question").alias("value"))
        .unionByName(train.select(F.lit("train.answer").alias("field"), key, F.col("answer").alias("value")))
        .unionByName(cot.select(F.lit("train_cot_raw.api_answer").alias("field"), F.col("pos").alias("rec_key"), F.col("api_answer").alias("value")))
        .where("value IS NOT NULL AND rec_key IS NOT NULL")
    )
