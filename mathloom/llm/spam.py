"""Keyword-stuffed and link-list pages (problem 8).

The corpus teaches which words stand beside each other in sentences: words and neighbouring words are counted over all
lines of all pages that are sentences by their form (an end mark after clauses of some length), and each pair of
neighbours gets its pointwise mutual information.  A line that is no sentence, exercise or table is judged by the mean
of it over its neighbours: keywords, slogans and tags seldom stand beside each other in sentences, so they are
incoherent, while headings, cut-off sentences and lists that teach are made of the pairs that sentences have.  A line
whose collocations merely repeat is spam as well, and so is one that consists mostly of links.  A page is spam if more
than half of it is spam lines.

Counts over keywords and sentences alike don't tell them apart, since keywords keep company with keywords.

A Chinese character counts as a word, a run of other letters as one, all numbers as one; links are words of one kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm.shingles import mix
from mathloom.sources.shared import materialize


@dataclass(frozen=True)
class Spam:
    """Parameters. Pairs of less than ``least_share`` of all neighbours in sentences are not in the broadcast table (so
    at most 1 / least_share are); they count as unassociated, with a PMI of 0. A line of at least ``least_words``, or
    the shorter ones of a page together (``low_short``), is spam if its mean PMI is under ``low``; of a page with fewer
    words than that, but ``least_list``, the mean has to be under ``low_few``. ``clause`` is the mean number of
    Chinese characters (of five letters, for words of letters) that the clauses of a sentence have at least."""

    half: float = 0.5
    least_share: float = 2e-6
    low: float = 1.8
    low_short: float = 2.3
    least_words: int = 40
    least_list: int = 16
    low_few: float = 0.8
    clause: int = 8
    words_a_clause: int = 5
    repeats: float = 0.6


_LINK = re.compile(r"<a\b[^>]*>|</?[a-z]+[^>]*>|https?://[^\s）)\]|<>，。]+|www\.[^\s）)\]|<>，。]+", re.IGNORECASE)
# Exercises and tables teach though they hold no sentences.
_EXERCISE = re.compile(r"[0-9][^\W\d]{0,2}\s*(?:[+×÷*=－＝]|-(?=\s*[0-9])|\\times|\\div|\\frac)|[0-9]/[0-9]|_{2,}|……?\s*[0-9]|\\frac")
_HAN_STOPS, _LATIN_STOPS = "。？！", ".?!"
_HAN_CLAUSE, _LATIN_CLAUSE = re.compile(r"[，。？！；、：\s]"), re.compile(r"[,.?!;:]")
_SPACES = re.compile(r"\s")
_BREAKS = re.compile(r"[\r\n\u2028\u2029]+")


def _kinds() -> np.ndarray:
    """Kind of every code point: 0 none, 1 Chinese, 2 other letter, 3 digit, 4 blank, 5 line end."""
    kind = np.zeros(0x110000, np.uint8)
    for o in range(0x30000):
        c = chr(o)
        kind[o] = 1 if 0x3400 <= o <= 0x9FFF else 2 if c.isalpha() else 3 if c.isdecimal() else 4 if c.isspace() else 0
    kind[0x20000:0x32000] = 1
    kind[10] = 5
    return kind


class _Tables:
    """Built once a process."""

    kind: np.ndarray | None = None


class Words:
    """The words of many lines, in flat arrays: code, kind and line of each word, and the pairs of neighbours."""

    def __init__(self, lines_: list[str]) -> None:
        kind = _Tables.kind if _Tables.kind is not None else _kinds()
        _Tables.kind = kind
        text = "\n".join(x.replace("\n", " ") for x in lines_).lower()
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        k = kind[np.minimum(cp, 0x10FFFF)]
        line = np.cumsum(k == 5)
        self.n_lines = len(lines_)
        self.bare = np.bincount(line[k < 4], minlength=self.n_lines)
        before = np.r_[np.uint8(0), k[:-1]] if len(k) else k
        start = np.flatnonzero(((k > 0) & (k < 4)) & ((k == 1) | (k != before)))
        self.kind, self.line = k[start], line[start]
        # a Chinese character stands for itself, all numbers for one, letters of a run are hashed with their places
        self.first = cp[start]
        self.code = np.where(self.kind == 3, np.uint64(1), self.first.astype(np.uint64))
        runs = np.flatnonzero(k == 2)
        if len(runs):
            head = np.r_[True, runs[1:] != runs[:-1] + 1]
            at = np.flatnonzero(head)
            place = np.arange(len(runs)) - np.repeat(at, np.diff(np.r_[at, len(runs)]))
            h = mix(cp[runs].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
            self.code[self.kind == 2] = np.add.reduceat(h, at) | np.uint64(1 << 40)
        self.left = np.flatnonzero(self.line[1:] == self.line[:-1]) if len(start) else np.zeros(0, np.int64)
        self.pair = mix(mix(self.code[self.left]) + self.code[self.left + 1])

    def per_line(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.line[which], minlength=self.n_lines)

    def repeats(self) -> np.ndarray:
        """Share of each line's pairs that occurred in it before."""
        of = self.line[self.left]
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (self.pair >> np.uint64(24)))
        own = (key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(40)).astype(np.int64) if len(key) else of
        n = np.bincount(of, minlength=self.n_lines)
        return 1 - np.bincount(own, minlength=self.n_lines) / np.maximum(n, 1)


def lines(text: str) -> list[str]:
    return [x for x in _BREAKS.split(text) if x and not x.isspace()]


def unlinked(line: str) -> str:
    return _LINK.sub(" ", line) if "/" in line or "<" in line or "www" in line or "WWW" in line else line


class Associations:
    """PMI of the frequent pairs of neighbouring words, by sorted hash."""

    def __init__(self, pairs: np.ndarray, pmi: np.ndarray) -> None:
        self.pairs, self.pmi = pairs, pmi

    def lookup(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each pair is in the table, its PMI)."""
        if not len(self.pairs):
            return np.zeros(len(pair), bool), np.zeros(len(pair))
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return self.pairs[at] == pair, self.pmi[at]


def associations(pages: DataFrame, text: str, p: Spam = Spam()) -> Associations:
    """Counts over the sentences of all pages: words and neighbours are counted in each partition first, then summed;
    none is left out, so the counts are the same however the pages are dealt out."""

    def add(have: tuple, new: np.ndarray, payload: np.ndarray) -> tuple:
        """Counts and one payload of each distinct code, those had and the new ones together."""
        u, at, n = np.unique(new, return_index=True, return_counts=True)
        codes, first, inverse = np.unique(np.concatenate([have[0], u]), return_index=True, return_inverse=True)
        return codes, np.bincount(inverse, np.concatenate([have[1], n]), len(codes)).astype(np.int64), np.concatenate([have[2], payload[at]])[first]

    def rows(one: tuple, two: tuple) -> pd.DataFrame:
        ab = np.concatenate([one[2], two[2]]).view(np.int64)
        return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1], "n": np.concatenate([one[1], two[1]])})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))
        one = two = none
        for b in batches:
            w = Words([r for t in b["text"] for r in map(unlinked, lines(t)) if is_sentence(r, p)])
            one = add(one, w.code, np.stack([w.code, np.zeros_like(w.code)], 1))
            two = add(two, w.pair, np.stack([w.code[w.left], w.code[w.left + 1]], 1))
            if len(two[0]) > 1_000_000:  # what a task holds stays bounded; the sums are made in the shuffle
                yield rows(one, two)
                one = two = none
        yield rows(one, two)

    src = pages.select(F.col(text).alias("text")).where("text IS NOT NULL")
    counts = materialize(src.mapInPandas(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "words")
    total = counts.where("b = 0").agg(F.sum("n")).first()[0] or 1
    got = counts.where(F.col("n") >= F.lit(p.least_share * total)).toPandas()  # at most 2 / least_share rows
    one = got[got["b"] == 0].set_index("a")["n"]
    two = got[got["b"] != 0]
    n1 = two["a"].map(one).fillna(p.least_share * total).to_numpy(float)
    n2 = two["b"].map(one).fillna(p.least_share * total).to_numpy(float)
    pmi = np.log(two["n"].to_numpy(float) * total / np.maximum(n1 * n2, 1))
    a, b = two["a"].to_numpy(np.int64).view(np.uint64), two["b"].to_numpy(np.int64).view(np.uint64)
    h = mix(mix(a) + b)
    order = np.argsort(h)
    return Associations(h[order], pmi[order])


def is_sentence(rest: str, p: Spam) -> bool:
    """Ends as a sentence does, in clauses of some length."""
    end = rest.rstrip()
    if end[-1:] in _HAN_STOPS:
        clauses = [x for x in _HAN_CLAUSE.split(end) if x]
        return sum(map(len, clauses)) >= p.clause * max(1, len(clauses))
    if end[-1:] in _LATIN_STOPS:
        clauses = [x for x in _LATIN_CLAUSE.split(end) if x.strip()]
        return sum(len(x.split()) for x in clauses) >= p.words_a_clause * max(1, len(clauses))
    return False


TEXT, SPAM, SHORT = 0, 1, 2


def line_kinds(rows: list[str], known: Associations, p: Spam = Spam()) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(kind, length, sum of PMI, words) of the lines; ``SHORT`` lines can't be judged by themselves."""
    rest = [unlinked(x) for x in rows]
    w = Words(rest)
    whole = w.bare.copy()
    linked = np.fromiter((a is not b for a, b in zip(rows, rest)), bool, len(rows))
    whole[linked] = [len(_SPACES.sub("", rows[i])) for i in np.flatnonzero(linked)]
    n, repeats = w.per_line(w.kind > 0), w.repeats()
    sentence = np.fromiter((is_sentence(x, p) for x in rest), bool, len(rows))
    links = (whole - w.bare > w.bare) & ~(sentence & (w.bare > 30))
    repeated = (repeats > p.repeats) & (n > p.least_words / 2)
    doubt = ~links & ~sentence
    at = np.flatnonzero(doubt)
    doubt[at] = [not _EXERCISE.search(rest[i]) for i in at]
    kind = np.full(len(rows), TEXT, np.int8)
    kind[links | (doubt & repeated)] = SPAM
    doubt &= ~repeated
    of = w.line[w.left]
    ask = doubt[of]
    hit, pmi = known.lookup(w.pair[ask])
    total = np.bincount(of[ask], pmi * hit, len(rows))
    pairs = np.bincount(of[ask], minlength=len(rows))
    short = doubt & (n < p.least_words)
    kind[short] = SHORT
    kind[doubt & ~short & (total < p.low * np.maximum(pairs, 1))] = SPAM
    return kind, whole, total, w


def spam_shares(texts: list[str], known: Associations, p: Spam = Spam()) -> np.ndarray:
    """Share of each page's characters in spam lines; the short lines of a page are judged together, as one list, if
    they have ``least_list`` words."""
    pages = [lines(t) for t in texts]
    rows = [x for page in pages for x in page]
    if not rows:
        return np.zeros(len(texts))
    page = np.repeat(np.arange(len(pages)), np.fromiter(map(len, pages), dtype=np.int64, count=len(pages)))
    kind, length, total, w = line_kinds(rows, known, p)
    sums = lambda x, of: np.bincount(page[kind == of], x[kind == of], len(texts)).astype(float)
    spam, whole = sums(length, SPAM), np.bincount(page, length, len(texts))
    n, pairs = sums(w.per_line(w.kind > 0), SHORT), sums(np.bincount(w.line[w.left], minlength=len(rows)), SHORT)
    mean = sums(total, SHORT) / np.maximum(pairs, 1)
    here = kind[w.line[w.left]] == SHORT
    of, pair = page[w.line[w.left][here]].astype(np.uint64), w.pair[here]
    distinct = np.unique((of << np.uint64(40)) | (pair >> np.uint64(24))) >> np.uint64(40)
    repeats = 1 - np.bincount(distinct.astype(np.int64), minlength=len(texts)) / np.maximum(pairs, 1)
    incoherent = (mean < np.where(n < p.least_words, p.low_few, p.low_short)) & (n >= p.least_list)
    incoherent |= (repeats > p.repeats) & (n > p.least_words / 2)
    spam += np.where(incoherent, sums(length, SHORT), 0)
    return spam / np.maximum(whole, 1)


def spam_share(text: str, known: Associations, p: Spam = Spam()) -> float:
    return float(spam_shares([text], known, p)[0])


def spam_pages(pages: DataFrame, key: str = "doc_id", text: str = "text", p: Spam = Spam()) -> DataFrame:
    """(key, share): pages of which more than half is spam, each copy its own row.

    Null, empty and blank texts are no spam and give no row; texts are read whole; other columns are not looked at.
    """
    known = pages.sparkSession.sparkContext.broadcast(associations(pages, text, p))
    # keys pass Python as text: a null among them would make floats of large integers
    src = pages.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = spam_shares(b["text"].tolist(), known.value, p)
            yield pd.DataFrame({"key": b["key"], "share": share})[share > p.half]

    return src.mapInPandas(judge, "key string, share double").select(F.col("key").cast(dict(pages.dtypes)[key]).alias(key), "share")
