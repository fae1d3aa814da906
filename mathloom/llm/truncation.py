"""Text cut off by field limits (problem 4) and the end-of-text model it shares with problem 1.

Three kinds of evidence that a value breaks off:

* a longer copy elsewhere: values are sorted over the cluster; a value is a strict prefix of some other value exactly
  if it is one of its successor in that order (self-join by prefix, without comparing all pairs);
* the end-of-text likelihood: the share of the occurrences of a value's last characters, numbers made alike, that
  stand at the end of a value, counted over all values. Sound solutions end with their result, so the ends that count
  are seen at ends almost always, while what a cut leaves behind is seen in mid-text almost always;
* marks a cut leaves behind: an ellipsis, half a character, an opened bracket, a dangling operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm import plainform as pf
from mathloom.llm.shingles import mix
from mathloom.sources.shared import materialize

ORDERS = (8, 5)
LEAST_SEEN = 3
LIKELY = 0.5
# A unit and a stop may follow a result: so many characters.
NEAR = 6
# Ends seen in less than this share of all values are no contexts of the table, which so has at most 1 / share rows.
LEAST_SHARE = 2e-5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NUMBER = re.compile(r"[0-9][0-9./%:]*")
# What no sound value ends with (fixed values).
_CUT = re.compile(r"(?:…|\.\.\.|�|[\\\"“‘'（(《\[{，,、：:；;+\-×÷*/=＝^_&~])$")
_NUMBER_UNIT = re.compile(r"0 ?[^\W\d_]{0,4}$")
_TAIL_NUMBER = re.compile(r"([0-9]+(?:\.[0-9]*)?)$")
_ALL_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)?")


def squash(text: str) -> str:
    """Plain form without blanks at the end, every number one character."""
    return _NUMBER.sub("0", pf.fold_text(text).rstrip())


def cut_mark(text: str) -> bool:
    return bool(_CUT.search(text))


def number_cut(text: str) -> bool:
    """Ends in a number that is a strict prefix of the last number worked out before it and occurs nowhere else."""
    m = _TAIL_NUMBER.search(text[len(text.rstrip("0123456789.")) :])
    if not m:
        return False
    tail = m.group(1)
    before = _ALL_NUMBERS.findall(text[: len(text) - len(tail)])
    return bool(before) and tail not in before and len(before[-1]) > len(tail) and before[-1].startswith(tail)


def tail_hashes(squashed: list[str], order: int) -> np.ndarray:
    """Hash of the last ``order`` characters of each text (padded in front)."""
    n = len(squashed)
    cp = np.frombuffer("".join(t[-order:].rjust(order) for t in squashed).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(n, order)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = h * _BASE + cp[:, i]
    return mix(h)


def all_hashes(squashed: list[str], order: int) -> np.ndarray:
    """Hashes of every ``order`` characters in a row of all texts, each text padded in front."""
    text = "".join(" " * order + t for t in squashed)
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = np.fromiter((len(t) for t in squashed), dtype=np.int64, count=len(squashed))
    at = np.repeat(np.cumsum(n + order) - n - order - (np.cumsum(n) - n), n) + np.arange(n.sum()) + 1
    h = np.full(len(at), order, np.uint64)
    for i in range(order):
        h = h * _BASE + cp[at + i]
    return mix(h)


class EndModel:
    """Sorted context hashes, each with the likelihood that the text ends there, and that it ends within ``NEAR``."""

    def __init__(self, codes: np.ndarray, end: np.ndarray, near: np.ndarray) -> None:
        self.codes, self.end, self.near = codes, end, near

    def _of(self, squashed: list[str], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
        """Both likelihoods of each text's end, of its longest context known."""
        end, near = np.zeros(len(squashed)), np.zeros(len(squashed))
        for order in reversed(orders) if len(self.codes) and squashed else ():
            h = tail_hashes(squashed, order)
            at = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
            known = self.codes[at] == h
            end, near = np.where(known, self.end[at], end), np.where(known, self.near[at], near)
        return end, near

    def likely(self, squashed: list[str]) -> np.ndarray:
        """Whether each text's end is one: as it stands, with the full stop it may lack, or, for a number with or
        without its unit, if texts end soon after it."""
        end, near = self._of(squashed)
        stopped, _ = self._of([t + "。" if t[-1:].isalnum() else t for t in squashed], ORDERS[:1])
        number = np.fromiter((bool(_NUMBER_UNIT.search(t)) for t in squashed), bool, len(squashed))
        return (np.maximum(end, stopped) >= LIKELY) | (number & (near >= LIKELY))


def _squashed(values: pd.Series) -> list[str]:
    return [s for s in (squash(v) for v in values) if s]


def fit_ends(values: DataFrame, column: str = "value") -> EndModel:
    """Count over all values: first how often each context ends a value, then how often the frequent ones occur at all."""
    texts = values.select(F.col(column).alias("v")).where("v IS NOT NULL")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts = [], 0
        for b in batches:
            s = _squashed(b["v"])
            counts += len(s)
            codes += [tail_hashes(s, o) for o in ORDERS] if s else []
        u, c = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pd.DataFrame({"code": np.append(u.view(np.int64), 0), "n": np.append(c, counts)})

    counted = materialize(texts.mapInPandas(ends, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "ends")
    total = counted.where("code = 0").agg(F.max("n")).first()[0] or 0
    least = LEAST_SHARE * total
    frequent = counted.where((F.col("code") != 0) & (F.col("n") >= F.lit(least))).toPandas()  # at most 2 / LEAST_SHARE rows
    order = np.argsort(frequent["code"].to_numpy(np.int64).view(np.uint64))
    codes = frequent["code"].to_numpy(np.int64).view(np.uint64)[order]
    n_end = frequent["n"].to_numpy(np.int64)[order]
    known = values.sparkSession.sparkContext.broadcast(codes)

    def anywhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = known.value
        counts, close = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for b in batches:
            s = _squashed(b["v"])
            n = np.fromiter((len(t) for t in s), dtype=np.int64, count=len(s))
            to_come = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1
            for o in ORDERS if s and len(c) else ():
                h = all_hashes(s, o)
                at = np.minimum(np.searchsorted(c, h), len(c) - 1)
                hit = c[at] == h
                counts += np.bincount(at[hit], minlength=len(c))
                close += np.bincount(at[hit & (to_come <= NEAR)], minlength=len(c))
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"i": met, "n": counts[met], "near": close[met]})

    seen = texts.mapInPandas(anywhere, "i bigint, n bigint, near bigint").groupBy("i").agg(F.sum("n").alias("n"), F.sum("near").alias("near")).toPandas()
    n_any, n_near = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    n_any[seen["i"].to_numpy()] = seen["n"].to_numpy()
    n_near[seen["i"].to_numpy()] = seen["near"].to_numpy()
    enough = n_any >= LEAST_SEEN
    return EndModel(codes[enough], n_end[enough] / n_any[enough], n_near[enough] / n_any[enough])


def prefixes(values: DataFrame) -> DataFrame:
    """(pos, field, value, longer) of rows of ``values`` (pos, field, value) whose value is a strict prefix of a longer
    value elsewhere; ``longer`` is one that goes on no further.

    Marks and blanks at the end of a value don't count. Distinct values are range-partitioned and sorted, so hot values
    cost no more than others; each is compared with its successor only. Of each partition just the first and the
    last value meet their neighbours, on the driver.
    """
    rows = values.select("pos", "field", F.rtrim("value", F.lit("…�. \t\r\n　")).alias("value")).where("value <> ''")
    ordered = rows.select("value").distinct().repartitionByRange("value").sortWithinPartitions("value")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = leaf = None
        chain: list[str] = []  # values each a prefix of the next and of ``last``; they are as few as a value has characters
        for b in batches:
            found = []
            for v in b["value"]:
                if v != last:
                    if last is None:
                        first = v
                    elif v.startswith(last):
                        chain.append(last)
                    else:
                        leaf = last if leaf is None else leaf
                        found += [(c, last) for c in chain]
                        chain = []
                    last = v
            if found:
                yield pd.DataFrame(found, columns=["value", "longer"], dtype=object).assign(first=None, last=None)
        if last is not None:
            if chain:
                yield pd.DataFrame([(c, last) for c in chain], columns=["value", "longer"], dtype=object).assign(first=None, last=None)
            # of an edge, ``longer`` is what the first value's chain ends with
            yield pd.DataFrame({"value": None, "longer": [leaf or last], "first": [first], "last": [last]}, dtype=object)

    scanned = materialize(ordered.mapInPandas(scan, "value string, longer string, first string, last string"), "prefixes")
    edges = scanned.where("value IS NULL").orderBy("first").select("first", "last", "longer").collect()  # one row a partition
    over: dict[str, str] = {}
    for a, b in reversed(list(zip(edges, edges[1:]))):
        if b["first"].startswith(a["last"]):
            over[a["last"]] = over.get(b["longer"], b["longer"])
    cut = scanned.where("value IS NOT NULL").select("value", "longer")
    if over:
        further = values.sparkSession.createDataFrame(list(over.items()), "longer string, further string")
        cut = cut.join(F.broadcast(further), "longer", "left").select("value", F.coalesce("further", "longer").alias("longer"))
        cut = cut.unionByName(further.select(F.col("longer").alias("value"), F.col("further").alias("longer")))
    return rows.join(cut, "value").select("pos", "field", "value", "longer").distinct()


def longer_copies(values: DataFrame) -> DataFrame:
    """(pos, field) of rows of ``values`` that are strict prefixes."""
    return prefixes(values).select("pos", "field").distinct()
