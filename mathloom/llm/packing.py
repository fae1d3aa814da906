"""Filling containers of fixed capacity with texts (problem 7): planning over a histogram of lengths.

The plan is made for counts, not for documents: at most ``capacity`` lengths with their counts reach the driver,
whatever the number of documents. Best fit over counts: the longest length left opens a container, the room left takes
the longest length that fits, until nothing does; the container so found is repeated as often as the counts allow.
Documents then take the planned slots by joining on their rank within their length.

Ranks are counted within (length, chunk) with the sums of earlier chunks added. Every piece has a row number of its own
and chunks are dealt out by it, one chunk for about ``CHUNK_ROWS`` pieces, so neither a length nor a document that a
third of all rows share is ever in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathloom.sources.shared import materialize

CAPACITY = 4096
CHUNK_ROWS = 20_000


@dataclass(frozen=True)
class Plan:
    """Slots of each length: from ``first`` rank on, ``per`` documents a container, beginning with ``container``."""

    length: np.ndarray
    first: np.ndarray
    container: np.ndarray
    per: np.ndarray
    containers: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Container of the document with this rank (from 0) among those of its length."""
        key = (self.length.astype(np.int64) << np.int64(44)) + self.first
        at = np.searchsorted(key, (length.astype(np.int64) << np.int64(44)) + rank, side="right") - 1
        return self.container[at] + (rank - self.first[at]) // self.per[at]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit over the counts of the lengths 1 to capacity. Length 0 takes no room: container 0 holds all of them."""
    left = {n: c for n, c in counts.items() if n > 0 and c > 0}
    if any(n > capacity for n in left):
        raise ValueError("a length exceeds the capacity: split it first")
    order = sorted(left)
    used = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int]] = []
    opened = 0
    while order:
        room, pattern = capacity, {}
        while True:
            i = bisect_right(order, room)
            while i and pattern.get(order[i - 1], 0) >= left[order[i - 1]]:
                i -= 1  # all documents of this length are in the container already
            if not i:
                break
            n = order[i - 1]
            k = min(room // n, left[n] - pattern.get(n, 0))
            pattern[n] = pattern.get(n, 0) + k
            room -= k * n
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            rows.append((n, used[n], opened, k))
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                order.pop(bisect_right(order, n) - 1)
        opened += times
    if counts.get(0):
        rows.append((0, 0, 0, max(1, counts[0])))
        opened = max(opened, 1)
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], opened)


def pieces(sizes: DataFrame, key: str = "doc_id", tokens: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, tokens): a document over the capacity in full pieces and a last one; any other is piece 0 whole."""
    n = F.greatest(F.lit(1), F.ceil(F.col(tokens) / capacity)).cast("int")
    split = sizes.select(F.col(key), F.col(tokens).alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return split.select(key, "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("int").alias("tokens"))


def pack(sizes: DataFrame, key: str = "doc_id", tokens: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, tokens, container) for every document of ``sizes`` (key, tokens); containers count from 0.

    A null size counts as 0; documents of size 0 take no room and stand in container 0. Repeated rows are placed each
    by itself; an empty table gives no rows; other columns are left out.
    """
    rows = pieces(sizes.select(F.col(key), F.coalesce(F.col(tokens), F.lit(0)).alias(tokens)), key, tokens, capacity)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    parts = rows.groupBy("tokens", "chunk").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).select("tokens", "chunk", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = parts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()  # at most capacity + 1 rows
    slots = rows.sparkSession.sparkContext.broadcast(plan({r["tokens"]: r["n"] for r in histogram}, capacity))
    local = F.row_number().over(Window.partitionBy("tokens", "chunk").orderBy("row")) - 1
    # keys pass Python as text: a null among them would make floats of large integers
    ranked = rows.withColumn("local", local).join(before, ["tokens", "chunk"]).select(F.col(key).cast("string").alias(key), "piece", "tokens", (F.col("local") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["container"] = slots.value.place(b["tokens"].to_numpy(), b["rank"].to_numpy())
                yield b.drop(columns="rank")

    kind = dict(sizes.dtypes)[key]
    return ranked.mapInPandas(place, f"`{key}` string, piece int, tokens int, container bigint").withColumn(key, F.col(key).cast(kind))
