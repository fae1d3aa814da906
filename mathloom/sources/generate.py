"""Text generators behind an adapter: any callable on executors, with retries; a stub where there is none."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from mathloom.sources.shared import materialize

Generator = Callable[[Sequence[str]], Sequence[str | None]]


def stub(prompts: Sequence[str]) -> list[str | None]:
    """Deterministic replies without a model: the number of characters of the prompt as answer."""
    return [f"推理过程：共{len(p)}字。\n答案：{len(p)}" for p in prompts]


def with_retries(generate: Generator, attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Generator:
    """Try again after 1, 2, 4 ... seconds. A batch that still fails is halved, so that only the prompts that fail by
    themselves have a null reply."""

    def run(prompts: Sequence[str]) -> Sequence[str | None]:
        for i in range(attempts):
            try:
                return list(generate(prompts))
            except Exception:  # noqa: BLE001 - whatever a client raises
                sleep(base * 2**i)
        if len(prompts) < 2:
            return [None] * len(prompts)
        half = len(prompts) // 2
        return [*run(prompts[:half]), *run(prompts[half:])]

    return run


def generate(df: DataFrame, key: str, prompt: str, make: Callable[[], Generator], parallel: int = 4) -> DataFrame:
    """(key, reply) for each row. ``make`` builds the generator once a task; at most ``parallel`` tasks call it at once.

    Replies are written before they are used: a lost executor must not pay for them, or draw them, twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = None
        for b in batches:
            generator = generator or make()
            yield pd.DataFrame({"key": b["key"], "reply": list(generator(b["prompt"].tolist()))})

    rows = df.selectExpr(f"CAST(`{key}` AS string) AS key", f"`{prompt}` AS prompt").repartition(parallel)
    return materialize(rows.mapInPandas(run, "key string, reply string"), "replies").withColumnRenamed("key", key)
