"""Template extraction: the built-in heuristic, or an external function applied to distinct texts only."""

from __future__ import annotations

import asyncio
import inspect
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import heuristic_template


def retried(call: Callable, retries: int = 3, delay: float = 1.0) -> Callable:
    """call with up to `retries` further attempts, waiting delay, 2 delay, 4 delay ..."""

    def again(*args):
        for attempt in range(retries + 1):
            try:
                out = call(*args)
                return asyncio.run(out) if inspect.iscoroutine(out) else out
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(delay * 2**attempt)

    return again


def together(one: Callable) -> Callable[[list[str]], list]:
    """A client of lists from a coroutine function of one text."""

    async def gathered(texts: list[str]) -> list:
        return await asyncio.gather(*(one(t) for t in texts))

    return gathered


def external(texts: DataFrame, connect: Callable[[], Callable[[list[str]], list[str | None]]], retries: int = 3, delay: float = 1.0) -> DataFrame:
    """text, template_pattern of distinct texts (column text).  connect() makes one client for each partition.

    The client takes a list and returns (or awaits) a template for each.  If it has an attribute `one`, a coroutine function of one text, all texts
    of a batch are awaited together instead.  A batch that fails in all attempts is asked again text by text; missing answers and texts that
    fail alone are null: such rows fall back.
    """

    def asked(ask: Callable, texts: list[str]) -> list[str | None]:
        try:
            got = list(ask(texts))[: len(texts)]
        except Exception:  # the provider's errors are its own
            if len(texts) == 1:
                return [None]
            return [t for text in texts for t in asked(ask, [text])]
        return got + [None] * (len(texts) - len(got))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        ask = retried(together(client.one) if hasattr(client, "one") else client, retries, delay)
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"text": texts, "template_pattern": asked(ask, texts) if texts else []})

    return texts.select("text").distinct().mapInPandas(rows, "text string, template_pattern string")


def with_templates(rows: DataFrame, connect: Callable | None = None, text: str = "cleaned", ladder: str = "default", retries: int = 3, delay: float = 1.0) -> DataFrame:
    """rows with template_pattern."""
    if connect is None:
        return rows.withColumn("template_pattern", heuristic_template(F.col(text), ladder))
    found = external(rows.select(F.col(text).alias("text")), connect, retries, delay)
    return rows.join(found.withColumnRenamed("text", "_text"), F.col(text) == F.col("_text"), "left").drop("_text")
