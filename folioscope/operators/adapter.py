"""Asking a model of one's own: some requests at once in each task, tries again, smaller requests, answers kept between runs."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.model import shrunk

#: States of a service that are worth another try.
AGAIN = {408, 429, 500, 502, 503, 524, 529}


class ModelError(Exception):
    """A failed request: its state, and whether it was too large."""

    def __init__(self, message: str, status: int | None = None, too_large: bool = False) -> None:
        super().__init__(message)
        self.status, self.too_large = status, too_large


def asked_one(ask: Callable[[str], str], body: Callable[[int], str], most: int = 6000, tries: int = 4, wait: float = 0.5) -> tuple[str | None, str | None]:
    """(answer, error): tried again with growing pauses while the service is busy, with smaller bodies while they are too large."""
    error: Exception | None = None
    for size in shrunk(most):
        for k in range(tries + 1):
            try:
                return ask(body(size)), None
            except ModelError as x:
                error = x
                if x.too_large:
                    break
                if x.status not in AGAIN or k == tries:
                    return None, str(x)
                time.sleep(wait * 2**k)
            except OSError as x:
                error = x
                if k == tries:
                    return None, str(x)
                time.sleep(wait * 2**k)
    return None, str(error)


def asked(df: DataFrame, ask: Callable[[str], str], at_once: int = 8, most: int = 6000, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """(key, answer, error) for the rows (key, content), in their order; one row's failure is no other's."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(lambda t: asked_one(ask, lambda n: (t or "")[:n], most, tries, wait), b["content"]))
                yield pd.DataFrame({"key": b["key"], "answer": [g[0] for g in got], "error": [g[1] for g in got]})

    return df.select("key", "content").mapInPandas(work, "key string, answer string, error string")


def answered(spark: SparkSession, df: DataFrame, ask: Callable[[str], str], cache: str, **how: object) -> DataFrame:
    """(key, answer, error): kept answers are used, only the rest is asked, once for each key; what was answered is appended to the cache's folder."""
    todo = df.select("key", "content").dropDuplicates(["key"])
    there = os.path.isdir(cache) and any(n.endswith(".parquet") for n in os.listdir(cache)) if "://" not in cache else True
    kept = spark.read.parquet(cache).select("key", "answer") if there else None
    left = todo if kept is None else todo.join(kept, "key", "left_anti")
    new = asked(left, ask, **how)
    fresh = cache.rstrip("/") + ".new"
    new.write.mode("overwrite").parquet(fresh)
    new = spark.read.parquet(fresh)
    new.filter("answer is not null").select("key", "answer").write.mode("append").parquet(cache)
    failed = new.filter("answer is null")
    return spark.read.parquet(cache).select("key", "answer", F.lit(None).cast("string").alias("error")).dropDuplicates(["key"]).join(todo.select("key"), "key", "left_semi").unionByName(failed)
