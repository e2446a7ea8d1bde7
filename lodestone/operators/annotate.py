"""Batched annotation by pluggable providers, with a cache table and failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import cache_key

#: A provider takes rows of (key, text) and returns title, summary and key_points for each, in order.
Provider = Callable[[pd.DataFrame], pd.DataFrame]

RESULT = "key string, title string, summary string, key_points array<string>, error string"


def offline(rows: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a remote model: first line, first 300 characters, first sentences."""
    text = rows["text"].fillna("")
    points = text.map(lambda t: [s.strip() for s in t.replace("\n", " ").split(". ")[:3] if s.strip()])
    return pd.DataFrame({"title": text.map(lambda t: t.split("\n", 1)[0]), "summary": text.str.slice(0, 300), "key_points": points})


def annotate(df: DataFrame, provider: Provider = offline, concurrency: int | None = None, fail_fast: bool = False) -> DataFrame:
    """RESULT for rows of (key, text).

    A batch that a provider fails on is taken row by row, and rows that fail keep the error; ``fail_fast`` raises instead.
    ``concurrency`` bounds the calls in flight (as many partitions).
    """
    own = df.select("key", "text")
    own = own if concurrency is None else own.repartition(concurrency)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = provider(rows).reset_index(drop=True)
            return pd.DataFrame({"key": rows["key"].tolist(), "title": out["title"], "summary": out["summary"], "key_points": out["key_points"], "error": ""})
        except Exception as e:
            if fail_fast:
                raise
            if len(rows) > 1:
                return pd.concat([one(rows.iloc[i : i + 1]) for i in range(len(rows))])
            return pd.DataFrame({"key": rows["key"].tolist(), "title": [None], "summary": [None], "key_points": [None], "error": [f"{type(e).__name__}: {e}"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield one(b)

    return own.mapInPandas(run, RESULT)


def annotate_with_cache(df: DataFrame, cache: DataFrame, instruction: str, model: str, provider: Provider = offline) -> DataFrame:
    """RESULT and ``cached`` for rows of (content_id, text): the cache's entries, and new ones for what it lacks."""
    own = df.withColumn("key", cache_key(F.col("content_id").cast("string"), F.lit("analyze"), F.lit(instruction), F.lit(model)))
    hits = cache.join(own.select("key").distinct(), "key", "left_semi").withColumn("cached", F.lit(True))
    new = annotate(own.join(cache.select("key"), "key", "left_anti"), provider).withColumn("cached", F.lit(False))
    return hits.unionByName(new)
