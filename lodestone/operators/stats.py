"""Counts and tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """collection, n for each table, and the grand total as '(total)'; one pass over each."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(c).alias("collection"), "n") for c, df in tables.items()]
    each = reduce(DataFrame.unionByName, rows)
    return each.unionByName(each.agg(F.sum("n").alias("n")).select(F.lit("(total)").alias("collection"), "n"))


def grouped(df: DataFrame, by: str) -> DataFrame:
    """value, n; null is '(empty)'.  A property that the table doesn't have gives no row."""
    if by not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, n long")
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(empty)")).alias("value")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """value, n for all ``values``, zero where there is none."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return dim.join(grouped(df, by), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def tally(df: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """One row with a count for each condition."""
    return df.agg(*(F.count_if(c).alias(k) for k, c in cases.items()))


def storage(df: DataFrame, size: str) -> DataFrame:
    """files, total_mb (two digits)."""
    return df.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum(size), F.lit(0)) / 1048576.0, 2).alias("total_mb"))


def opinions(df: DataFrame, key: str, sentiment: str, theme: str, likes: str, text: str, most: int = 3) -> DataFrame:
    """key, comments, percentages of positive, negative and neutral ones (one digit), and the most liked theme and text of the first two.

    Themes are added up before they are ranked, so a theme with many comments costs one row a task.
    """
    share = lambda s: F.round(F.count_if(F.col(sentiment) == s) * 100 / F.count("*"), 1)
    shares = df.groupBy(key).agg(F.count("*").alias("comments"), *(share(s).alias(s) for s in ("positive", "negative", "neutral")))
    best = F.max(F.struct(F.col(likes).alias("l"), F.col(text).alias("t")))
    themes = df.filter(F.col(sentiment) != "neutral").groupBy(key, sentiment, theme).agg(best.alias("b"), F.count("*").alias("n"))
    order = F.struct((-F.col("b.l")).alias("a"), (-F.col("n")).alias("n"), F.col(theme).alias("theme"), F.col("b.t").alias("quote"))
    ranked = themes.groupBy(key).pivot(sentiment, ["positive", "negative"]).agg(F.slice(F.array_sort(F.collect_list(order)), 1, most))
    named = lambda s: F.coalesce(F.transform(s, lambda x: F.concat(x["theme"], F.lit(": "), x["quote"])), F.array().cast("array<string>"))
    return shares.join(ranked.select(key, named("positive").alias("supportive"), named("negative").alias("critical")), key, "left").na.fill(0)
