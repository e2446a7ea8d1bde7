"""Operators over ordered rows: last-N, gaps, caps, neighbours, elision, grids.

Keyed forms partition by their key.  Forms that rank a whole table go through ``orderBy().limit()``, so no task ever gets
all rows of it; only tables of one object (a scene's words, a graph's nodes) use a window over a small partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, planned with a group limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows of an order: least-recently-used, first-in and oldest-out caps."""
    return df.orderBy(*order).limit(n)


def sessions(df: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """key, session (from 1), start, end, n: a gap of more than the TTL begins a new session."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)
    own = df.withColumn("__new", F.coalesce((gap > ttl_seconds * 1_000_000).cast("int"), F.lit(1)))
    own = own.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def latest(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key; partial maxima meet, not rows."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def context(df: DataFrame, key: str, order: str, word: str, n: int = 2) -> DataFrame:
    """``df`` with the words within n places of each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, n)
    return df.withColumn("context", F.array_join(F.collect_list(word).over(w), " "))


def elide(df: DataFrame, key: str, order: str, text: str, head: int = 20, tail: int = 10, most: int = 35) -> DataFrame:
    """All rows of a key with at most ``most``; else the first ``head``, a row that says how many are left out, and the last ``tail``.

    ``elided`` is that number, 0 for all other rows; the row has the order of the last one before it.
    """
    w = Window.partitionBy(key)
    own = df.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    left = F.col("__n") - head - tail
    own = own.filter((F.col("__n") <= most) | (F.col("__i") <= head) | (F.col("__i") > F.col("__n") - tail))
    marks = F.when((F.col("__n") > most) & (F.col("__i") == head), F.array(F.lit(0).cast("long"), left)).otherwise(F.array(F.lit(0).cast("long")))
    own = own.withColumn("elided", F.explode(marks))
    said = F.concat(F.lit("... ("), F.col("elided").cast("string"), F.lit(" more words) ..."))
    return own.withColumn(text, F.when(F.col("elided") > 0, said).otherwise(F.col(text))).drop("__i", "__n")


#: Words that mark a turn of a narration.
TRANSITIONS = ["but", "however", "the", "this", "that", "so", "now", "finally", "first", "second", "third", "next", "then"]


def key_phrases(df: DataFrame, key: str, order: str, word: str, most: int = 15, around: int = 2) -> DataFrame:
    """The first words of each key that are transitions or longer than six letters, with the words ``around`` them as context."""
    plain = F.rtrim(F.lower(F.col(word)), F.lit(",.!?"))
    own = context(df, key, order, word, around).filter(plain.isin(TRANSITIONS) | (F.length(plain) > 6))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return own.withColumn("place", rank).filter(F.col("place") <= most)


def grid(df: DataFrame, order: str, key: str | None = None) -> DataFrame:
    """``df`` with grid_x and grid_y: the nodes of a graph in rows of max(int(sqrt(n)), 1)."""
    w = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    i = F.row_number().over(w.orderBy(order)) - 1
    columns = F.greatest(F.floor(F.sqrt(F.count("*").over(w).cast("double"))).cast("int"), F.lit(1))
    return df.withColumn("__i", i).withColumn("__c", columns).withColumn("grid_x", (F.col("__i") % F.col("__c")).cast("int")).withColumn("grid_y", F.floor(F.col("__i") / F.col("__c")).cast("int")).drop("__i", "__c")


def grep(lines: DataFrame, key: str, number: str, text: str, pattern: str, around: int = 2) -> DataFrame:
    """Lines that match and those within ``around`` of one."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(-around, around)
    hit = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    return lines.withColumn("hit", hit).withColumn("__near", F.max(hit).over(w)).filter("__near").drop("__near")
