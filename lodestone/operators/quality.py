"""Gates over extracted results: time order, coverage, lengths, edges, links, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import is_timecode, link_path, markdown_links, resolve, timecode_seconds


def timestamp_issues(df: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """key, order, issue: 'invalid format', or 'out of order' where a time is before the last valid one."""
    own = df.select(key, order, time, is_timecode(F.col(time)).alias("__ok"))
    good = own.filter("__ok").withColumn("__s", timecode_seconds(F.col(time)))
    before = F.lag("__s").over(Window.partitionBy(key).orderBy(order))
    late = good.withColumn("__b", before).filter("__s < __b").select(key, order, F.lit("out of order").alias("issue"))
    return own.filter("NOT __ok").select(key, order, F.lit("invalid format").alias("issue")).unionByName(late)


def coverage(df: DataFrame, key: str, time: str, duration: str) -> DataFrame:
    """key, coverage: the last time over the duration, at most 1; without a duration 1.  Whole numbers between colons are a time, however many."""
    own = df.groupBy(key).agg(F.max(timecode_seconds(F.col(time))).alias("__l"), F.max(duration).alias("__d"))
    ratio = F.least(F.greatest(F.coalesce("__l", F.lit(0)), F.lit(0)) / F.col("__d"), F.lit(1.0))
    return own.select(key, F.when(F.coalesce("__d", F.lit(0)) <= 0, 1.0).otherwise(ratio).alias("coverage"))


def coverage_issue(last: Column, duration: Column, n: Column, least: float = 0.9) -> Column:
    """True where times don't reach far enough; unknown durations and empty lists are passed over."""
    return (duration > 0) & (n > 0) & (F.coalesce(last, F.lit(0)) / duration < least)


def short_items(df: DataFrame, key: str, items: str, least: int = 20) -> DataFrame:
    """key, n (from 0), length: items of an array that are too short when trimmed."""
    own = df.select(key, F.posexplode(items).alias("n", "item"))
    return own.select(key, "n", F.length(F.trim("item")).alias("length")).filter(F.col("length") < least)


def report(issues: DataFrame, key: str, check: str, issue: str, checks: list[str], keys: DataFrame) -> DataFrame:
    """key, check, passed, message: every check of every key; messages joined by '; ' in their order."""
    dim = keys.select(key).crossJoin(F.broadcast(keys.sparkSession.createDataFrame([(c,) for c in checks], f"{check} string")))  # a handful of checks
    own = issues.groupBy(key, check).agg(F.array_join(F.array_sort(F.collect_list(issue)), "; ").alias("message"))
    return dim.join(own, [key, check], "left").select(key, check, F.col("message").isNull().alias("passed"), F.coalesce("message", F.lit("")).alias("message"))


def verdict(checks: DataFrame, key: str) -> DataFrame:
    return checks.groupBy(key).agg(F.when(F.bool_and("passed"), "pass").otherwise("fail").alias("status"), F.count_if(~F.col("passed")).alias("failed"))


def link_issues(pages: DataFrame, files: DataFrame) -> DataFrame:
    """root, name, link, issue: links of markdown pages (root, name, content) that leave their root folder, or lead to no file (path)."""
    links = pages.select("root", "name", F.explode(markdown_links(F.col("content"))).alias("link"))
    links = links.withColumn("path", resolve(F.col("root"), link_path(F.col("link"))))
    inside = (F.col("path") == F.col("root")) | F.col("path").startswith(F.concat("root", F.lit("/")))
    known = files.select("path").distinct().withColumn("__there", F.lit(True))
    own = links.join(known, "path", "left").withColumn("issue", F.when(~inside, "escapes").when(F.col("__there").isNull(), "broken"))
    return own.filter("issue IS NOT NULL").select("root", "name", "link", "issue")
