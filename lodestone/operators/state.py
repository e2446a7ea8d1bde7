"""State machines over event logs, in batch form.  Every clock is a column or the log's own latest time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def launch_window(df: DataFrame, ts: str, tie: str, ttl_seconds: int, most: int) -> DataFrame:
    """Launches within the TTL of the last one, the newest ``most`` of them."""
    now = df.agg(F.max(ts).alias("__now"))
    own = df.crossJoin(F.broadcast(now)).filter(F.unix_micros("__now") - F.unix_micros(ts) <= ttl_seconds * 1_000_000).drop("__now")
    return own.orderBy(F.desc(ts), F.desc(tie)).limit(most)


def accept(times, window: int):
    """Which of sorted times are accepted, if each bars others for ``window`` after it."""
    last, out = None, []
    for t in times:
        free = last is None or t - last >= window
        if free:
            last = t
        out.append(free)
    return out


def single_active(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """key, tie, accepted.  Whether a launch is accepted depends on those accepted before, so a key is a sequential fold.

    Rows come sorted from the shuffle and pass through in batches; the only state is a key and its last accepted time.
    """
    kind = dict(df.dtypes)
    own = df.select(key, tie, F.unix_micros(ts).alias("__us")).repartition(key).sortWithinPartitions(key, "__us", tie)

    def run(batches):
        now, last = object(), None
        for b in batches:
            out = []
            for k, us in zip(b[key], b["__us"]):
                if k != now:
                    now, last = k, None
                free = last is None or us - last >= seconds * 1_000_000
                last = us if free else last
                out.append(free)
            yield pd.DataFrame({key: b[key], tie: b[tie], "accepted": out})

    return own.mapInPandas(run, f"{key} {kind[key]}, {tie} {kind[tie]}, accepted boolean")


def lifecycle(df: DataFrame, key: str, status: str, ts: str, tie: str, launch: str, terminal: list[str]) -> DataFrame:
    """key, status, seconds of the first terminal event of each key."""
    s = F.col(status)
    ends = F.when(s.isin(terminal), F.struct(ts, tie))
    own = df.groupBy(key).agg(F.min_by(F.when(s.isin(terminal), s), ends).alias("status"), F.min(F.when(s.isin(terminal), F.col(ts))).alias("__e"), F.min(F.when(s == launch, F.col(ts))).alias("__l"))
    return own.filter("status IS NOT NULL").select(key, "status", (F.unix_seconds("__e") - F.unix_seconds("__l")).alias("seconds"))


def registry_actions(df: DataFrame, key: list[str], ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """key, action, n: create, hit or stale by the time since the key's last use, which refreshes it."""
    before = F.lag(F.unix_micros(ts)).over(Window.partitionBy(*key).orderBy(ts, tie))
    own = df.withColumn("__b", before)
    action = F.when(F.col("__b").isNull(), "create").when(F.unix_micros(ts) - F.col("__b") > ttl_seconds * 1_000_000, "stale").otherwise("hit")
    return own.groupBy(*key, action.alias("action")).agg(F.count("*").alias("n"))


def registry_events(df: DataFrame, key: list[str], ts: str, tie: str, size: str, ttl_seconds: int, least: float) -> DataFrame:
    """key, tie, action of a cache registry for each request.

    create: the key had no entry; hit: it had one that was used within the TTL, which each use begins anew; stale: it had one
    that was older, in whose place a new one was made; suppress: an entry was due, but ``size`` is below ``least``, and from then on all requests of the
    key are suppressed.  A size that is null or no number is too small.
    """
    order = Window.partitionBy(*key).orderBy(ts, tie)
    us = F.unix_micros(ts)
    gap = us - F.lag(us).over(order)
    due = gap.isNull() | (gap > ttl_seconds * 1_000_000)
    small = F.coalesce((F.col(size) < least) | F.isnan(F.col(size).cast("double")), F.lit(True))
    own = df.select(*key, tie, ts, gap.alias("__gap"), due.alias("__due"), (due & small).alias("__no"))
    barred = F.coalesce(F.max("__no").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    action = F.when(barred, "suppressed").when(F.col("__no"), "suppress").when(F.col("__gap").isNull(), "create").when(F.col("__due"), "stale").otherwise("hit")
    return own.select(*key, tie, action.alias("action"))
