"""The state machines as Structured Streaming queries.

Times are cast to TIMESTAMP (watermarks reject TIMESTAMP_NTZ).  Each form gives the rows of its batch counterpart once
its input has ended; session windows that are still open at the last watermark are not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.state import accept


def write_slices(df: DataFrame, order: str, folder: str, slices: int = 3, files: int = 4) -> None:
    """Rows as a log that comes in slices of ``order``, one after another, each of at most ``files`` files."""
    edges = df.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)]).alias("e")).first().e or []
    place = sum(((F.col(order) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    for i in range(len(edges) + 1):
        df.filter(place == i).repartition(files).write.mode("append").parquet(folder)


def read_events(spark: SparkSession, folder: str, schema: str, files_each: int = 4) -> DataFrame:
    """Parquet files of a folder, the oldest first, as a stream with a time that watermarks accept."""
    own = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)
    return own.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n; a day is final once the watermark has passed it."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("day"), "event_type", "n")


def latest_status(events: DataFrame, key: str = "user_id", status: str = "event_type") -> DataFrame:
    """key, status: the last event of each key; use update or complete mode."""
    return events.groupBy(key).agg(F.max_by(status, F.struct("ts", "event_id")).alias(status))


def single_flight(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of equal requests within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of sessions that have been closed by the watermark."""
    own = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return own.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def single_active(events: DataFrame, key: str = "user_id", seconds: int = 1800) -> DataFrame:
    """key, event_id, accepted: the guard with the last accepted time of a key as its state.

    Events of a key are taken in time order within a micro-batch; one that comes after a later one was accepted is judged
    against that one.  State goes once the watermark is a day past a key's last accepted event.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(frames)).sort_values(["us", "event_id"])
        times = own["us"].tolist()
        if state.exists:
            out = accept([state.get[0], *times], seconds * 1_000_000)[1:]
            last = max([state.get[0], *(t for t, a in zip(times, out) if a)])
        else:
            out = accept(times, seconds * 1_000_000)
            last = max(t for t, a in zip(times, out) if a)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({key: [k[0]] * len(own), "event_id": own["event_id"].tolist(), "accepted": out})

    own = events.withWatermark("ts", "1 day").select(key, "event_id", "ts", F.unix_micros("ts").alias("us"))
    return own.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def lifecycles(events: DataFrame, launch: str, terminal: dict[str, str], within: str = "6 hours", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """key, launch_id, status, terminal_id, seconds: launches joined with the terminal events of their key that follow within an interval.

    ``terminal`` maps event types to states (completed, failed, cancelled).  Both sides carry the watermark, so that a launch is
    forgotten, and handed out without a state if it has met none, once no terminal event within its interval can come any more.
    """
    marked = events.withWatermark("ts", late)
    names = F.create_map(*(F.lit(x) for pair in terminal.items() for x in pair))
    begun = marked.filter(F.col("event_type") == launch).select(key, F.col("event_id").alias("launch_id"), F.col("ts").alias("launched"))
    ended = marked.filter(F.col("event_type").isin(list(terminal))).select(F.col(key).alias("of"), F.col("event_id").alias("terminal_id"), names[F.col("event_type")].alias("status"), F.col("ts").alias("ended"))
    met = F.expr(f"of = {key} AND ended >= launched AND ended <= launched + INTERVAL {within}")
    seconds = F.floor((F.unix_micros("ended") - F.unix_micros("launched")) / 1_000_000)
    return begun.join(ended, met, "left_outer").select(key, "launch_id", "status", "terminal_id", seconds.alias("seconds"))


def last_turns(turns: DataFrame, keep: int, key: str = "conv_id", ttl: str | None = "7 days") -> DataFrame:
    """key, turn_count, history: the last ``keep`` texts of each session, and how many there have been.

    Turns of a session that come in one micro-batch are taken in their order.  A session that gets none for ``ttl`` is
    forgotten.  That clock never stops, so a run over what there is, which should end, takes None.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, kept = state.get if state.exists else (0, [])
        own = sorted((turn, text) for f in frames for turn, text in zip(f["turn"], f["text"]))
        n, kept = n + len(own), [*kept, *(text for _, text in own)][-keep:]
        state.update((n, kept))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], "turn_count": [n], "history": [kept]})

    return turns.select(key, "turn", "text").groupBy(key).applyInPandasWithState(step, f"{key} long, turn_count long, history array<string>", "n long, kept array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def run_to_parquet(stream: DataFrame, folder: str, checkpoint: str, provider: str | None = None) -> DataFrame:
    """Run over what there is into Parquet, exactly once by the sink's log; ``provider`` is the class of the state store, if not the session's."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if provider:
        conf.set(name, provider)
    try:
        own = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    own.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def run_updates(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run over what there is in update mode; the last row of each key.

    Each micro-batch writes the rows it has changed to a folder named by its number, so one that is tried again replaces
    what it has written before.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
