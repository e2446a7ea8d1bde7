"""A cache registry over a stream of requests, with timers that end entries when nobody has used them for the TTL.

The state of a key is its last use and whether it is suppressed; once the watermark has passed its last use by the TTL, the entry
ends.  A suppressed key stays: it must be told from a new one for as long as the stream runs.

Keys are dealt into buckets by their hash, and a bucket is what Spark groups by: it has the states of all its keys as one value and one timer
in event time, that of the entry which ends first.  So a micro-batch costs a call for each bucket, not one for each key, which took nearly all of the
time.  A bucket's rows of a micro-batch and its keys' states are in memory together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.runtime import ship

#: The state store: on disk, as suppressed keys stay.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of keys; another number needs another checkpoint.
BUCKETS = 512
#: Types of keys that travel as texts: pandas has no null in numbers.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


Entries = dict[tuple, tuple]  # (last use in microseconds, live, suppressed) of each key


def _loaded(table: bytes) -> Entries:
    columns = [c.to_pylist() for c in pa.ipc.open_stream(table).read_all().columns]
    return dict(zip(zip(*columns[:-3]), zip(*columns[-3:])))


def _dumped(entries: Entries, names: list[str]) -> bytes:
    states = (pa.array(c, t) for c, t in zip(zip(*entries.values()), (pa.int64(), pa.bool_(), pa.bool_())))
    table = pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*entries)), *states], [*names, "last_us", "live", "suppressed"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def _requested(entries: Entries, requests: Iterator[tuple], ttl: int, least: float) -> Iterator[tuple]:
    """key, tie, action, us of requests (key, us, tie, size) in their order; entries become what they are after them."""
    for k, us, tie, size in requests:
        last, live, suppressed = entries.get(k, (None, False, False))
        if suppressed:
            yield k, tie, "suppressed", us
            continue
        if live and us - last > ttl:
            yield k, None, "expired", last + ttl
            live = False
        if live:
            yield k, tie, "hit", us
        elif not size >= least:  # NaN and None as well
            yield k, tie, "suppress", us
            entries[k] = (last, False, True)
            continue
        else:
            yield k, tie, "create" if last is None else "stale", us
        entries[k] = (us if last is None else max(us, last), True, False)


def _ended(entries: Entries, watermark: int, ttl: int) -> Iterator[tuple]:
    """key, null, expired, us of entries that are older than the TTL at the watermark (milliseconds)."""
    for k, (last, live, suppressed) in entries.items():
        if live and _due(last, ttl) <= watermark:
            yield k, None, "expired", last + ttl
            entries[k] = (last, False, suppressed)


def _due(us: int, ttl: int) -> int:
    """The first millisecond at which an entry that was used then is older than the TTL."""
    return (us + ttl) // 1000 + 1


def registry_stream(events: DataFrame, key: list[str], tie: str, size: str, ttl_seconds: int, least: float, late: str = "1 hour") -> DataFrame:
    """key, tie, action, us: what the registry does with each request, and when an entry ends (tie null).

    Run it in append mode with ``PROVIDER`` as the state store.  Requests of a key that come in one micro-batch are taken in their order;
    one that comes after a later one was taken counts as used then, so it is a hit unless the entry had ended.
    """
    ship(events.sparkSession)
    kinds, ttl = dict(events.dtypes), ttl_seconds * 1_000_000
    texts = {k: "string" if kinds[k] in NUMBERS else kinds[k] for k in key}
    names = [f"key{i}" for i in range(len(key))]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, out = _loaded(state.get[0]) if state.exists else {}, []
        if not state.hasTimedOut:
            own = pd.concat(list(frames)).sort_values(["us", "tie"])
            keys = zip(*(own[n].tolist() for n in names))
            out += _requested(entries, zip(keys, *(own[c].tolist() for c in ("us", "tie", "size"))), ttl, least)
        out += _ended(entries, state.getCurrentWatermarkMs(), ttl)
        state.update((_dumped(entries, names),))
        if live := [last for last, live, _ in entries.values() if live]:
            state.setTimeoutTimestamp(max(1, _due(min(live), ttl) - 1))  # it is called once the watermark is past that
        if out:
            keys, ties, actions, us = zip(*out)
            told = [*zip(names, zip(*keys)), ("tie", ties), ("action", actions), ("us", us)]
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in told})

    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")
    keys = [F.col(k).cast(texts[k]).alias(n) for k, n in zip(key, names)]
    own = events.withWatermark("ts", late).select(bucket, *keys, F.col(tie).alias("tie"), F.unix_micros("ts").alias("us"), F.col(size).cast("double").alias("size"), "ts")
    schema = ", ".join([*(f"{n} {texts[k]}" for k, n in zip(key, names)), "tie long", "action string", "us long"])
    told = own.groupBy("bucket").applyInPandasWithState(step, schema, "entries binary", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(*(F.col(n).cast(kinds[k]).alias(k) for k, n in zip(key, names)), F.col("tie").alias(tie), "action", "us")
