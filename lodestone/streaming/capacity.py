"""A global least-recently-used cap over a stream: one key goes for each new one over the capacity, in event order.

A cap is one state for all keys, yet no task sees all rows.  What a stretch of the log does to the state is told by its last
``capacity`` distinct keys, each at its last use: the state after it is these, and before them what the state had of others,
cut to the capacity.  So each micro-batch is dealt into stretches of its order, each task sums its own up, and the sums,
capacity rows for each stretch, are put one behind the other to find the state that each stretch begins with.  A second
pass replays all stretches at once and hands out what they evict.

The state (a row for each held key) and the evictions of a micro-batch are folders named by its number.  A micro-batch that is tried
again reads the state that the one before it left and replaces its own folders, so its result is the same.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.runtime import ship, shuffle_partitions

NAMES = ("key", "order_us", "tie")
STATE = "key long, order_us long, tie long, place long"


def _use(held: OrderedDict, key, at, capacity: int):
    """Use ``key``, the newest; the key that goes for it (a list of one or none)."""
    if key in held:
        held.move_to_end(key)
        held[key] = at
        return []
    gone = [held.popitem(last=False)] if len(held) >= capacity else []
    held[key] = at
    return gone


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns))


def _summary(capacity: int, names: list[str]):
    """The last ``capacity`` distinct keys of each stretch, the oldest first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stretch = OrderedDict(), None

        def told():
            rows = [(stretch, key, us, tie, i) for i, (key, (us, tie)) in enumerate(held.items())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

        for b in batches:
            for own, key, us, tie in _columns(b):
                if own != stretch:
                    if held:
                        yield told()
                    held, stretch = OrderedDict(), own
                held[key] = (us, tie)
                held.move_to_end(key)
                if len(held) > capacity:
                    held.popitem(last=False)
        if held:
            yield told()

    return run


def _replay(begins: dict[int, list[tuple]], capacity: int, names: list[str]):
    """What each stretch evicts, begun with the state that it is told."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stretch = OrderedDict(), None
        for b in batches:
            out = []
            for own, key, us, tie in _columns(b):
                if own != stretch:
                    held, stretch = OrderedDict((k, (u, t)) for k, u, t in begins[own]), own
                out += [(key, us, tie, k, u, t) for k, (u, t) in _use(held, key, (us, tie), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names)

    return run


def write_stretches(rows: DataFrame, path: str, stretches: int) -> DataFrame:
    """Uses (key, order_us, tie) with the number of their stretch, a range of (order_us, tie, key) of about equal rows however the times lie.

    The numbers are written, as ranges are drawn from samples, which another run of the plan would draw anew.
    """
    own = rows.select(*(F.col(c).cast("long").alias(c) for c in NAMES)).filter("key IS NOT NULL").repartitionByRange(stretches, "order_us", "tie", "key")
    own.select(F.spark_partition_id().cast("long").alias("stretch"), *NAMES).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def evictions(rows: DataFrame, before: list[tuple], capacity: int, stretches: int) -> tuple[DataFrame, list[tuple]]:
    """(evictions, state after) of ``rows``, a table of stretches that come after the state ``before`` (key, order_us, tie; the oldest first).

    Evictions: key, order_us, tie of the use that came; evicted, last_us, last_tie of the key that went for it.
    """
    ship(rows.sparkSession)
    own = rows.repartitionById(stretches, F.pmod(F.col("stretch"), F.lit(stretches)).cast("int")).sortWithinPartitions("stretch", "order_us", "tie", "key").select("stretch", *NAMES)
    sums_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("stretch", *NAMES, "place")])
    sums = own.mapInArrow(_summary(capacity, sums_schema.names), sums_schema).collect()  # stretches * capacity rows at most
    by: dict[int, list] = {}
    for r in sorted(sums, key=lambda r: (r.stretch, r.place)):
        by.setdefault(r.stretch, []).append((r.key, r.order_us, r.tie))
    begins, now = {}, OrderedDict((k, (u, t)) for k, u, t in before)
    for stretch, told in by.items():
        begins[stretch] = [(k, u, t) for k, (u, t) in now.items()]
        for k, u, t in told:
            now.pop(k, None)
            now[k] = (u, t)
        while len(now) > capacity:
            now.popitem(last=False)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*NAMES, "evicted", "last_us", "last_tie")])
    return own.mapInArrow(_replay(begins, capacity, schema.names), schema), [(k, u, t) for k, (u, t) in now.items()]


def _state(spark: SparkSession, folder: str, batch: int) -> list[tuple]:
    if batch < 0:
        return []
    rows = spark.read.schema(STATE).parquet(f"{folder}/state/batch={batch}").orderBy("place").collect()  # capacity rows
    return [(r.key, r.order_us, r.tie) for r in rows]


def run_capped(stream: DataFrame, capacity: int, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream of uses (key, order_us, tie) over what there is; all evictions so far, with the number of their micro-batch.

    Within a micro-batch uses are taken in the order of (order_us, tie, key); a micro-batch comes after those before it, so what is late is used
    when it comes.  Uses without a key count for nothing.
    """
    if capacity < 1:
        raise ValueError("the capacity is 1 at least")
    spark = stream.sparkSession

    def step(rows: DataFrame, batch: int) -> None:
        s = rows.sparkSession
        uses = write_stretches(rows, f"{folder}/rows/batch={batch}", shuffle_partitions(s))
        gone, after = evictions(uses, _state(s, folder, batch - 1), capacity, shuffle_partitions(s))
        gone.write.mode("overwrite").parquet(f"{folder}/evictions/batch={batch}")
        s.createDataFrame([(*r, i) for i, r in enumerate(after)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    schema = "key long, order_us long, tie long, evicted long, last_us long, last_tie long, batch int"
    return spark.read.schema(schema).option("basePath", f"{folder}/evictions").parquet(f"{folder}/evictions/batch=*")
