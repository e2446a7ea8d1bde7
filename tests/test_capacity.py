"""The cap over a stream against a plain least-recently-used cache."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import capacity as c

SCHEMA = "key long, order_us long, tie long"


def slow(uses, most, held=()):
    held, gone = OrderedDict((k, (u, t)) for k, u, t in held), []
    for key, us, tie in uses:
        if key in held:
            held.move_to_end(key)
        elif len(held) >= most:
            old, last = held.popitem(last=False)
            gone.append((key, us, tie, old, *last))
        held[key] = (us, tie)
    return gone, [(k, *v) for k, v in held.items()]


def uses(seed, n, keys, at=0):
    r = random.Random(seed)
    hot = [(1 if r.random() < 0.3 else r.randrange(keys), at + r.randrange(n // 2 + 1), i) for i in range(n)]
    return sorted(hot, key=lambda x: (x[1], x[2], x[0]))


@pytest.mark.parametrize("most", [1, 3, 20, 500])
@pytest.mark.parametrize("stretches", [1, 2, 13])
def test_evictions(spark, tmp_path, most, stretches):
    rows, held = uses(most, 900, 60), [(1000 + i, -5, i) for i in range(min(most, 4))]
    mixed = rows[:]
    random.Random(0).shuffle(mixed)
    table = c.write_stretches(spark.createDataFrame([*mixed, (None, 1, 1)], SCHEMA), str(tmp_path / "t"), stretches)
    gone, after = c.evictions(table, held, most, stretches)
    want, state = slow(rows, most, held)
    assert sorted(map(tuple, gone.collect())) == sorted(want) and after == state


def test_one_time_only(spark, tmp_path):
    """All uses at one time, and a use that is repeated."""
    rows = sorted([(i % 7, 5, i) for i in range(100)] + [(3, 5, 50)], key=lambda x: (x[1], x[2], x[0]))
    table = c.write_stretches(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), 5)
    gone, after = c.evictions(table, [], 4, 5)
    want, state = slow(rows, 4)
    assert sorted(map(tuple, gone.collect())) == sorted(want) and after == state


def test_stream_and_retry(spark, tmp_path):
    parts = [uses(1, 200, 30), uses(2, 150, 30, 1000), uses(3, 100, 30, 2000)]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    got = c.run_capped(stream, 6, out, str(tmp_path / "c"))
    want, state = slow([u for p in parts for u in p], 6)
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(want)
    assert {r.batch for r in got.select("batch").distinct().collect()} <= {0, 1, 2}
    assert c._state(spark, out, 2) == state
    # the last micro-batch once more from the state of the one before
    table = spark.read.parquet(f"{out}/rows/batch=2")
    again, after = c.evictions(table, c._state(spark, out, 1), 6, 4)
    assert after == state
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.filter("batch = 2").drop("batch").collect()))


def test_nothing_comes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert c.run_capped(stream, 6, str(tmp_path / "out"), str(tmp_path / "c")).filter(F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        c.run_capped(stream, 0, str(tmp_path / "out"), str(tmp_path / "c2"))
