"""Bucketed upserts, pointer doubling and the stream-stream lifecycle on small cases."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from lodestone.operators import joins
from lodestone.operators.buckets import BucketedTable
from lodestone.streaming import machines

SCHEMA = T.StructType().add("object_id", "string").add("bucket", "integer").add("note", "string")


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(df):
    return {r.object_id: (r.bucket, r.note) for r in df.collect()}


def test_untouched_buckets_stay(spark, tmp_path):
    """Against a dictionary; a column is named as the folders would be."""
    t = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "object_id", 16)
    assert t.read().count() == 0 and t.upsert(spark.createDataFrame([], SCHEMA)) == []
    have = {f"k{i}": (i, "a") for i in range(200)} | {None: (0, "null id")}
    t.upsert(spark.createDataFrame([(k, *v) for k, v in have.items()], SCHEMA))
    assert rows(t.read()) == have
    before = files(t.path)
    new = {"k1": (1, "b"), "k2": (2, "b"), "new": (3, None)}
    touched = t.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()] + [("k1", 1, "a")], SCHEMA))
    have |= new
    assert rows(t.read()) == have and 0 < len(touched) <= 3
    after = files(t.path)
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert changed == {f"bucket_={b}" for b in touched}
    assert all(after[p] == before[p] for p in before.keys() & after.keys())
    again = t.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA))
    assert again == touched and rows(t.read()) == have
    assert rows(t.fetch("k2")) == {"k2": (2, "b")} and rows(t.fetch(None)) == {None: (0, "null id")} and t.fetch("no").count() == 0
    plan = t.fetch("k2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket_" in plan.split("PartitionFilters")[1]


def test_bucket_that_ends_empty(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "object_id", 4)
    t.upsert(spark.createDataFrame([(f"k{i}", i, "") for i in range(9)], SCHEMA))
    t.delete(spark.createDataFrame([(f"k{i}",) for i in range(1, 9)] + [("none",), ("k3",)], "object_id string"))
    assert rows(t.read()) == {"k0": (0, "")}
    t.delete(t.read())
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("k5", 5, "x"), ("k5", 6, "y")], SCHEMA), ["note"])
    assert rows(t.read()) == {"k5": (6, "y")}


def slow_closure(links):
    out, known = set(), dict(links)
    for i, to in links:
        hops, at, seen = 0, i, set()
        while known.get(at) is not None and at not in seen:
            seen.add(at)
            hops, at = hops + 1, known[at]
        out.add((i, None, None, True) if at in seen else (i, at, hops, False))
    return out


def test_long_chain(spark, monkeypatch):
    rounds = []
    keep = joins.Scratch.keep
    monkeypatch.setattr(joins.Scratch, "keep", lambda self, df, name, **k: rounds.append(name) or keep(self, df, name, **k))
    links = [(i, i + 1) for i in range(1000)] + [(1000, None)]
    got = joins.chain_ends(spark.createDataFrame(links, "id long, next long"))
    assert {tuple(r) for r in got.collect()} == {(i, 1000, 1000 - i, False) for i in range(1001)}
    assert len(rounds) - 1 <= 11


@pytest.mark.parametrize("seed", range(3))
def test_closure(spark, seed):
    r = random.Random(seed)
    links = [(i, r.choice([None, 99, *range(40)])) for i in range(40)]
    got = joins.chain_ends(spark.createDataFrame(links, "id long, next long"))
    assert {tuple(x) for x in got.collect()} == slow_closure(links)
    assert joins.chain_ends(spark.createDataFrame([], "id long, next long")).count() == 0


def test_lifecycle(spark, tmp_path):
    """Two terminal events, one that comes too late, a cancelled one, a launch that is forgotten and one that may still end."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    log = [(1, at(0), 7, "go"), (2, at(1), 7, "done"), (3, at(2), 7, "stop"), (4, at(9), 7, "done"), (5, at(0), 8, "go"), (6, at(3), 9, "go"), (7, at(3.5), 9, "stop"), (8, at(30), 9, "go")]
    df = spark.createDataFrame(log, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    machines.write_slices(df, "ts", f"{tmp_path}/in", 3, 1)
    stream = machines.read_events(spark, f"{tmp_path}/in", df.schema.simpleString()[7:-1].replace(":", " "), 1)
    got = machines.run_to_parquet(machines.lifecycles(stream, "go", {"done": "completed", "stop": "cancelled"}), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(7, 1, "completed", 2, 3600), (7, 1, "cancelled", 3, 7200), (8, 5, None, None, None), (9, 6, "cancelled", 7, 1800)], key=str)
