"""The cache registry over a stream and in batch against a plain loop."""

import random
from datetime import datetime, timedelta

from lodestone.operators.state import registry_events
from lodestone.streaming import machines as m
from lodestone.streaming import registry
from lodestone.streaming.registry import PROVIDER, registry_stream

SCHEMA = "k long, id long, ts timestamp, size double"


def requests(n=400):
    r, at = random.Random(3), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 30, 400]))
        out.append((1 if r.random() < 0.4 else r.randrange(2, 12), i, at, r.choice([None, float("nan"), 1.0]) if r.random() < 0.04 else 50.0))
    return out


def slow(rows, ttl, least, end):
    last, barred, out = {}, set(), []
    for k, i, ts, size in rows:
        if k in barred:
            out.append((k, i, "suppressed"))
            continue
        gone = k in last and (ts - last[k]).total_seconds() > ttl
        if gone:
            out.append((k, None, "expired"))
        if k in last and not gone:
            out.append((k, i, "hit"))
        elif size is None or not size >= least:
            out.append((k, i, "suppress"))
            barred.add(k)
            last.pop(k, None)
            continue
        else:
            out.append((k, i, "stale" if gone else "create"))
        last[k] = ts
    return out + [(k, None, "expired") for k, ts in last.items() if (end - ts).total_seconds() > ttl]


def test_batch_and_stream(spark, tmp_path):
    rows = requests()
    want = slow(rows, 600, 10, rows[-1][2] - timedelta(minutes=5))
    assert {a for _, _, a in want} == {"create", "hit", "stale", "suppress", "suppressed", "expired"}
    order = lambda got: sorted(got, key=str)
    df = spark.createDataFrame(rows, SCHEMA)
    batch = [tuple(r) for r in registry_events(df, ["k"], "ts", "id", "size", 600, 10).collect()]
    assert order(batch) == order(w for w in want if w[1] is not None)
    for i in range(0, len(rows), 100):
        spark.createDataFrame(rows[i : i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = registry_stream(m.read_events(spark, str(tmp_path / "in"), SCHEMA, 1), ["k"], "id", "size", 600, 10, "5 minutes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = m.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "c"), PROVIDER).select("k", "id", "action").collect()
    assert order(map(tuple, got)) == order(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_many_keys_in_few_buckets(spark, tmp_path, monkeypatch):
    r, at, rows = random.Random(8), datetime(2024, 1, 1), []
    for i in range(1500):
        at += timedelta(seconds=r.choice([0, 1, 5, 20]))
        rows.append((r.randrange(2**53, 2**53 + 300) if r.random() < 0.95 else None, r.choice("xy"), i, at, r.choice([None, 1.0]) if r.random() < 0.02 else 50.0))
    want = [(*k, i, action) for k, i, action in slow([((k, kind), i, ts, size) for k, kind, i, ts, size in rows], 600, 10, at - timedelta(minutes=5))]
    schema = "k long, kind string, id long, ts timestamp, size double"
    for i in range(0, len(rows), 300):
        spark.createDataFrame(rows[i : i + 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(registry, "BUCKETS", 5)
    stream = registry_stream(m.read_events(spark, str(tmp_path / "in"), schema, 1), ["k", "kind"], "id", "size", 600, 10, "5 minutes")
    got = m.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "c"), PROVIDER).select("k", "kind", "id", "action").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({k[:2] for k in want}) > 500
    assert spark.read.format("statestore").load(str(tmp_path / "c")).count() <= 5  # one state for each bucket, not for each key
