"""Pruned keyword search and the blocked nearest join against slow versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, search


@pytest.fixture(scope="module")
def leg(spark, tmp_path_factory):
    r = random.Random(5)
    rare = [f"rare{i}" for i in range(40)]
    rows = []
    for i in range(3000):
        words = r.choices(["the", "of", "and", "to"], [8, 4, 2, 1], k=r.randrange(1, 60)) + r.choices([f"w{k}" for k in range(300)], k=r.randrange(20))
        if i % 11 == 0:
            words += r.choices(rare, k=r.randrange(1, 4))
        rows.append((i, " ".join(words) if i % 97 else None, r.choice("ab")))
    df = spark.createDataFrame(rows, "object_id long, text string, kind string")
    own = index.build(df, ("object_id",), "text", str(tmp_path_factory.mktemp("index")))
    return search.Leg("x", df, F.col("text"), index=own)


@pytest.mark.parametrize("query", ["the rare1", "the of and rare3 rare7", "of to", "rare1 rare2 rare3", "the the", "nothing here", "the w5 w6 w7", "and missing"])
@pytest.mark.parametrize("limit", [1, 10, 60])
def test_pruned_is_exact(leg, query, limit):
    for where in (None, F.col("kind") == "a") if limit == 10 else (None,):
        want = [tuple(x) for x in search.top(search.keyword(leg, query, where), limit).select("object_id", "score").collect()]
        got = [tuple(x) for x in search.top(search.keyword_top(leg, query, limit, where), limit).select("object_id", "score").collect()]
        assert got == want


def test_frequent_term_is_passed_over(leg):
    read = {}
    search.keyword_top(leg, "the rare1", 3, read=read).count()
    assert read["postings"] > 2500 and read["read"] < read["postings"] / 2  # blocks of 128 in a corpus of 24 blocks
    monkey = search.NEAR_BLOCKS
    try:
        search.NEAR_BLOCKS = 0  # blocks are joined
        want = sorted(map(tuple, search.top(search.keyword(leg, "the rare1"), 3).collect()))
        assert sorted(map(tuple, search.top(search.keyword_top(leg, "the rare1", 3), 3).collect())) == want
    finally:
        search.NEAR_BLOCKS = monkey


def test_tables_read_a_tenth(spark, tmp_path):
    """Of the frequent terms of a query over documents of which few have the rare ones, less than a tenth is read."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("object_id"), "text")
    own = index.build(docs, ("object_id",), "text", str(tmp_path))
    counts = own.blocks.groupBy("term").agg(F.sum("n").alias("n"))
    term = counts.filter("n BETWEEN 3 AND 6 AND term RLIKE '^[a-z]+$'").orderBy("term").first().term
    leg = search.Leg("d", docs, F.col("text"), index=own)
    read = {}
    got = search.top(search.keyword_top(leg, f"the {term}", 3, read=read), 3).collect()
    assert got == search.top(search.keyword(leg, f"the {term}"), 3).collect()
    assert read["read"] * 10 < read["postings"]


def test_mark_follows_files(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(5).write.parquet(at)
    before = index.mark(spark.read.parquet(at))
    assert index.mark(spark.read.parquet(at)) == before
    spark.range(5).write.mode("append").parquet(at)
    assert index.mark(spark.read.parquet(at)) != before


def slow_nearest(left, right, k):
    def unit(v, n):
        x = np.zeros(n) if v is None or len(v) != n else np.array(v, float)
        return x / np.linalg.norm(x) if x.any() else x

    out = set()
    for i, v in left:
        scored = sorted((-round(float(unit(v, 4) @ unit(w, 4)), 6) + 0.0, j) for j, w in right)
        out |= {(i, j, -s + 0.0, n) for n, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("block", [40, 2000, 32 << 20])
@pytest.mark.parametrize("n_left, n_right, k", [(40, 200, 5), (3, 2, 5), (1, 50, 1), (0, 5, 2), (5, 0, 2)])
def test_nearest_join(spark, monkeypatch, block, n_left, n_right, k):
    monkeypatch.setattr(search, "BLOCK", block)
    r = random.Random(block + n_left)
    some = lambda n: [(i, r.choice([None, [0.0] * 4, [1.0, 2.0]] + [[float(r.randrange(-3, 4)) for _ in range(4)] for _ in range(9)])) for i in range(n)]
    left, right = some(n_left), some(n_right)
    schema = "id long, vector array<double>"
    got = search.nearest_join(spark.createDataFrame(left, schema).repartition(2), spark.createDataFrame(right, schema).repartition(3), k)
    assert {tuple(x) for x in got.collect()} == slow_nearest(left, right, k)


def test_nearest_join_reads_each_side_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4000)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    plan = search.nearest_join(e.filter("label = 3"), e.filter("label <> 3"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Broadcast" not in plan and "Cartesian" not in plan
