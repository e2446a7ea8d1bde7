"""Top-k against all products."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk


def slow(rows, k):
    fine = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, i, q in fine:
        if i is not None and i % 50 == 0:
            score = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in fine if m != n)
            for rank, (s, null, j) in enumerate(score[:k], 1):
                out[i, rank, None if null else j, -s] += 1
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_topk(spark, monkeypatch, block):
    for name in ("BLOCK", "QUERIES", "HEAD", "STRIDE"):
        monkeypatch.setattr(topk, name, block)
    r = random.Random(block)
    rows = [(i, [r.gauss(0, 1) * (1 + (i % 9 == 0)) for _ in range(12)]) for i in range(400)]
    rows += [(500 + i, rows[50][1]) for i in range(12)] + [rows[100], rows[100]]
    rows += [(None, rows[50][1]), (450, None), (500, [1.0, None]), (550, [float("nan")] * 12), (600, [float("inf")] * 12), (650, []), (700, [1.0]), (750, [0.0] * 12), (800, [2.0] * 15)]
    df = spark.createDataFrame([(*x, "t") for x in rows], "vec_id long, embedding array<double>, tag string").repartition(5)
    got = topk.exact_topk(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == slow(rows, 5)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect())) == slow(rows, 5)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.exact_topk(df.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(1 << 40)) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = Counter()
    for (i, rank, j, s), n in slow(rows, 5).items():
        cut[i, rank, min(s, (1 << 63) - 1)] += n
    assert Counter((i, rank, s) for i, rank, _, s in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()) == cut


def test_products():
    rng = np.random.default_rng(0)
    for top in (1 << 8, 1 << 28, 1 << 40):
        a, b = rng.integers(-top, top, (9, 6)), rng.integers(-top, top, (8, 6))
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert topk.exact_products(a, b).tolist() == want
