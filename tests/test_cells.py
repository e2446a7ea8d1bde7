"""The stored vector index against a full scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, search

SCHEMA = "object_id long, kind string, vector array<double>, cell string, far int, k0 int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 12))
    v = centres[r.integers(0, 30, 4000)] + 0.2 * r.normal(size=(4000, 12))
    v[100:110] = v[100]  # ties
    out = [(i, "ab"[i % 2], [float(x) for x in own], "x", 1, 2) for i, own in enumerate(v)]
    odd = [None, [], [0.0] * 12, [1.0, 2.0], [math.nan] * 12, [math.inf] + [0.0] * 11, [None] + [1.0] * 11, [1e200] * 12, [1e-200] * 12]
    return out + [(5000 + i, "a", x, "x", 1, 2) for i, x in enumerate(odd)]


@pytest.fixture(scope="module")
def leg(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, SCHEMA)
    own = cells.build(df, ("object_id",), "vector", str(tmp_path_factory.mktemp("cells")), each=40)
    return search.Leg("x", df, F.lit(""), "vector", cells=own)


def plain(df):
    return [(r.object_id, repr(r.score)) for r in df.select("object_id", "score").collect()]


def both(spark, leg, q, limit, where=None):
    vector = spark.createDataFrame([(q,)], "q array<double>")
    read = {}
    want = plain(search.top(search.semantic(leg, vector, where), limit))
    return want, plain(search.top(search.semantic_top(leg, vector, limit, where, read), limit)), read


@pytest.mark.parametrize("limit", [1, 10, 300])
def test_equals_full_scan(spark, leg, rows, limit):
    r = np.random.default_rng(limit)
    for q in (rows[105][2], rows[2000][2], [float(x) for x in r.normal(size=12)], [-x for x in rows[7][2]]):
        want, got, _ = both(spark, leg, q, limit)
        assert got == want
    want, got, _ = both(spark, leg, rows[2000][2], limit, F.col("kind") == "b")
    assert got == want


@pytest.mark.parametrize("q", [[0.0] * 12, [1.0, 2.0], [], [None] + [1.0] * 11, None])
def test_queries_without_direction(spark, leg, q):
    want, got, _ = both(spark, leg, q, 5)
    assert got == want


def test_far_cells_are_passed_over(spark, leg, rows):
    _, _, read = both(spark, leg, rows[2000][2], 5)
    assert read["rows"] == 4008 and read["read_rows"] < read["rows"] / 4 and read["read_cells"] < read["cells"]


def test_every_row_is_in_a_cell(leg):
    own = {r.object_id: r.cell for r in leg.cells.rows.collect()}
    assert len(own) == 4008 and 5000 not in own
    assert all((own[i] < 0) == (i > 4000) for i in own)  # 1e200 and 1e-200 have no length in doubles


def test_related(spark, leg):
    want = plain(search.related(leg.df, "105", 8))
    assert plain(search.related(leg.df, "105", 8, cells=leg.cells)) == want and len(want) == 8


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    own = cells.build(df, ("object_id",), "vector", str(tmp_path))
    leg = search.Leg("x", df, F.lit(""), "vector", cells=own)
    want, got, read = both(spark, leg, [1.0, 0.0], 5)
    assert got == want == [] and read["rows"] == 0
