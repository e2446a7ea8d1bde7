"""Vectors that the engine makes, against plain Python, and the switch between versions."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, vectorize
from lodestone.operators.store import CollectionStore


def slow(text, dimensions):
    own = [0] * dimensions
    for t in re.split("[^a-z0-9]+", (text or "").lower()):
        if t:
            own[int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dimensions] += 1
    size = math.sqrt(sum(x * x for x in own))
    return [x / size if size else 0.0 for x in own]


TEXTS = ["one two two three", "", None, "!!! ...", "One TWO", "word " * 5000, *(f"w{i} w{i % 7} common" for i in range(300))]


@pytest.mark.parametrize("dimensions", [1, 16, 200])
def test_vectors(spark, dimensions):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "slot int, text string")
    got = {r.slot: r.vector for r in vectorize.hashed_vectors(df, "slot", F.col("text"), dimensions).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(slow(t, dimensions), abs=1e-12)


def test_versions(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "s"))
    store.append("CallNotes", spark.createDataFrame([(str(i), t, "team" if i % 2 else None) for i, t in enumerate(TEXTS)], "object_id string, summary string, title string"))
    with pytest.raises(search.NotSearchable):
        vectorize.vectors_of(store, "CallNotes")
    assert vectorize.revectorize(store, "CallNotes", 32) == 1
    text = vectorize.schema.search_text("CallNotes", vectorized=True)
    own = {r.object_id: r.t for r in store.read("CallNotes").select("object_id", text.alias("t")).collect()}

    def check(dimensions):
        q = slow("common w3 w10", dimensions)
        want = sorted(((-round(sum(a * b for a, b in zip(q, slow(t, dimensions))), 6) + 0.0, i) for i, t in own.items()))[:9]
        read = {}
        got = [(r.object_id, r.score) for r in vectorize.near_text(store, "CallNotes", "common w3 w10", 9, read=read).collect()]
        assert got == [(i, -s) for s, i in want] and read["rows"] == len(TEXTS)

    check(32)
    assert vectorize.revectorize(store, "CallNotes", 64) == 2
    check(64)
    # a version without its marker is not read, and the next one gets another number
    (tmp_path / "s/CallNotes.vectors/v2-64" / vectorize.MARKER).unlink()
    check(32)
    assert vectorize.revectorize(store, "CallNotes", 16) == 3
    check(16)
    assert store.read("CallNotes").count() == len(TEXTS)


def test_empty(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "s"))
    store.create("CallNotes")
    vectorize.revectorize(store, "CallNotes")
    assert vectorize.near_text(store, "CallNotes", "x", 3).collect() == []
    assert vectorize.query_vector(spark, "").first().q == [0.0] * 64
