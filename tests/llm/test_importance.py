"""Importance resampling against a slow version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow(docs, target, buckets=10_000, max_run=1, seed=2024, percent=10, min_words=20):
    def features(t):
        words = WORD.findall((t or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(x.encode()) % buckets for x in runs)

    own = [features(t) for _, t in docs]
    s, t = sum((f for _, f in own), Counter()), sum((features(x)[1] for x in target), Counter())
    all_s, all_t = s.total(), t.total()
    out = []
    for (i, _), (n, f) in zip(docs, own):
        weight = sum(k * math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b, k in f.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((-x[4], x[1] is None, x[1] or 0) for x in out if x[0] >= min_words)
    drawn = Counter(may[: len(may) * percent // 100])
    got = Counter()
    ranks = {}
    for k, x in enumerate(may, 1):
        ranks.setdefault(x, []).append(k)
    for n, i, f, w, score in out:
        key = (-score, i is None, i or 0)
        rank = ranks[key].pop(0) if n >= min_words else None
        got[i, f, w, score, rank if rank and rank <= drawn.total() else None] += 1
    return got


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "x1", "42", "don't", "a_b", "好", *(f"w{k}" for k in range(300))]
    rows = [(None, None), (None, "the " * 30), (0, ""), (1, " \t\n"), (2, "."), (3, "the\x00the\x1fthe"), (4, "ß" * 5000), (5, "the " * 30_000), (6, "Long " * 20), (6, "Long " * 20), (7, "Long " * 19)]
    rows += [(10 + k, r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.choice([2, 19, 20, 21, 80])))) for k in range(250)]
    r.shuffle(rows)
    return rows, [" ".join(r.choice(words[:40]) for _ in range(30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("seed, max_run, chunk, part", [(1, 1, 1_500_000, 32 << 20), (2, 1, 300, 40), (3, 3, 300, 1000)])
def test_against_slow(spark, monkeypatch, seed, max_run, chunk, part):
    """With small chunks and parts, every share is split by chunk."""
    monkeypatch.setattr(importance, "CHUNK", chunk)
    monkeypatch.setattr(importance, "PART", part)
    rows, target = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("doc_id", "text", "1 AS chunk", "2 AS share", "3 AS id", "4 AS __id")
    tf = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int").repartition(2)
    got = importance.importance_sample(df, tf, max_run=max_run, percent=25)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == slow(rows, target, max_run=max_run, percent=25)


def test_empty_sides(spark):
    df = spark.createDataFrame([(i, "one two three " * 9) for i in range(12)], "doc_id long, text string")
    assert importance.importance_sample(df.limit(0), df).count() == 0
    got = importance.importance_sample(df, df.limit(0), percent=50)
    assert Counter(map(tuple, got.collect())) == slow([(i, "one two three " * 9) for i in range(12)], [], percent=50)


def test_names_as_ids(spark):
    """Ids of any type."""
    rows = [(f"d{i}", "one two three " * (i + 7)) for i in range(30)]
    got = importance.importance_sample(spark.createDataFrame(rows, "name string, body string"), spark.createDataFrame([("two",)], "t string"), "name", "body", "t")
    assert sorted(r.rank for r in got.collect() if r.rank) == [1, 2, 3]
