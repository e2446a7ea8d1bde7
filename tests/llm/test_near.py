"""Near-dedup against brute-force Jaccard."""

import random
from fractions import Fraction

import numpy as np
import pytest
from test_documents import slow_repeats
from test_pipeline import check_packing, similar, slow_kept, texts

import corpus_pipeline
from lodestone.llm import near
from lodestone.llm.simhash import majority, simhash_dedup, within

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=1):
    """Texts and copies with 1 to 12 words changed, short and empty ones, and one group that a block can't hold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    texts = ["", None, " ", "a b c", "A  b c", "a b c d e", "a b c d e f"]
    for i in range(150):
        t = [r.choice(words) for _ in range(r.choice([40, 150, 300]))]
        texts.append(" ".join(t))
        for _ in range(2):
            own = t[:]
            for at in r.sample(range(len(t)), r.randrange(1, 13)):
                own[at] = f"new{r.random()}"
            texts.append(" ".join(own))
    hot = [r.choice(words) for _ in range(200)]
    texts += [" ".join([*hot[:at], f"hot{at}", *hot[at + 1 :]]) for at in range(90)]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_near_copies(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 20)
    rows = planted()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    want, links = slow_kept(rows)
    assert links > 4000
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, df, sf_dir).collect())
    assert got == want
    assert simhash_dedup(df).count() > len(want) + 50  # what the rule of op5_simhash leaves


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = slow_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in near.near_dedup(docs).collect()) == want


@pytest.mark.parametrize("cut", [None, 7])
def test_forest(cut):
    r = np.random.default_rng(3)
    base = r.choice(1000, 60, False)
    sets = [np.unique(np.append(r.choice(base, 56, False), r.integers(1000, 2000, k % 9))).astype(np.uint64) for k in range(20)]
    edges = near.near_forest(sets, cut, Fraction("0.8"))
    reach, want = list(range(20)), list(range(20))
    for a, b in edges:
        reach = [reach[a] if x == reach[b] else x for x in reach]
    for a in range(20):
        for b in range(a + 1, 20):
            if (cut is None or a < cut <= b) and similar({*sets[a]}, {*sets[b]}):
                want = [want[a] if x == want[b] else x for x in want]
    same = lambda l: {(a, b) for a in range(20) for b in range(20) if l[a] == l[b]}
    assert same(reach) == same(want)


@pytest.mark.parametrize("cut", [None, 70])
@pytest.mark.parametrize("radius", [0, 2, 29, 31, 63])
def test_bit_slices(cut, radius):
    r = np.random.default_rng(radius)
    prints = r.integers(0, 1 << 63, 150, np.uint64) * np.uint64(2)
    prints[::3] ^= np.uint64(5)
    left, right = prints[:cut], prints[cut or 0 :]
    got = np.unpackbits(within(left, right, radius).view(np.uint8), axis=1, bitorder="little")
    assert got[:, : len(right)].tolist() == [[int(x ^ y).bit_count() <= radius for y in right.tolist()] for x in left.tolist()]
    assert not got[:, len(right) :].any()


def test_radius_at_the_threshold():
    radius, r = near.wide_radius(Fraction("0.8")), np.random.default_rng(5)
    assert near.wide_radius(Fraction(1)) == 0 and radius < 30
    for shared, left, right in [(4, 1, 0), (8, 2, 0), (8, 1, 1), (40, 5, 5), (400, 100, 0)]:
        h = r.integers(0, 1 << 63, (2000, shared + left + right), np.uint64) * np.uint64(2) + r.integers(0, 2, (2000, shared + left + right), np.uint64)
        bits = [majority(x[: shared + left]) ^ majority(np.append(x[:shared], x[shared + left :])) for x in h]
        assert max(x.bit_count() for x in bits) <= radius
        assert abs(np.mean([x.bit_count() for x in bits]) / 64 - near.bit_odds(shared, left, right)) < 0.01


def test_whole_pipeline(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:2]:
        now = f(spark, now, sf_dir)
    rows = texts(now)
    kept = set(slow_kept(rows)[0])
    rows = [x for x in rows if x[0] in kept]
    check_packing(corpus_pipeline.run(spark, sf_dir), [(i, k if g else t) for (i, t), (_, g, k) in zip(rows, slow_repeats([t for _, t in rows], 35))])
