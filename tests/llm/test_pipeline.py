"""The pipeline's stages, each against brute force on what the stage before has kept."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_documents import norm, order, slow_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import packing
from lodestone.llm.toxicity import labelled_chain


def grams(t):
    words = (t or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4


def slow_kept(rows):
    """Smallest id of each component of texts whose five-word shingles are similar, by all pairs; and the number of links."""
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                links += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(least.get(x, i), i)
    return sorted(least.values()), links


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf_dir, docs, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_dedup", "substring_dedup", "packing"]
    chain = labelled_chain(spark, docs, sf_dir)
    now, want = docs, texts(docs)
    for name, f in corpus_pipeline.STAGES[:-1]:
        f(spark, now, sf_dir).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.schema == docs.schema
        if name == "toxicity":
            want = [x for x, p in zip(want, chain.probabilities([t for _, t in want])[:, -1]) if p <= chain.threshold]
            assert 0.8 * docs.count() < len(want) < docs.count()
        elif name == "exact_dedup":
            best = {}
            for i, t in want:
                key = (-len(t or ""), order(i), t)
                best[norm(t)] = min(best.get(norm(t), key), key)
            want = [(k[1][1], k[2]) for k in best.values()]
        elif name == "simhash_dedup":
            kept = set(slow_kept(want)[0])
            want = [x for x in want if x[0] in kept]
        else:
            want = [(i, k if g else t) for (i, t), (_, g, k) in zip(want, slow_repeats([t for _, t in want], 35))]
        assert Counter(texts(now)) == Counter(want), name
    check_packing(stages["packing"](spark, now, sf_dir), want)
    check_packing(corpus_pipeline.run(spark, sf_dir), want)


def check_packing(df, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    got = df.collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]]
    assert len(places) == packing.lower_bound(Counter(r.length for r in got), 2048)


def test_nothing_left(spark, sf_dir, docs):
    none = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, sf_dir).count() == 0, name


def test_workers_are_sent_few_rows_at_a_time(spark, sf_dir):
    """Rows reach workers by 2,000 at most once a stage has begun; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3)], "doc_id long, text string")
    try:
        for own, most in (("10000", 2000), ("0", 2000), ("700", 700)):
            spark.conf.set(name, own)
            assert corpus_pipeline.exact(spark, docs, sf_dir).count() == 3
            sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) == most and sum(r.n for r in sizes) == 5000
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set(name, before)
