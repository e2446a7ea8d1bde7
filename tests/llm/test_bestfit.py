"""Best-fit packing of windows against a slow version, and byte-level ids against the library."""

import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.bestfit import WindowPlan, best_fit_decreasing, op12_best_fit, pack_windows, powers
from lodestone.llm.bytebpe import byte_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_windows(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= size]
        if fit:
            rooms[min(fit)[1]] -= size
        else:
            rooms.append(capacity - size)
    return Counter(rooms)


def random_lengths(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 16, 64, 100])
    top = r.choice([capacity, max(1, capacity // 2), max(1, capacity // 5)])
    kinds = r.sample(range(1, top + 1), r.randrange(1, min(top, 9) + 1))
    return capacity, [r.choice(kinds) for _ in range(r.randrange(0, 300))]


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    capacity, lengths = random_lengths(seed)
    counts = Counter(lengths)
    windows = best_fit_decreasing(counts, capacity)
    rooms = Counter()
    for items, n in windows:
        rooms[capacity - sum(k * m for k, m in items)] += n
    assert rooms == slow_windows(lengths, capacity)
    for fill in (True, False):
        plan = WindowPlan(windows, capacity, fill)
        used = defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                at = 0
                for start, part, window, offset in plan.place(length, rank):
                    assert start == at and part > 0
                    at += part
                    used[window].append((offset, part))
                assert at == length
        assert set(used) == set(range(plan.windows))
        for own in used.values():
            at = 0
            for offset, part in sorted(own):
                assert offset == at
                at += part
            assert at <= capacity and (not fill or at == capacity or at & (at - 1) == 0)
        if not fill:
            assert plan.windows == rooms.total()


def test_powers():
    assert [powers(n) for n in (0, 1, 6, 1023)] == [[], [1], [4, 2], [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]]


def check(rows, got, capacity=1024, special=True):
    tokenizer = Tokenizer.from_file(PATH)
    ids = Counter()
    for i, t in rows:
        ids[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    windows, found = defaultdict(list), Counter()
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32] += 1
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == capacity or at & (at - 1) == 0
    # each document's pieces cover it, whatever its copies
    by_doc = defaultdict(list)
    for i, t in ids.elements():
        by_doc[i].append(t)
    parts = defaultdict(list)
    for (i, start, n, tokens, crc), k in found.items():
        parts[i] += [(start, n, tokens, crc)] * k
    assert set(parts) == set(by_doc)
    for i, docs in by_doc.items():
        assert sum(n for _, n, _, _ in parts[i]) == sum(map(len, docs))
        for start, n, tokens, crc in parts[i]:
            assert any(len(d) == tokens and zlib.crc32(np.array(d[start : start + n], "<u4").tobytes()) == crc for d in docs)
        if len(docs) == 1:
            at = 0
            for start, n, _, _ in sorted(parts[i]):
                assert start == at
                at += n
            assert at == len(docs[0])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], op12_best_fit(spark, sf_dir).collect())


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "same"), (4, "same"), (5, "a <|endoftext|> b"), (6, "x" * 9000), (7, "word " * 40_000), (8, "naïve — “quotes” 你好 " * 90)]
    rows += [(10 + i, " ".join(r.choice(["alpha", "beta", "gämma", "\n"]) for _ in range(r.randrange(900)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", "doc_id AS length", "text AS ids", "1 AS task")
    got = pack_windows(df, PATH).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    check(rows, got)
    plain = pack_windows(df, PATH, fill=False).collect()
    assert all(r.start % 1024 == 0 and (r.length == 1024 or r.start + r.length == r.doc_tokens) for r in plain)
    assert pack_windows(df.limit(0), PATH).count() == 0
    assert pack_windows(df, PATH).columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]


@pytest.mark.parametrize("plain", [True, False])
def test_ids(plain):
    own, tokenizer = byte_tokenizer(PATH, plain), Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = plain
    assert own.fast
    r = random.Random(plain)
    kinds = ["abcdefgzABCDEZ", "éèêçßüöäÉÈÇÄÖÜ", "ıİşŞğĞɏ", "0159²½", "'\"()-_/<>|.,!?", "   \n\n\t\r\x0b", "\x85\xa0\xad", "你好😀", "\x00\x1c\x1f", ["'s", "'re", "<|endoftext|>"], "ɐαж 　"]
    weights = [9, 4, 2, 2, 6, 9, 1, 1, 1, 2, 1]
    texts = ["".join(r.choice(x) for x in r.choices(kinds, weights, k=r.randrange(0, 40))) for _ in range(30_000)]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}\n" for c in (*range(0x300), *(r.randrange(0x300, sys.maxunicode) for _ in range(3000))) if not 0xD800 <= c < 0xE000]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert not [t for t, ids, w in zip(texts, own.column(pa.array(texts)), want) if ids.tolist() != w.ids]
