"""Alignment of two tokenizers against a slow version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment
from lodestone.llm.bytebpe import byte_letters

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    letters = byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)

    def a_bytes(i):
        return bytes(letters[c] for c in names[i])

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return a, b, a_bytes, b_bytes


def slow(rows, tools):
    a, b, a_bytes, b_bytes = tools
    aligned, counts = [], Counter()
    for i, t in rows:
        text = " " + (t or "")
        xs = [(x, a_bytes(x)) for x in a.encode(text, add_special_tokens=False).ids]
        ys = [(y, b_bytes(y)) for y in b.encode(t or "")]
        groups = []
        if t and b"".join(x for _, x in xs) == b"".join(y for _, y in ys) == text.encode():
            m = n = 0
            while m < len(xs):
                left, right, p, q = [], [], 0, 0
                while not left or p != q:
                    if p <= q:
                        left.append(xs[m][0])
                        p, m = p + len(xs[m][1]), m + 1
                    else:
                        right.append(ys[n][0])
                        q, n = q + len(ys[n][1]), n + 1
                groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        aligned.append((i, groups, links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = Counter()
    for i, groups, links in aligned:
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out[i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), links.total(), sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


def run(df):
    got = alignment.align_tokens(df, A_PATH, B_PATH)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(map(tuple, got.collect()))


def odd_texts(seed):
    r = random.Random(seed)
    kinds = ["abcdefgzABCDEZ", "éèêçßüöä", "0159²½", "'\"()-_/<>|.,!?", "    ", "\n\n\t\r\x0b", "\x85\xa0\xad ", "你好😀", "\x00\x1c", ["'s", "'re", "<|endoftext|>", "<s>", "<0x41>", "<unk>"], "ɐαж　"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  ", " a  b ", "\n", "\n a", "a\n b", "a  b", "mark▁here", "▁", "x�y", "same text", "same text", "w" * 5000, "un-believ'ble " * 3000]
    return texts + ["".join(r.choice(x) for x in r.choices(kinds, [9, 4, 2, 2, 9, 1, 1, 1, 1, 1, 1], k=r.randrange(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("batch", [1 << 25, 2000])
def test_odd_texts(spark, tools, monkeypatch, batch):
    monkeypatch.setattr(alignment, "BATCH", batch)
    texts = odd_texts(batch)
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("doc_id", "text", "1 AS batch", "2 AS seg", "3 AS id")
    assert run(df) == slow(rows, tools)
    assert run(df.limit(0)) == Counter()
    assert run(df.filter("text IS NULL").select("doc_id", "text")) == slow([x for x in rows if x[1] is None], tools)


def test_query(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(map(tuple, alignment.op11_alignment(spark, sf_dir).collect())) == slow([(r.doc_id, r.text) for r in docs.collect()], tools)


def test_segments():
    texts = odd_texts(7)
    for t, own in zip(texts, alignment.segments(pa.array(texts, pa.string())).to_pylist()):
        assert "".join(own) == (" " + t if t else "")
        assert all(s[0] == " " for s in own)
    assert alignment.segments(pa.array(["ab c,d e"])).to_pylist() == [[" ab", " c,d", " e"]]
    assert alignment.segments(pa.array([None, "x y"], pa.string()).slice(1)).to_pylist() == [[" x", " y"]]
