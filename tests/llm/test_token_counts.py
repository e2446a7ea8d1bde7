"""The rollup against counts made anew."""

import random
import uuid
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import token_counts as tc
from lodestone.llm.pieces import PieceModel

VERSIONS = {"w@1": (tc.WORD, public_tokenizers.path("word_bpe_49k.json")), "p@1": (tc.PIECE, public_tokenizers.path("piece_bpe_32k.model"))}


def slow(rows, extra=0):
    word, piece = Tokenizer.from_file(VERSIONS["w@1"][1]), sentencepiece.SentencePieceProcessor(model_file=VERSIONS["p@1"][1])
    docs, tokens = Counter(), Counter()
    for source, lang, text in rows:
        for v, n in (("w@1", len(word.encode(text or "", add_special_tokens=False).ids)), ("p@1", len(piece.encode(text or "")))):
            docs[source, lang, v] += 1
            tokens[source, lang, v] += n + extra
    return sorted((*map(str, k), docs[k], tokens[k]) for k in docs)


def totals(rollup):
    return sorted((*map(str, r[:3]), *r[3:]) for r in rollup.totals().collect())


def test_rollup(spark, tmp_path):
    rows = [("a", "en", "one two"), ("a", "en", None), ("a", "de", ""), (None, "fr", "été à l'été"), ("b", None, "x " * 5000), ("a", "en", "one two")]
    frame = lambda r: spark.createDataFrame(r, "source string, lang string, text string").withColumn("tokens", F.lit("clash"))
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
    assert totals(rollup) == []
    assert rollup.commit("b1", tc.deltas(frame(rows), VERSIONS))
    assert not rollup.commit("b1", tc.deltas(frame(rows), VERSIONS))
    assert totals(rollup) == slow(rows)
    assert rollup.commit("empty", tc.deltas(frame(rows).limit(0), VERSIONS))
    rollup.compact()
    assert not rollup.commit("b1", tc.deltas(frame(rows), VERSIONS))
    assert totals(rollup) == slow(rows)
    rollup.commit("b2", tc.deltas(frame(rows[:2]), VERSIONS, -1))
    rollup.commit("b3", tc.revisions(frame(rows[4:5]), frame([("b", None, "y z")]), VERSIONS))
    want = slow([*rows[2:4], rows[5], ("b", None, "y z")])
    assert totals(rollup) == want
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == want
    rollup.commit("b4", tc.deltas(frame([*rows[2:4], rows[5], ("b", None, "y z")]), VERSIONS, -1))
    assert totals(rollup) == []


def test_lost_attempt_is_written_anew(spark, tmp_path):
    root = f"{tmp_path}/r"
    rollup = tc.TokenRollup(spark, f"file://{root}")
    one = spark.createDataFrame([("a", "en", "one two")], "source string, lang string, text string")
    rollup.commit("b1", tc.deltas(one, VERSIONS))
    (tmp_path / "r/batches/b1/_SUCCESS").unlink()
    assert totals(rollup) == [] and rollup.commit("b1", tc.deltas(one, VERSIONS))
    assert totals(rollup) == slow([("a", "en", "one two")])


def test_query(spark, sf_dir):
    got = sorted((*map(str, r[:2]), r[2][0] + "@1", *r[3:]) for r in tc.op2_token_counts(spark, sf_dir).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text").collect()]
    assert got == slow(rows, 1)


def test_counts_of_odd_texts_without_the_lattice(monkeypatch):
    """Words that begin with a mark are counted by the library; counts are those of whole texts."""
    path = VERSIONS["p@1"][1]
    r = random.Random(3)
    kinds = ["abcde", "XYZ", "éüñ", " ", "  ", "\n", "\t\r\x0b\0", "0123", ".,;!?'\"", "\u2581", "\u3000\xa0", "你好", "😀\u200d", "<s>", "</s><unk>", "<0x0A>"]
    texts = ["".join(r.choice(kind) if r.random() < 0.9 else kind for kind in r.choices(kinds, k=r.randrange(1, 25))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "\u2581", "a", " a", "a ", "\na", "a\n b", " ".join(f"word{k}" for k in range(5000))]
    asked = []
    stream = PieceModel.stream
    monkeypatch.setattr(PieceModel, "stream", lambda self, symbols: (asked.extend(symbols), stream(self, asked[-1:]))[1])
    got = tc.counter(tc.PIECE, path)(pa.array(texts, pa.string()))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == [len(library.encode(t or "")) for t in texts]
    assert not [w for w in asked if len(w) > 1 and w[0] == "\u2581"]
