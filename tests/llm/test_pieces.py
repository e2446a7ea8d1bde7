"""Encoding against the library's own, and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "hello  world", " " * 40 + "x" + " " * 17, "tab\tand\nline\n\n", "é ñ 漢字かな \U0001f600", "x" * 3000, "<s> </s> <unk> <0x41>", "ab" * 500 + " " + "ba" * 500, "\x00\x01", "1234567890" * 30]


def ids(text):
    return np.frombuffer(pieces.model(PATH).encode(text), "<u4").tolist()


def test_texts():
    for t in TEXTS:
        assert ids(t or "") == LIBRARY.encode(t or ""), t
        assert pieces.model(PATH).decode(pieces.model(PATH).encode(t or "")) == (t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst ▁\nÉß漢1. "), max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode(text)


def test_stream_without_words():
    """The lattice over whole texts, in parts, gives what the words one by one give."""
    own = pieces.model(PATH)
    r = random.Random(2)
    for _ in range(40):
        t = "".join(r.choice(["the", "ing", " ", "er", "on", "q", "\n", "zz", "漢", "  "]) for _ in range(300))
        marked = own.prefix + t.replace(" ", pieces.MARK)
        whole = list(own.stream((marked,)))
        assert "".join(whole) == marked
        cuts = sorted(r.randrange(len(marked)) for _ in range(9))
        assert list(own.stream(marked[a:z] for a, z in zip([0, *cuts], [*cuts, len(marked)]))) == whole
        assert own.segment_ids(marked) == LIBRARY.encode(t)


def test_frames(spark):
    r = random.Random(1)
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate([*TEXTS, *TEXTS, " ".join(str(r.random()) for _ in range(20000))])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = sorted((str(i), LIBRARY.encode(t or "")) for i, t, _ in rows)
    got = pieces.encode(df, PATH)
    assert sorted((str(x.doc_id), x.ids) for x in got.collect()) == want
    assert sorted((str(x.doc_id), x.text) for x in pieces.decode(got, PATH).collect()) == sorted((str(i), t or "") for i, t, _ in rows)
    crc = lambda t: zlib.crc32(np.array(LIBRARY.encode(t or ""), "<u4").tobytes())
    report = pieces.encoding_report(df, PATH).collect()
    assert sorted((str(x.doc_id), x.ids_crc32, x.round_trip) for x in report) == sorted((str(i), crc(t), True) for i, t, _ in rows)
    assert pieces.encoding_report(df.limit(0), PATH).count() == 0


def test_unigram_is_best(monkeypatch):
    """With a unigram's scores, the streamed path has the best sum of all."""
    own = pieces.PieceModel(PATH)
    r = random.Random(4)
    own.bpe, own.scores = False, {p: -r.random() * 10 for p in ["a", "b", "ab", "ba", "aab", "abba", "bb"]}
    own.ids, own.longest, own.least = dict.fromkeys(own.scores, 1), 4, -20
    for _ in range(100):
        t = "".join(r.choice("abc") for _ in range(r.randrange(60)))
        best = [0.0]
        for e in range(1, len(t) + 1):
            best.append(max([best[e - 1] - 20] * (t[e - 1] not in own.scores) + [best[e - n] + own.scores[t[e - n : e]] for n in range(1, min(4, e) + 1) if t[e - n : e] in own.scores]))
        found = list(own.stream(t[i : i + 7] for i in range(0, len(t), 7)))
        assert "".join(found) == t
        assert abs(sum(own.scores.get(p, -20) for p in found) - best[-1]) < 1e-6
