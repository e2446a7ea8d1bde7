"""Ids word by word against the tokenizers library on whole texts."""

import json
import random
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.packing import LatinWords, WordIds, WordTokenizer, word_ids
from lodestone.llm.wordcache import WordCache, split_words

SIGNS = ",.!?;:%*$&#"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def differ(tokenizer, texts):
    """Texts whose ids by words differ from the library's."""
    ids, at = word_ids(public_tokenizers.path("word_bpe_49k.json")).columns(split_words(pa.array(texts)))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, x, y, w in zip(texts, at, at[1:], want) if ids[x:y].tolist() != w.ids]


def test_letters_before_signs(tokenizer):
    letters = [c for c in map(chr, range(0x30000)) if unicodedata.category(c)[0] in "LM" or c.isalpha()]
    sign = [SIGNS[i % len(SIGNS)] for i in range(len(letters))]
    assert not differ(tokenizer, [f"xa{c}{s} {c}{s}{s} b{c}" for c, s in zip(letters, sign)])
    assert not differ(tokenizer, ["KENDİ.", "ŞİMDİ, gel", "क़. ख़, ग़!", "ড়: ঢ়; য়?", "ΟΔΟΣ. ΟΔΟΣ", "ΟΔΟΣ"])


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(tokenizer, seed):
    r = random.Random(seed)
    kinds = ["abcdefgzABCDEZ", "éèêçßüöäÉÈÇÄÖÜ", "ıİşŞğĞ", "αβσςΣΩ", "кжЖЙй", "क़क़ख़ড়", "̸́̇‍", "0159²½", SIGNS + "'\"()-_/<>|", " \n\t", "  　", "你好日本", "😀\U0001f468", "각가"]
    weights = [9, 4, 2, 2, 2, 2, 1, 2, 6, 8, 1, 1, 1, 1]
    texts = ["".join(r.choice(x) for x in r.choices(kinds, weights, k=r.randrange(1, 30))) for _ in range(12_500)]
    anything = [chr(c) for c in (r.randrange(sys.maxunicode) for _ in range(12_500)) if not 0xD800 <= c < 0xE000]
    texts += [f"{c}{r.choice(SIGNS)}a {r.choice('aİé')}{c}{r.choice(SIGNS)}" for c in anything]
    assert not differ(tokenizer, texts)


def test_memo_has_a_bound():
    cache = word_ids(public_tokenizers.path("word_bpe_49k.json"))
    ids, at = cache.columns(split_words(pa.array([None, "", "a a"])))
    assert at.tolist() == [0, 0, 0, 2] and ids[0] == ids[1] and ids.dtype == np.dtype("<u4")


def test_frequent_words_stay():
    """The memo is bounded, and words that are met again and again are encoded once."""
    asked = []
    cache = WordCache(lambda words: [asked.append(w) or f"{len(w):04}".encode() for w in words], 20)
    for k in range(200):
        lists = pa.array([["often", f"w{k}", ""], [], [f"w{k}", f"v{k}"]])
        ids, at = cache.columns(lists)
        assert at.tolist() == [0, 2, 2, 4] and cache.counts(lists).tolist() == [2, 0, 2]
        assert len(cache) <= 24
    assert asked.count("often") == 1 and "" not in asked


def test_words_without_signs_stay(tokenizer, monkeypatch):
    monkeypatch.setattr(WordTokenizer, "LIMIT", 20)
    own = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    learnt = []
    learn = own.learn
    own.learn = lambda letters: (learnt.extend(letters), learn(letters))
    for k in range(100):
        words = ["often", "often!", f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}", f"{k}?!"]
        assert own(words) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(words, add_special_tokens=False)]
        assert len(own.known) + len(own.older) <= 30
    assert learnt.count("often") == 1


def test_latin_words_need_no_memo(tokenizer, monkeypatch):
    """Words of Latin letters and signs are neither looked up nor asked of the library, and have its ids."""
    asked = []
    call = WordTokenizer.__call__
    monkeypatch.setattr(WordTokenizer, "__call__", lambda self, words: asked.extend(words) or call(self, words))
    own = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    latin = [c for c in map(chr, range(0x250)) if c.isalpha() and c != "İ"]
    r = random.Random(5)
    syllables = ["th", "er", "tion", "schä", "Ö", "ñe", "the", "and", "aa", "AA", "zz", "Que"]
    words = [*latin, *(f"x{c}{s}" for c in latin for s in SIGNS), *(a + b for a in latin for b in latin)]
    words += ["".join(r.choices(syllables, k=r.randrange(1, 9))) + "".join(r.choices(SIGNS, k=r.randrange(4))) for _ in range(20_000)]
    odd = ["don't", "it's", "ẖ", "H̱", "İ.", "a\0", "\0", "a\0b.", "a1", "1", "...", "a.b", "a\xa0b", "a\x85", "×a", "<|endoftext|>", "a<|endoftext|>", "б", "ﬁ", "a" * 100_000, "ab" * 51]
    texts = [" ".join(x) for x in (words, odd, words[:3] + odd + words[3:6], [])] + [None, " ", "a", "a, b\x1cc"]
    lists = split_words(pa.array(texts))
    ids, at = own.columns(lists)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == want
    assert own.counts(lists).tolist() == [len(x) for x in want]
    assert set(asked) == own.recent.keys() - {""} == {*odd, "b\x1cc"}


def test_each_token_comes_of_its_own_merge():
    """tiktoken makes a token of any two neighbours that spell it, the library of one pair only: no others ever meet, as pairs are merged in order."""
    model = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())["model"]
    order = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    made = {a + b: i for (a, b), i in order.items()}
    for (a, b), i in order.items():
        assert max(made.get(a, -1), made.get(b, -1)) < i
        end = "</w>" if b.endswith("</w>") else ""
        own = [*(a + b).removesuffix("</w>")]
        own[-1] += end
        while len(own) > 2:
            least = min(range(len(own) - 1), key=lambda k: order.get((own[k], own[k + 1]), len(order)))
            assert order.get((own[least], own[least + 1]), len(order)) < i
            own[least : least + 2] = [own[least] + own[least + 1]]
        assert tuple(own) == (a, b)


def test_other_files_are_left_to_the_library(tmp_path):
    own = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    assert LatinWords.of(own)
    for change in (lambda x: x["normalizer"]["normalizers"].pop(), lambda x: x["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[^\s]+"), lambda x: x["model"]["merges"].reverse(), lambda x: x["added_tokens"].append(x["added_tokens"][0] | {"content": "word"})):
        other = json.loads(json.dumps(own))
        change(other)
        assert LatinWords.of(other) is None
    assert LatinWords.of(json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())) is None
    other = json.loads(json.dumps(own))
    other["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(other))
    ids, at = WordIds(str(tmp_path / "cased.json")).columns(split_words(pa.array(["the cat,"])))
    assert ids.tolist() == Tokenizer.from_file(str(tmp_path / "cased.json")).encode("the cat,", add_special_tokens=False).ids
