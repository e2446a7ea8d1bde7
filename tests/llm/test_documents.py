"""The operators on documents against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import packing, simhash, substrings
from lodestone.llm.exact_dedup import exact_dedup, exact_groups
from lodestone.runtime import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["__key", "id", "places", "fp", "keep_id", "component_id", "kept"]


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, empty, null, very long and repeated rows, and null ids."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(80)]
    texts = [None, "", " \n\t", "one", "one  two", "One two", "one two", "é É  x", "a b c d", "a\x0bb\x0cc d"]
    for i in range(n):
        t = [r.choice(words) for _ in range(r.choice([3, 20, 60, 200]))]
        if i % 4 == 0:
            k = r.randrange(len(t) + 1)
            t[k:k] = passage[r.randrange(30) : r.randrange(50, 80)]
        texts.append(" ".join(t))
        if i % 5 == 0:
            texts.append("\n ".join(t))
        if i % 7 == 0:
            texts.append(" ".join(t[:-1] + ["x"]))
    texts += ["go " * 100, "go " * 40, " ".join(r.choice(words) for _ in range(20000)), "x" * 50000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[0], rows[1], (None, texts[12], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    for c in COLUMNS[1:]:
        df = df.withColumn(c, df.lang)
    return df.cache()


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def order(i):
    return (i is None, i if i is not None else 0)


def test_exact(docs):
    groups = defaultdict(list)
    rows = pairs(docs, "doc_id", "text")
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), order(i)))
    want = Counter()
    for i, t in rows:
        g = groups[norm(t)]
        want[i, min(g)[1], len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    got = pairs(exact_groups(docs), "doc_id", "keep_id", "group_size", "text_sha256", "kept")
    assert Counter((a, order(b), c, d) for a, b, c, d, _ in got) == want
    kept = [x for x in got if x[4]]
    assert len(kept) == len(groups) and all(order(a) == order(b) for a, b, *_ in kept)
    left = pairs(exact_dedup(docs), "doc_id", "text")
    assert sorted((norm(t), -len(t or ""), order(i)) for i, t in left) == sorted((k, *min(g)) for k, g in groups.items())


def test_exact_keeps_columns(docs):
    assert exact_dedup(docs).columns == docs.columns


def slow_fingerprint(t):
    words = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs):
    rows = pairs(docs, "doc_id", "text")
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots))
    assert Counter(pairs(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id")) == want
    left = pairs(simhash.simhash_dedup(docs), "doc_id")
    assert sorted(left) == sorted((i,) for i in least.values()) + [(None,)] * (len(set(roots)) - len(least))


@pytest.mark.parametrize("block", [2, 64, 1024])
def test_links_of_hot_keys(spark, monkeypatch, block):
    from lodestone.llm.components import components

    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(block)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.choice([0, 1, 1, 2, 2, 3, 9]))) for b in base for _ in range(150)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    scratch = Scratch(spark, "t")
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, scratch)
    got = dict(pairs(components(edges, scratch), "node", "root"))
    roots = slow_components(fps)
    least = defaultdict(list)
    for s, root in zip(signed, roots):
        least[root].append(s)
    assert {s: got.get(s, s) for s in signed} == {s: min(g) for g in least.values() for s in g}


def test_sliced_counts():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 5, 8):
        x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        x[::3] &= rng.integers(0, 1 << 63, 334, dtype=np.uint64) & rng.integers(0, 1 << 63, 334, dtype=np.uint64) & rng.integers(0, 1 << 63, 334, dtype=np.uint64)
        planes = simhash.planes_of(x)
        found = simhash.sliced_within(lambda p, a: planes[p, a], planes.shape[1], radius)
        got = np.unpackbits(found.view(np.uint8), bitorder="little")[:1000].astype(bool)
        assert (got == (np.bitwise_count(x) <= radius)).all()


def slow_repeats(texts, width):
    seen = Counter()
    lists = [WORD.findall(t or "") for t in texts]
    for w in lists:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] += 1
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 7, 35])
def test_substrings(docs, width):
    rows = pairs(docs, "doc_id", "text")
    want = Counter((i, *x) for (i, _), x in zip(rows, slow_repeats([t for _, t in rows], width)))
    assert Counter(pairs(substrings.repeat_report(docs, width=width), "doc_id", "n_words", "n_removed", "kept_text")) == want


def test_substrings_one_row_a_text(spark, docs):
    """What repeats comes back as one row for each text, however many shares its windows fall in; a passage that all share is found in all."""
    passage = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(200)], "doc_id long, text string").repartition(4)
    scratch = Scratch(spark, "one_row")
    got = substrings.repeated_windows(substrings.placed(df, scratch), "text", 35, scratch).collect()
    assert len(got) == len({bytes(r.place) for r in got}) == 200
    assert {len(np.frombuffer(r.places, np.int32)) for r in got} == {266}


def test_substrings_answers_in_small_sends(monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 5)
    h, doc = np.repeat(np.arange(40, dtype=np.uint64), 2), np.tile([0, 1], 40).astype(np.int32)
    rows = [{"share": int(k), "h1": h[h % 4 == k].tobytes(), "h2": None, "doc": doc[h % 4 == k].tobytes(), "keys": [b"a", b"b"], "place": h[h % 4 == k].astype(np.int32).tobytes()} for k in range(4)]
    rows.append({"share": 3, "h1": None, "h2": None, "doc": np.zeros(1, np.int32).tobytes(), "keys": [b"c"], "place": np.full(1, 7, np.int32).tobytes()})
    sent = list(substrings._answers(4)([pa.RecordBatch.from_pylist(rows)]))
    assert len(sent) == 4
    answers = sorted((r for b in sent for r in b.to_pylist()), key=lambda r: r["bucket"])
    texts = [r for b in substrings._texts([pa.RecordBatch.from_pylist(answers)]) for r in b.to_pylist()]
    assert {r["place"]: np.frombuffer(r["places"], np.int32).tolist() for r in texts} == {b"a": list(range(40)), b"b": list(range(40)), b"c": [7]} and len(texts) == 3


def test_substrings_cut_keeps_columns_and_clean_texts(docs):
    cut = substrings.drop_repeats(docs)
    assert cut.columns == docs.columns
    rows = pairs(docs, "doc_id", "text")
    want = Counter((i, k if g else t) for (i, t), (_, g, k) in zip(rows, slow_repeats([t for _, t in rows], 35)))
    assert Counter(pairs(cut, "doc_id", "text")) == want


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    total = 0
    for i, t in pairs(docs, "doc_id", "text"):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = pairs(packing.pack_documents(docs, path), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert Counter(x[:5] for x in got) == want
    sequences = defaultdict(list)
    for x in got:
        sequences[x[5]].append((x[6], x[3]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == packing.lower_bound(Counter(x[3] for x in got), 2048)


def test_pack_is_optimal_on_small_counts():
    r = random.Random(5)

    def least(items, cap):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for room in set(bins):
                if room >= items[i]:
                    rest = list(bins)
                    rest.remove(room)
                    go(i + 1, [*rest, room - items[i]])
            go(i + 1, [*bins, cap - items[i]])

        go(0, [])
        return best

    for _ in range(60):
        items = sorted((r.randint(3, 13) for _ in range(r.randint(1, 9))), reverse=True)
        found = packing.pack(Counter(items), 20)
        assert sum((Counter({k: n * b for k, n in p}) for p, b in found.items()), Counter()) == Counter(items)
        assert all(sum(k * n for k, n in p) <= 20 for p in found)
        assert sum(found.values()) == least(items, 20)


def test_empty_tables(spark):
    import public_tokenizers

    none = spark.createDataFrame([], SCHEMA)
    assert exact_groups(none).count() == exact_dedup(none).count() == 0
    assert simhash.simhash_groups(none).count() == simhash.simhash_dedup(none).count() == 0
    assert substrings.repeat_report(none).count() == substrings.drop_repeats(none).count() == 0
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_files_with_clashing_columns(spark, tmp_path):
    """Frames that only read files are not copied; columns may have any names, those of the operators' own tables too."""
    from lodestone.llm._rows import placed
    from lodestone.llm.near import near_dedup

    names = ["__key", "__once", "__n", "__places", "__kept_text", "place", "place_", "part", "share", "_metadata", "id", "fp", "root"]
    df = spark.createDataFrame(corpus(seed=3), SCHEMA)
    for c in names:
        df = df.withColumn(c, F.lit(c))
    df.repartition(7).write.option("parquet.block.size", 1 << 14).parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    some = df.filter("doc_id IS NULL OR doc_id <> 20").withColumn("more", F.lit(1))
    twice = spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs")
    assert placed(df, None) is df and placed(some, None) is some
    for own in (df, some, twice):
        plain = own.repartition(3)  # no longer a plain scan
        for f in (exact_dedup, simhash.simhash_dedup, near_dedup, substrings.drop_repeats):
            got = f(own)
            assert got.columns == own.columns
            rows = got.collect()
            assert all(r[c] == c for r in rows for c in names)
            assert sorted(norm(r.text) for r in rows) == sorted(norm(r.text) for r in f(plain).collect())


def test_pack_comes_back_to_what_it_passed_over():
    """The best filling of the first bin is a dead end here."""
    r = random.Random(11)
    proven = 0
    for _ in range(150):
        capacity = 60
        bins = [[] for _ in range(r.randrange(3, 7))]
        for b in bins:  # bins that are full to the brim, so the bound can be met
            room = capacity
            while room > 12:
                b.append(r.randrange(6, room - 5))
                room -= b[-1]
            b.append(room)
        counts = Counter(x for b in bins for x in b)
        found = packing.pack(counts, capacity)
        assert sum((Counter({k: n * m for k, n in p}) for p, m in found.items()), Counter()) == counts
        assert all(sum(k * n for k, n in p) <= capacity for p in found)
        assert packing.optimal(found, capacity) == (sum(found.values()) == packing.lower_bound(counts, capacity))
        proven += packing.optimal(found, capacity)
    assert proven >= 145


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("a, b", ["ab", "xq"])
@pytest.mark.parametrize("width", [1, 3, 35])
def test_words_made_to_collide(spark, width, a, b):
    """A Thue-Morse run and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    rows = []
    for i, odd in enumerate((thue_morse(2048, a, b), thue_morse(2048, b, a))):
        rows.append((i, " ".join([*(f"w{k}" for k in range(width // 2)), odd, *(f"x{k}" for k in range(width // 2))])))
    df = spark.createDataFrame([*rows, (2, rows[0][1])], "doc_id long, text string")
    got = sorted(pairs(substrings.repeat_report(df.filter("doc_id < 2"), width=width), "doc_id", "n_removed"))
    want = [(0, 0), (1, 0)] if width > 1 else [(i, g) for (i, _), (_, g, _) in zip(rows, slow_repeats([t for _, t in rows], 1))]
    assert got == want
    assert sorted(pairs(substrings.repeat_report(df, width=width), "doc_id", "n_removed"))[1] == (1, 0)
    assert sorted(pairs(substrings.drop_repeats(df.filter("doc_id < 2"), width=width), "doc_id", "text")) == rows
