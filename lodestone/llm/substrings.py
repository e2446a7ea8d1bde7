"""Substring dedup: windows of words that occur more than once, found by level-wise doubling.

A window of ``width`` words (35 by default) can only repeat if the shorter windows within it do.  So lengths
are taken in levels, 9, 18 and 35 by default (each at most twice the one before), and only what repeats at one
length alone is extended to the next, until the full width is reached or no candidate survives.

* Level 1 does not look at all short windows.  Of those within a full window, the one with the least hash (the
  left-most of equals) stands for it: equal windows choose equal ones at equal places.  That leaves about one
  word in 14, and loses nothing.
* Between, a survivor is extended to the right and to the left; a full window lives on if the extension that
  lies inside it repeats.
* The last level takes the full windows of the survivors.

At each level the hashes travel once, packed, to the task that owns their share of the hash space, together
with where they came from; what repeats comes back, packed too, to buckets of rows, and there becomes one row of
positions for each text, by its place in its file.  A hash is sent once by each task that has it, however often, so the
windows of a passage that a third of all documents share do not pile up.  Texts are never shuffled: each level reads
those that have survivors where they lie.  A task holds one share of the hashes, or one bucket, at a time; there are as
many as it takes for each to stand for ``SHARE`` bytes of files at most, and equally many for each partition.

Words are runs of [^\\x20\\x09-\\x0D], unchanged.  A null text has none.  Equal texts have equal results, as each
counts as an occurrence of its own, and repeated rows do too.  Null ids are ids like any others.  An empty table gives
an empty result.  Only ``id_col`` and ``text_col`` are read, except that ``drop_repeats`` returns all columns of its
input, whatever their names.  The levels that only select candidates use a rolling hash of 64 bits, which some texts can
make collide; what two texts share is decided at the last level, by 128 bits of BLAKE2b over each window's words.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._rows import look_up, place, placed
from lodestone.llm._workers import kept
from lodestone.runtime import Scratch, shuffle_partitions

WIDTH = 35
#: Hashes, or positions that are answered, that a task holds before it sends them.
HELD = 1_500_000
#: Bytes of input files for each share of the hashes, about.
SHARE = 16 << 20
MASK = (1 << 64) - 1


def levels(width: int) -> list[int]:
    """Lengths up to ``width``, each at most twice the one before: three levels where the width allows it."""
    out = [width]
    while len(out) < 3 and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


# ---------------------------------------------------------------- hashes of windows of words


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


class Lane:
    """A polynomial hash over the bytes of words joined by single spaces: any window's hash from two prefix sums.

    Bytes stand for random 64-bit numbers, sums are modulo 2**64, and the base is odd, so that its powers have inverses.
    Equal windows have equal hashes; that unequal ones differ is likely, but not for words such as a Thue-Morse run and its
    complement, so this hash may choose candidates only.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, MASK, 256, np.uint64, endpoint=True)
        self.base = int(rng.integers(0, MASK, dtype=np.uint64)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, k, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, k, 1 << 64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts])


LANE = Lane(1)


class Words:
    """The words of a text, and hashes of runs of them."""

    def __init__(self, text: bytes):
        self.list = text.split()
        self.n = len(self.list)
        self.joined = b" ".join(self.list)
        self.data = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if self.n else gaps
        self.ends = np.append(gaps, len(self.data)) if self.n else gaps
        self._sums: np.ndarray | None = None

    def hashes(self, first: np.ndarray, width: int) -> np.ndarray:
        """Of the windows of ``width`` words that begin at the words ``first``."""
        if self._sums is None:
            self._sums = LANE.sums(self.data)
        return LANE.windows(self._sums, self.starts[first], self.ends[first + width - 1])

    def digests(self, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each such window's bytes, as two numbers."""
        data = self.joined
        both = b"".join(blake2b(data[a:z], digest_size=16).digest() for a, z in zip(self.starts[first].tolist(), self.ends[first + width - 1].tolist()))
        both = np.frombuffer(both, np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def anchors(words: Words, short: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each full window, the word its least short window begins at; hashes of all short windows)."""
    h = words.hashes(np.arange(words.n - short + 1), short)
    reach = width - short + 1
    least = sliding_min(h, reach)
    full = np.arange(len(least))
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    most = ~sliding_min(~padded, reach)  # the largest minimum among the full windows that hold a place
    places = np.flatnonzero(h == most)
    at = np.searchsorted(places, full)
    where = places[at]
    while True:  # the least of another window may lie in between
        wrong = np.flatnonzero(h[where] != least)
        if not len(wrong):
            return where, h
        at[wrong] += 1
        where = places[at]


# ---------------------------------------------------------------- what repeats, over all tasks


def _by_text(parts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of parts (keys, which of them, places): all keys, and (which, place) of each pair once, in order."""
    number: dict[bytes, int] = {}
    doc, place = [], []
    for keys, which, at in parts:
        doc.append(np.array([number.setdefault(k, len(number)) for k in keys], np.int64)[which])
        place.append(at)
    doc, place = np.concatenate(doc), np.concatenate(place)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    once = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))
    return list(number), doc[once], place[once]


def _cuts(sorted_values: np.ndarray):
    """(start, end) of each run of equals."""
    at = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return zip(at.tolist(), [*at[1:].tolist(), len(sorted_values)])


def _bucketed(parts, buckets: int):
    """Rows (bucket, doc, keys, place) of ``parts`` as in ``_by_text``: one for each bucket, whatever the number of texts."""
    keys, doc, place = _by_text(parts)
    bucket = np.array([zlib.crc32(k) % buckets for k in keys])[doc]
    order = np.argsort(bucket, kind="stable")
    bucket, doc, place = bucket[order], doc[order], place[order]
    for a, z in _cuts(bucket):
        docs, at = np.unique(doc[a:z], return_inverse=True)
        yield int(bucket[a]), at.astype(np.int32).tobytes(), [keys[d] for d in docs], place[a:z].tobytes()


def _requests(emit_rows, share: int):
    """A mapInArrow function that packs hashes for their owners.

    ``emit_rows(batch)``, or of a batch and what was looked up for it, yields (key, h1, h2 or None, place) for each text: a hash or two and a number for each window.
    Rows out: share, h1, h2, doc (which of keys), keys, place, with each hash once; and where the task itself saw hashes
    repeat, rows without hashes that hold all such places, by their texts' buckets.
    """

    def send(keys, counts, h1, h2, place):
        h1, place = np.concatenate(h1), np.concatenate(place)
        h2 = np.concatenate(h2) if h2[0] is not None else None
        doc = np.repeat(np.arange(len(keys)), counts)
        order = np.argsort(h1, kind="stable") if h2 is None else np.lexsort((h2, h1))
        same = h1[order][1:] == h1[order][:-1]
        if h2 is not None:
            same &= h2[order][1:] == h2[order][:-1]
        first = order[np.append(True, ~same)]
        local = order[np.append(False, same) | np.append(same, False)]
        out: list[tuple] = []
        if len(local):
            docs, at = np.unique(doc[local], return_inverse=True)
            out += [(b, None, None, *rest) for b, *rest in _bucketed([([keys[d] for d in docs], at, place[local])], share)]
        to = (h1[first] >> np.uint64(32)).astype(np.int64) % share
        by = np.lexsort((first, to))
        first, to = first[by], to[by]
        for a, z in _cuts(to):
            own = first[a:z]
            docs, at = np.unique(doc[own], return_inverse=True)
            out.append((int(to[a]), h1[own].tobytes(), None if h2 is None else h2[own].tobytes(), at.astype(np.int32).tobytes(), [keys[d] for d in docs], place[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), REQUEST_TYPES)], REQUEST_NAMES)

    def run(rows):
        kept("substrings")
        keys, counts, h1, h2, place, held = [], [], [], [], [], 0
        for b in rows:
            for key, a, c, p in emit_rows(b):
                if len(a):
                    keys.append(key)
                    counts.append(len(a))
                    h1.append(a)
                    h2.append(c)
                    place.append(p.astype(np.int32))
                    held += len(a)
                if held >= HELD:
                    yield send(keys, counts, h1, h2, place)
                    keys, counts, h1, h2, place, held = [], [], [], [], [], 0
        if held:
            yield send(keys, counts, h1, h2, place)

    return run


REQUEST_NAMES = ["share", "h1", "h2", "doc", "keys", "place"]
REQUEST_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
REQUESTS = "share long, h1 binary, h2 binary, doc binary, keys array<binary>, place binary"
ANSWER_NAMES, ANSWER_TYPES = ["bucket", *REQUEST_NAMES[3:]], [pa.int64(), *REQUEST_TYPES[3:]]
ANSWERS = "bucket long, doc binary, keys array<binary>, place binary"


def _part(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    return row["keys"], np.frombuffer(row["doc"], np.int32), np.frombuffer(row["place"], np.int32)


def _grouped(batches, by: str):
    """Lists of the rows that have the same ``by``; they come one after another."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r[by] != held[0][by]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _repeated(rows: list[dict]) -> tuple[list[bytes], np.ndarray, np.ndarray] | None:
    """The windows of one share whose hashes repeat, as a part for ``_by_text``."""
    h1 = np.concatenate([np.frombuffer(r["h1"], np.uint64) for r in rows])
    h2 = np.concatenate([np.frombuffer(r["h2"], np.uint64) for r in rows]) if rows[0]["h2"] is not None else None
    order = np.argsort(h1, kind="stable") if h2 is None else np.lexsort((h2, h1))
    same = h1[order][1:] == h1[order][:-1]
    if h2 is not None:
        same &= h2[order][1:] == h2[order][:-1]
    hit = order[np.append(False, same) | np.append(same, False)]
    if not len(hit):
        return None
    keys: list[bytes] = []
    doc, place = [], []
    for own, which, at in map(_part, rows):
        doc.append(which + len(keys))
        place.append(at)
        keys += own
    docs, which = np.unique(np.concatenate(doc)[hit], return_inverse=True)
    return [keys[d] for d in docs], which, np.concatenate(place)[hit]


def _answers(share: int):
    """A mapInArrow function: from requests, sorted by share, to packed places of what repeats, one row a bucket for ``HELD`` of them."""

    def send(parts):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_bucketed(parts, share)), ANSWER_TYPES)], ANSWER_NAMES)

    def run(batches):
        kept("substrings")
        parts, held = [], 0
        for rows in _grouped(batches, "share"):
            new = [_part(r) for r in rows if r["h1"] is None]
            if rows := [r for r in rows if r["h1"] is not None]:
                new += filter(None, [_repeated(rows)])
            parts += new
            held += sum(len(at) for _, _, at in new)
            if held >= HELD:
                yield send(parts)
                parts, held = [], 0
        if held:
            yield send(parts)

    return run


def _texts(batches):
    """One row (place, places) for each text of a bucket, from answers sorted by bucket."""
    for rows in _grouped(batches, "bucket"):
        keys, doc, place = _by_text(map(_part, rows))
        found = [(keys[doc[a]], place[a:z].tobytes()) for a, z in _cuts(doc)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["place", "places"])


def _repeats(asked: DataFrame, share: int) -> DataFrame:
    """(place, places): packed int32 numbers of the windows of a row whose hashes repeat, in one row for each that has any."""

    def dealt(df: DataFrame, by: str) -> DataFrame:
        return df.repartitionById(shuffle_partitions(df.sparkSession), F.col(by).cast("int")).sortWithinPartitions(by)

    answers = dealt(asked, "share").mapInArrow(_answers(share), ANSWERS)
    return dealt(answers, "bucket").mapInArrow(_texts, "place binary, places binary")


def _unpack(parts) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in parts]))


# ---------------------------------------------------------------- the operator


def _survivors(found) -> dict[int, list[bytes]]:
    """What was looked up for a batch, by row."""
    out: dict[int, list[bytes]] = {}
    for part, rows, at in found:
        for i, p in zip(rows.tolist(), part.column("places").take(at).to_pylist()):
            out.setdefault(i, []).append(p)
    return out


def repeated_windows(df: DataFrame, text_col: str, width: int, scratch: Scratch) -> DataFrame:
    """(place, places): for the rows of ``df`` (from ``placed``) with repeated windows, the words they begin at, packed int32."""
    steps = levels(width)
    short = steps[0]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n_part = shuffle_partitions(df.sparkSession)
    share = n_part * max(1, -(-size // (n_part * SHARE)))  # a multiple, so that all partitions have equally many

    def level_1(b):
        for key, text in zip(b.column(1).to_pylist(), b.column(0)):
            words = Words(text.as_py())
            if words.n >= width:
                where, h = anchors(words, short, width)
                at = np.unique(where)
                yield key, *(words.digests(at, width) if short == width else (h[at], None)), at

    asked = df.select(text, place(df).alias("place")).mapInArrow(_requests(level_1, share), REQUESTS)
    if len(steps) == 1:
        return _repeats(asked, share)
    half = steps[-2]

    def rows_of(pair):
        b, found = pair
        for i, parts in _survivors(found).items():
            yield b.column(1)[i].as_py(), Words(b.column(0)[i].as_py()), _unpack(parts)

    def level_2(pair):
        # places: 2 * word + 1 for the extension to the right of a short window at that word, 2 * word for that to the left
        for key, words, at in rows_of(pair):
            right, left = at[at + half <= words.n], at[at + short >= half]
            h = words.hashes(np.concatenate([right, left + short - half]), half)
            h[len(right) :] ^= np.uint64(0x5851F42D4C957F2D)
            yield key, h, None, np.concatenate([2 * right + 1, 2 * left])

    def last(pair):
        for key, words, at in rows_of(pair):
            where, _ = anchors(words, short, width)
            ahead = where - np.arange(len(where))  # words of the window before its least short window
            if len(steps) == 2:
                live = np.isin(where, at)
            else:
                live = np.isin(np.where(ahead + half <= width, 2 * where + 1, 2 * where), at)
            first = np.flatnonzero(live)
            yield key, *words.digests(first, width), first

    for k, extend in enumerate([level_2, last][3 - len(steps) :]):
        asked = look_up(df, _repeats(asked, share), scratch, f"level_{k + 1}", _requests(extend, share), REQUESTS, text)
    return _repeats(asked, share)


def _cut(text: bytes, parts: list[bytes] | None, width: int) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by one space)."""
    words = text.split()
    n = len(words)
    if parts:
        first = _unpack(parts)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + width, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return n, n - len(words), b" ".join(words)


def repeat_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each row of ``df``: id_col, n_words, n_removed, kept_text."""
    scratch = Scratch(df.sparkSession, "substrings")
    df = placed(df, scratch)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(pairs):
        for b, found in pairs:
            own = _survivors(found)
            n, gone, kept = zip(*(_cut(text.as_py(), own.get(i), width) for i, text in enumerate(b.column(1)))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    return look_up(df, repeated_windows(df, text_col, width, scratch), scratch, "last", run, schema, id_col, text)


def drop_repeats(df: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with repeated words cut from the text: kept words joined by one space; texts without any stay as they are."""
    scratch = Scratch(df.sparkSession, "substrings_cut")
    df = placed(df, scratch)
    at = df.columns.index(text_col)

    def run(pairs):
        for b, found in pairs:
            columns = b.columns[:-1]
            if own := _survivors(found):
                text = columns[at].to_pylist()
                for i, parts in own.items():
                    text[i] = _cut(text[i].encode(), parts, width)[2].decode()
                columns[at] = pa.array(text, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return look_up(df, repeated_windows(df, text_col, width, scratch), scratch, "last", run, df.schema)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_removed, kept_sha256."""
    report = repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return report.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), v AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM v) WHERE n > 1
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
