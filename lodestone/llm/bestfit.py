"""Packing by best-fit decreasing with a segment tree over remaining capacity.

Documents are tokenized where they are read.  Overlong ones are first cut into full windows; what remains of them, and
all others, are pieces shorter than a window.  Pieces go by descending length into the tightest window that is open and
has room; a segment tree whose leaves are the rooms finds it in a logarithm of the capacity.  Only the number of pieces of
each length matters for that, so it runs over counts: pieces of one length move together, and so do windows filled alike.
The plan has few rows, whatever the number of documents, and each piece finds its place from its rank among those of its
length.

A window is padded to ``capacity`` unless its length is a power of two.  What best fit leaves padded is filled up: the
fullest of these windows receive, the others give their pieces as one stream of tokens, which is cut where a gap ends.
What is left of the stream is less than a window and becomes windows of powers of two.  So there is no padding at all, and
only pieces of given-up windows are cut.  With ``fill`` false no piece is cut, and padding remains.

A null text counts as empty; an empty document is one piece with the end id alone.  Null ids, repeated rows and equal
lengths are packed like any others.  An empty table gives an empty result.  Only ``id_col`` and ``text_col`` are read.
Texts may be as long as a row can be.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytebpe import byte_tokenizer
from lodestone.llm.packing import Ranks, whole_ranks
from lodestone.runtime import Scratch

CAPACITY, END_ID = 1024, 0

Items = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


class RoomTree:
    """Open windows by room; an inner node tells whether there is any below it."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.n)
        self.groups: dict[int, list[list]] = defaultdict(list)  # room -> [items, windows]

    def _mark(self, room: int) -> None:
        i = room + self.n
        self.any[i] = bool(self.groups[room])
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, items: Items, windows: int) -> None:
        self.groups[room].append([items, windows])
        self._mark(room)

    def take(self, room: int, most: int) -> tuple[Items, int]:
        """Up to ``most`` windows of that room that are filled alike."""
        group = self.groups[room][-1]
        n = min(group[1], most)
        group[1] -= n
        if not group[1]:
            self.groups[room].pop()
            self._mark(room)
        return group[0], n

    def tightest(self, size: int) -> int | None:
        """The least room of an open window that is at least ``size``."""
        i = size + self.n
        if self.any[i]:
            return size
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Items, int]]:
    """Windows as (items, how many are filled so)."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths are from 1 to the capacity")
    tree = RoomTree(capacity)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, items, windows = capacity, (), max(1, left // (capacity // size))
            else:
                items, windows = tree.take(room, max(1, left // (room // size)))
            each = min(room // size, left)  # a window that has taken one piece is tighter than the others of its room
            tree.add(room - each * size, (*items, (size, each)), windows)
            left -= each * windows
    return sorted(((items, n) for groups in tree.groups.values() for items, n in groups), reverse=True)


def powers(n: int) -> list[int]:
    """Powers of two that come to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class WindowPlan:
    """Where each piece goes, by its length and its rank among the pieces of that length."""

    def __init__(self, windows: list[tuple[Items, int]], capacity: int, fill: bool = True):
        self.capacity = capacity
        size = lambda items: sum(k * n for k, n in items)
        padded = [w for w in windows if size(w[0]) < capacity and size(w[0]) & (size(w[0]) - 1)] if fill else []
        padded.sort(key=lambda w: (-size(w[0]), w[0]))
        receive = sum(size(items) * n for items, n in padded) // capacity
        gaps, given, rows, used, self.windows, at = [], [], defaultdict(list), defaultdict(int), 0, 0

        def use(items: Items, n: int, place: int, each: int) -> None:
            """Ranks of ``n`` windows' pieces: they stay in windows from ``place`` on, or lie in the stream from there on."""
            offset = 0
            for length, k in items:
                rows[length].append((used[length], each, place, k, offset))
                used[length] += k * n
                offset += k * length

        alike = [w for w in windows if w not in padded] if padded else windows
        for items, n in alike:
            use(items, n, self.windows, 0)
            self.windows += n
        for items, n in padded:
            stay = min(n, receive)
            receive -= stay
            if stay:
                gaps.append((at, capacity - size(items), self.windows, size(items)))
                at += stay * (capacity - size(items))
                use(items, stay, self.windows, 0)
                self.windows += stay
            if n > stay:
                given.append((items, n - stay))
        total = sum(size(items) * n for items, n in given)
        for p in powers(total - at):
            gaps.append((at, p, self.windows, 0))
            at += p
            self.windows += 1
        stream = 0
        for items, n in given:
            use(items, n, stream, size(items))
            stream += n * size(items)
        self.gaps = [np.array(c, np.int64) for c in zip(*gaps)]  # position in the stream, length, first window, offset
        self.by_length = {length: [np.array(c, np.int64) for c in zip(*r)] for length, r in rows.items()}

    def place(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the piece, length, window, offset) of its parts."""
        first, each, place, n, offset = self.by_length[length]
        k = int(np.searchsorted(first, rank, side="right")) - 1
        own, i = divmod(rank - int(first[k]), int(n[k]))
        own_offset = int(offset[k]) + i * length
        if not each[k]:
            yield 0, length, int(place[k]) + own, own_offset
            return
        at = int(place[k]) + own * int(each[k]) + own_offset
        start = 0
        while start < length:
            g = int(np.searchsorted(self.gaps[0], at + start, side="right")) - 1
            base, room, window, behind = (int(c[g]) for c in self.gaps)
            number, inside = divmod(at + start - base, room)
            part = min(room - inside, length - start)
            yield start, part, window + number, behind + inside
            start += part


def pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """id, start, length, doc_tokens, ids (packed unsigned 32-bit), task, rank: rank counts the pieces of a length in a task from 0."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "task", "rank")]
    schema = T.StructType([own.schema["id"], *longs[:3], T.StructField("ids", T.BinaryType()), *longs[3:]])

    def run(batches):
        encode = byte_tokenizer(tokenizer, plain=False)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)

        def send(b, rows, numbers, parts):
            start, length, tokens, rank = (pa.array(np.array(c, np.int64)) for c in zip(*numbers))
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), start, length, tokens, pa.array(parts, pa.binary()), pa.array(np.full(len(rows), task)), rank], schema.names)

        for b in batches:
            rows, numbers, parts = [], [], []
            for i, ids in enumerate(encode.column(b.column(1))):
                ids = np.append(ids, end)
                data = ids.astype("<u4").tobytes()
                for at in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - at)
                    rows.append(i)
                    numbers.append((at, n, len(ids), seen[n]))
                    parts.append(data[4 * at : 4 * (at + n)])
                    seen[n] += 1
                if len(rows) >= 4096:
                    yield send(b, rows, numbers, parts)
                    rows, numbers, parts = [], [], []
            if rows:
                yield send(b, rows, numbers, parts)

    return own.mapInArrow(run, schema)


def pack_windows(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, fill: bool = True) -> DataFrame:
    """One row for each piece: id_col, start, length, doc_tokens, ids (packed little-endian unsigned 32-bit), sequence_id, offset."""
    spark = df.sparkSession
    scratch = Scratch(spark, "bestfit")
    cut = scratch.keep(pieces(df, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    ranks = Ranks(cut, scratch)
    plan = spark.sparkContext.broadcast(WindowPlan(best_fit_decreasing(ranks.counts, capacity), capacity, fill))
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([cut.schema["id"], *longs[:3], T.StructField("ids", T.BinaryType()), *longs[3:]])

    def place(pairs):
        for b, found in pairs:
            rank = whole_ranks(b.column(5), b.column(2), found, capacity)
            rows, out, parts = [], [], []
            ids = b.column(4).to_pylist()
            for i, (start, length, tokens, r) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), rank.tolist())):
                for first, n, window, offset in plan.value.place(length, r):
                    rows.append(i)
                    out.append((start + first, n, tokens, window, offset))
                    parts.append(ids[i][4 * first : 4 * (first + n)])
            columns = [pa.array(np.array(c, np.int64)) for c in (zip(*out) if out else [()] * 5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *columns[:3], pa.array(parts, pa.binary()), *columns[3:]], schema.names)

    return ranks.look_up(place, schema, "id", "start", "length", "doc_tokens", "ids", "rank").withColumnRenamed("id", id_col)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    packed = pack_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
