"""Best-fit packing of token sequences by bin completion.

Documents are tokenized where they are read, and cut into pieces only where they are longer than a sequence.
What decides a packing is the number of pieces of each length, at most ``capacity`` numbers however many
documents there are.  The search runs over these: a bin is begun with the largest length that is left, its
undominated fillings are enumerated, and a filling is used as often as the counts allow.  Branches whose waste
exceeds what a packing better than the incumbent may waste are pruned; the incumbent at the start is the best-fit
decreasing packing.  The result is a plan of few bin patterns with multiplicities, and each piece finds its place
from its rank among the pieces of its length.

The search is depth first, best filling first, and comes back to the fillings it has passed over.  It ends once a
packing has as many bins as the lower bound, which proves it, and else after a bounded effort with the best found, which
is never worse than best-fit decreasing.  The bounds: ``max_nodes`` returns to an earlier bin and 20 * ``max_nodes`` bins
begun; at a bin, ``MAX_FILLINGS`` fillings.  Fillings that waste 0, else 1, else 2 are first sought among those of up to
three lengths (half of MAX_FILLINGS of them), then among those of many copies of one of the 8 largest lengths with up to
three others (the first 4 of them); only where there is none does the enumeration run, for 20 * MAX_FILLINGS steps.
``optimal`` tells a proven packing from the best found.

A null text counts as empty; an empty document is one piece with the end id alone.  Null ids, repeated rows and
equal lengths are packed like any others.  An empty table gives an empty result.  Only ``id_col`` and ``text_col``
are read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm._rows import look_up
from lodestone.llm._workers import kept
from lodestone.llm.bytebpe import byte_letters
from lodestone.llm.wordcache import WordCache, parts, split_words
from lodestone.runtime import Scratch

CAPACITY, END_ID = 2048, 0
#: Nodes of the search, and fillings tried at a node.
MAX_NODES, MAX_FILLINGS = 2000, 16

Pattern = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


# ---------------------------------------------------------------- the search


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of total/capacity and Martello and Toth's L2."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for alpha in {0, *(s for s in sizes if s <= capacity // 2)}:
        large = sum(n for k, n in counts.items() if k > capacity - alpha)
        half = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - alpha]
        small = sum(k * n for k, n in counts.items() if alpha <= k <= capacity // 2)
        room = sum(n for _, n in half) * capacity - sum(k * n for k, n in half)
        best = max(best, large + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing over counts: bins of one pattern move together."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [items, bins]
    full: Counter[Pattern] = Counter()
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                whole, rest = divmod(left, each)
                for items, bins in ((each, whole), (rest, bool(rest))):
                    if bins:
                        open_bins[capacity - items * size].append([[(size, items)], int(bins)])
                break
            group = open_bins[room][-1]
            each = min(room // size, left)
            use = min(group[1], left // each)
            group[1] -= use
            if not group[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            open_bins[room - each * size].append([[*group[0], (size, each)], use])
            left -= use * each
    for groups in open_bins.values():
        for items, bins in groups:
            full[tuple(items)] += bins
    return full


def fillings(sizes: list[int], left: dict[int, int], room: int, slack: int, limit: int) -> list[Pattern]:
    """Undominated ways to fill ``room`` that waste at most ``slack``; least waste first, then larger lengths first.

    A filling is dominated if a length outside it would fit into its waste, if one of its lengths could give way
    to a larger one that is left, or if two of its lengths could give way to one of their sum.
    """
    out: list[tuple[int, Pattern]] = []
    steps = 0

    def undominated(items: Pattern, waste: int) -> bool:
        used = dict(items)
        spare = [s for s in sizes if left[s] > used.get(s, 0)]
        if spare and spare[-1] <= waste:
            return False
        for s in used:
            if any(s < t <= s + waste for t in spare):
                return False
        own = [s for s, n in items for _ in range(min(n, 2))]
        free = set(spare)
        return not any(own[i] + own[j] in free for i in range(len(own)) for j in range(i + 1, len(own)))

    def few(total: int) -> Iterator[Pattern]:
        """Fillings of one, two or three lengths that come to ``total`` exactly, larger lengths first."""
        has = lambda x, *own: x > 0 and left.get(x, 0) > own.count(x)
        if has(total):
            yield ((total, 1),)
        for a in sizes[bisect_left(sizes, -total, key=lambda s: -s) :]:
            rest = total - a
            if 2 * a >= total and has(rest, a):
                yield ((a, 2),) if a == rest else ((a, 1), (rest, 1))
        for a in sizes[bisect_left(sizes, -total, key=lambda s: -s) :]:
            if 3 * a < total:
                break
            for b in sizes[bisect_left(sizes, -min(a, total - a), key=lambda s: -s) :]:
                if a + 2 * b < total:
                    break
                if (b != a or left[a] > 1) and has(total - a - b, a, b):
                    yield tuple(sorted(Counter((a, b, total - a - b)).items(), reverse=True))

    def many(total: int, k: int) -> Pattern | None:
        """Copies of the largest lengths from sizes[k] on, then up to three lengths that come to ``total`` exactly."""
        items: Counter[int] = Counter()
        while k < len(sizes) and total > 3 * sizes[k]:
            n = min(left[sizes[k]], (total - 2 * sizes[k] - 1) // sizes[k])
            items[sizes[k]] += n
            total, k = total - n * sizes[k], k + 1
        for own in islice(few(total), 4):
            both = items + Counter(dict(own))
            if all(left[x] >= n for x, n in both.items()):
                return tuple(sorted(both.items(), reverse=True))
        return None

    def grow(at: int, rest: int, items: list[tuple[int, int]]) -> bool:
        """False once there are enough."""
        nonlocal steps
        steps += 1
        at = max(at, bisect_left(sizes, -rest, key=lambda s: -s))  # the first length that fits
        if at >= len(sizes):
            if rest <= slack and (found := tuple(items)) not in seen and undominated(found, rest):
                seen.add(found)
                out.append((rest, found))
            return len(out) < limit and steps < 20 * limit
        for k in range(at, len(sizes)):
            if rest - tail[k] > slack:  # all that is left from here on can't fill enough
                break
            size = sizes[k]
            for n in range(min(rest // size, left[size]), 0, -1):
                if not grow(k + 1, rest - n * size, [*items, (size, n)]):
                    return False
        return True

    if left.get(room):  # one length that fills the room dominates all else
        return [((room, 1),)]
    seen: set[Pattern] = set()
    for waste in range(min(slack, 2) + 1):  # the best fits need no enumeration
        for found in [*islice(few(room - waste), limit // 2)] or filter(None, (many(room - waste, k) for k in range(min(8, len(sizes))))):
            if found not in seen and undominated(found, waste):
                seen.add(found)
                out.append((waste, found))
        if out:
            break
    if not out:
        tail = [0] * (len(sizes) + 1)
        for i in range(len(sizes) - 1, -1, -1):
            tail[i] = tail[i + 1] + sizes[i] * left[sizes[i]]
        grow(0, room, [])
    return [p for _, p in sorted(out, key=lambda x: x[0])]


def pack(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Counter[Pattern]:
    """Patterns with multiplicities that hold all of ``counts`` in as few bins as the search finds."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths are from 1 to the capacity")
    best = best_fit(counts, capacity)
    least = lower_bound(counts, capacity)
    if sum(best.values()) == least:
        return best
    total = sum(k * n for k, n in counts.items())
    left = dict(counts)
    path: list[tuple[Pattern, int, list[Pattern]]] = []  # a bin's lengths, how often it is used, fillings not tried yet
    bins = waste = nodes = steps = 0

    def use(ways: list[Pattern], first: int) -> None:
        nonlocal bins, waste
        items = Counter(dict(ways[0]))
        items[first] += 1
        own = tuple(sorted(items.items(), reverse=True))
        times = min(left[k] // n for k, n in own)
        for k, n in own:
            left[k] -= n * times
        bins += times
        waste += times * (capacity - sum(k * n for k, n in own))
        path.append((own, times, ways[1:]))

    def undo() -> tuple[list[Pattern], int]:
        nonlocal bins, waste
        own, times, ways = path.pop()
        for k, n in own:
            left[k] += n * times
        bins -= times
        waste -= times * (capacity - sum(k * n for k, n in own))
        return ways, own[0][0]

    while True:
        while sizes := sorted((k for k, n in left.items() if n), reverse=True):
            may = (sum(best.values()) - 1) * capacity - total - waste
            steps += 1
            if steps > 20 * max_nodes:
                return best
            if may < 0:
                break
            first = sizes[0]
            left[first] -= 1
            ways = fillings([s for s in sizes if left[s]], left, capacity - first, min(may, capacity), MAX_FILLINGS)
            left[first] += 1
            if not ways:
                break
            use(ways, first)
        else:
            if bins < sum(best.values()):
                best = Counter()
                for own, times, _ in path:
                    best[own] += times
            if bins == least:
                return best
        ways: list[Pattern] = []
        while path and not ways:
            ways, first = undo()
        nodes += 1
        if not ways or nodes > max_nodes:
            return best
        use(ways, first)


def optimal(patterns: Counter[Pattern], capacity: int = CAPACITY) -> bool:
    """Whether the lower bound proves that no packing of the same lengths has fewer bins."""
    counts: Counter[int] = Counter()
    for items, bins in patterns.items():
        for size, n in items:
            counts[size] += n * bins
    return sum(patterns.values()) == lower_bound(counts, capacity)


# ---------------------------------------------------------------- the plan as tables


class Plan:
    """For each length, which ranks go to which bins and where in them."""

    def __init__(self, patterns: Counter[Pattern]):
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        rows = defaultdict(list)
        used: Counter[int] = Counter()
        first = 0
        for items, bins in sorted(patterns.items(), reverse=True):
            offset = 0
            for size, n in items:
                rows[size].append((used[size], first, n, offset))
                used[size] += n * bins
                offset += n * size
            first += bins
        self.bins = first
        for size, r in rows.items():
            self.by_length[size] = tuple(np.array(c, np.int64) for c in zip(*r))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of pieces by length and rank from 0."""
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
        for at in np.split(order, cuts[1:]) if len(order) else []:
            size = int(length[at[0]])
            start, first, n, offset = self.by_length[size]
            k = np.searchsorted(start, rank[at], side="right") - 1
            own = rank[at] - start[k]
            bins[at] = first[k] + own // n[k]
            offsets[at] = offset[k] + own % n[k] * size
        return bins, offsets


# ---------------------------------------------------------------- Spark


class WordTokenizer:
    """Packed ids of many words at once, by a tokenizers file that drops white space.

    Where the file marks the ends of words in its vocabulary and splits letters from signs, words of letters are
    tokenized as one text and told apart by those marks, and a word with signs behind it as its letters and its signs.
    Some letters end in a combining mark once they are normalized, which then belongs to the signs; so whether signs may be
    split off after a letter is what the tokenizer itself says of that letter.
    """

    #: Words that are remembered at most without their signs, in two halves as by ``WordCache``.
    LIMIT = 200_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        suffix = own["model"].get("end_of_word_suffix")
        pattern = json.dumps(own["pre_tokenizer"])
        self.ends = None
        if suffix and "[\\\\p{L}]+|" in pattern and "[^\\\\s\\\\p{L}\\\\p{N}]+" in pattern:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[str, bool] = {}

    def splits(self, letter: str) -> bool:
        """Whether signs behind this letter are tokenized apart from it."""
        if letter not in self.apart:
            both, one, sign = self.each([f"{letter}.", letter, "."])
            self.apart[letter] = both == one + sign
        return self.apart[letter]

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, letters: list[str]) -> None:
        """Ids of words of letters only."""
        ids = np.frombuffer(self.each([" ".join(letters)])[0], "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(letters):  # some word has no end mark of its own
            self.known.update(zip(letters, self.each(letters)))
            return
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        self.known.update(zip(letters, (data[x:y] for x, y in zip([0, *cuts], cuts))))

    def __call__(self, words: list[str]) -> list[bytes]:
        if self.ends is None:
            return self.each(words)
        if len(self.known) >= self.LIMIT // 2:
            self.older, self.known = self.known, {}
        known = self.known
        parts = []
        for w in words:
            x = w.lower() if w.isascii() else w
            stem = x.rstrip(",.!?;:%*$&#")
            apart = stem.isalpha() and (len(stem) == len(x) or stem[-1] < "\x80" or self.splits(stem[-1]))
            parts.append((stem, x[len(stem) :]) if apart else (x, ""))
        absent = {t for p in parts for t in p if t and t not in known}
        if self.older:
            known.update((t, self.older.pop(t)) for t in absent & self.older.keys())
            absent -= known.keys()
        letters = [t for t in absent if t.isalpha()]
        others = [t for t in absent if not t.isalpha()]
        for at in range(0, len(letters), 512):
            self.learn(letters[at : at + 512])
        known.update(zip(others, self.each(others)))
        return [known[a] + known[b] if b else known[a] for a, b in parts]


#: Words that a worker remembers in whole.
WORDS = 400_000


class LatinWords:
    """Ids of many words at once that are letters below U+0250 and perhaps signs behind them, by tiktoken.

    tiktoken knows no suffix of words, so each is sent with a NUL character behind it.  Pairs of a byte and NUL stand for the
    bytes that have the suffix; their ids lie below those of all merges, so they are made first, and the merges follow in the
    order of the file.  The letters are their own normal form, and U+0130, which has two letters in lower case, is not among them.
    """

    LETTERS, SIGNS = "a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", ",.!?;:%*$&#"
    PATTERN = f"^[{LETTERS}]+[{SIGNS}]*$"
    #: Bytes of a word at most; the time for a word grows with a square.
    LONGEST = 100

    def __init__(self, encoding, ends: np.ndarray):
        self.encoding, self.ends = encoding, ends

    @classmethod
    def of(cls, own: dict) -> LatinWords | None:
        """By the contents of a tokenizers file, if its words are normalized, split and merged in the way that is known here."""
        import tiktoken

        model, steps, split = own["model"], (own["normalizer"] or {}).get("normalizers", ()), (own["pre_tokenizer"] or {}).get("pretokenizers", ())
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            return None
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"} or steps[1]["content"] != " ":
            return None
        if [x["type"] for x in split] != ["Split", "ByteLevel"] or split[1]["add_prefix_space"] or split[1]["use_regex"]:
            return None
        if split[0]["pattern"] != {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"} or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
            return None
        if not all(re.search(f"[^{cls.LETTERS}{cls.SIGNS}]", t["content"]) for t in own["added_tokens"]):
            return None
        letters, added = byte_letters(), {t["content"] for t in own["added_tokens"]}
        ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        known = {(bytes(letters[c] for c in t.removesuffix(suffix)) + b"\0" * t.endswith(suffix)): i for t, i in model["vocab"].items() if t not in added}
        single = {i for x, i in known.items() if len(x) == 1 or len(x) == 2 and x.endswith(b"\0")}
        if sorted(set(ids)) != ids or len(single) != 512 or max(single) > ids[0] or len(known) != 512 + len(ids) or {*ids, *single} != set(known.values()):
            return None
        ends = np.zeros(max(known.values()) + 1, bool)
        ends[[i for x, i in known.items() if x.endswith(b"\0") and len(x) > 1]] = True
        return cls(tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=known, special_tokens={}), ends)

    def takes(self, words: pa.Array) -> pa.BooleanArray:
        return pc.and_(pc.match_substring_regex(words, self.PATTERN), pc.less_equal(pc.binary_length(words), self.LONGEST))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has)."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        low = pc.utf8_lower(words)
        signs = pc.not_equal(pc.binary_length(pc.ascii_rtrim(low, self.SIGNS)), pc.binary_length(low))
        apart = pc.replace_with_mask(low, signs, pc.replace_substring_regex(low.filter(signs), f"([{self.SIGNS}]+)$", "\0\\1"))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(apart)], pa.int32()), apart), "\0")[0].as_py() + "\0"
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return ids, np.diff(cuts[np.cumsum(1 + signs.to_numpy(zero_copy_only=False)) - 1], prepend=0)


class WordIds(WordCache):
    """A memo of words but for those that are encoded as fast as they are looked up."""

    def __init__(self, path: str):
        words = WordTokenizer(path)
        super().__init__(words, WORDS)
        self.latin = LatinWords.of(json.loads(words.tokenizer.to_str()))

    def numbered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.latin:
            return super().numbered(words)
        fast = self.latin.takes(words)
        ids, n = self.latin(words.filter(fast))
        data, start, size = super().numbered(words.filter(pc.invert(fast)))
        fast = fast.to_numpy(zero_copy_only=False)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[fast], sizes[fast] = np.cumsum(n) - n, n
        starts[~fast], sizes[~fast] = len(ids) + start, size
        return np.concatenate([ids, data]), starts, sizes


def word_ids(path: str) -> WordIds:
    """Ids of words by a tokenizers file that drops white space, so that words are tokenized apart from each other."""
    encoders = kept("words")
    if path not in encoders:
        encoders[path] = WordIds(path)
    return encoders[path]


def pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """id, piece, start, length, ids_crc32, task, rank: rank counts the pieces of a length in a task from 0."""
    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([own.schema["id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "task", "rank"))])

    def run(batches):
        cache = word_ids(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, out = [], ([], [], [], [], [])
            each = (ids[x:y].tobytes() + end for part in parts(b.column(1), 2048) for ids, at in [cache.columns(split_words(part))] for x, y in zip(at, at[1:]))
            for i, ids in enumerate(each):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append(i)
                    for column, x in zip(out, (k, k * capacity, n, zlib.crc32(part), seen[n])):
                        column.append(x)
                    seen[n] += 1
            k, start, length, crc, rank = (pa.array(np.array(c, np.int64)) for c in out)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), k.cast(pa.int32()), start, length, crc, pa.array(np.full(len(rows), task)), rank], schema.names)

    return own.mapInArrow(run, schema)


class Ranks:
    """Of pieces with columns length, task and rank, as written to the shared folder: how many have each length, and ranks among all of a length."""

    def __init__(self, cut: DataFrame, scratch: Scratch):
        self.cut, self.scratch = cut, scratch
        self.by_task = scratch.keep(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "by_task")
        self.counts = {r.length: r.n for r in self.by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most

    def look_up(self, run, schema: T.StructType, *columns: str) -> DataFrame:
        """What ``run`` makes of the pieces and their tasks' bases, see ``_rows.look_up``."""
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
        bases = self.by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        key = F.unhex(F.lpad(F.hex("task"), 16, "0"))
        bases = bases.groupBy("task").agg(F.collect_list("length").alias("lengths"), F.collect_list("base").alias("bases")).select(key.alias("place"), "lengths", "bases")
        return look_up(self.cut, bases, self.scratch, "bases", run, schema, *columns, key=key)


def whole_ranks(rank: pa.Array, length: pa.Array, found, capacity: int) -> np.ndarray:
    """Ranks among all pieces, from ranks within tasks and the tasks' bases that were found for them."""
    rank, length = rank.to_numpy(zero_copy_only=False).copy(), length.to_numpy(zero_copy_only=False)
    for part, rows, at in found:
        for j in np.unique(at):
            own = rows[at == j]
            base = np.zeros(capacity + 1, np.int64)
            base[part.column("lengths")[int(j)].as_py()] = part.column("bases")[int(j)].as_py()
            rank[own] += base[length[own]]
    return rank


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, optimal."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(df, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    ranks = Ranks(cut, scratch)
    patterns = pack(ranks.counts, capacity, max_nodes)
    plan, proven = spark.sparkContext.broadcast(Plan(patterns)), optimal(patterns, capacity)
    schema = T.StructType([*cut.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("optimal", T.BooleanType())])

    def place(pairs):
        for b, found in pairs:
            bins, offsets = plan.value.place(b.column(3).to_numpy(zero_copy_only=False), whole_ranks(b.column(5), b.column(3), found, capacity))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offsets), pa.array(np.full(b.num_rows, proven))], schema.names)

    return ranks.look_up(place, schema, "id", "piece", "start", "length", "ids_crc32", "rank").withColumnRenamed("id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, optimal."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
