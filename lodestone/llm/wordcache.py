"""Memo of what a tokenizer makes of a white-space delimited word, with a bound on its size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers at most, but for those of one slice of texts.
LIMIT = 800_000


class WordCache:
    """word -> packed ids.  ``encode`` makes a list of packed ids from a list of words.

    Words are remembered in two halves.  When the recent one is full, it becomes the older one; of the older one before,
    only words that have been met since stay, so frequent words are never forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.recent) + len(self.older)

    def look_up(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words."""
        if len(self.recent) >= self.limit // 2:
            self.older, self.recent = self.recent, {}
        out = [self.recent.get(w) for w in words]
        absent = [i for i, x in enumerate(out) if x is None]
        for i in absent:
            out[i] = self.older.pop(words[i], None) if words[i] else b""
        new = [i for i in absent if out[i] is None]
        for i, x in zip(new, self.encode([words[i] for i in new])):
            out[i] = x
        self.recent.update((words[i], out[i]) for i in absent)
        return out

    def numbered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct words, where each word's begin, how many it has)."""
        out = self.look_up(words.to_pylist())
        size = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), "<u4"), np.cumsum(size) - size, size

    def counts(self, lists: pa.ListArray) -> np.ndarray:
        """How many ids each list of words has."""
        own = lists.flatten().dictionary_encode()
        size = self.numbered(own.dictionary)[2]
        ends = np.concatenate([[0], np.cumsum(size[own.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(ends[np.asarray(lists.offsets)])

    def columns(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lists of words one after another, where each list's begin and the last one's end).

        Words are numbered by Arrow, so only distinct ones are looked up here.
        """
        own = lists.flatten().dictionary_encode()
        data, start, size = self.numbered(own.dictionary)
        word = own.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = data[np.repeat(start[word] - ends[:-1], n) + np.arange(ends[-1])] if len(word) else data
        return ids, ends[np.asarray(lists.offsets)]


def split_words(texts: pa.Array) -> pa.ListArray:
    """Texts cut at ASCII white space; null is empty."""
    return pc.ascii_split_whitespace(texts.fill_null(""))


def parts(texts: pa.Array, most: int = 512, size: int = 4_000_000):
    """Slices of a column with few enough texts and bytes that their words can be held at once."""
    n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(n, (n[at - 1] if at else 0) + size, side="right"))
        end = min(max(end, at + 1), at + most)
        yield texts.slice(at, end - at)
        at = end
