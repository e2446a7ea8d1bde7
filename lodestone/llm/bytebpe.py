"""Byte-level BPE ids of whole texts, equal to those of the tokenizers library.

Where a file's ids are in the order of its merges and it splits texts by the usual pattern, texts whose characters all lie
below U+0250 are encoded by tiktoken, which merges the same pairs in the same order several times faster; categories of
those characters are the same in all versions of Unicode.  All other texts go through the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

#: The pattern of a ByteLevel pre-tokenizer with use_regex. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAST = re.compile("[\x00-ɏ]*")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others counted on from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """``plain``: strings of special tokens in a text are text like any other; else they become those tokens."""

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        own = json.loads(self.tokenizer.to_str())
        letters = byte_letters()
        special = [] if plain else [t["content"] for t in own["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        added = {t["content"] for t in own["added_tokens"]}
        size = self.tokenizer.get_vocab_size()
        #: The bytes of each id; b"" for special tokens.
        self.bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab().items():
            if token not in added:
                self.bytes[i] = bytes(letters[c] for c in token)
        self.fast = self._fast(own)

    def _fast(self, own: dict):
        """A tiktoken encoding with the same ids, if there can be one."""
        import tiktoken

        model, how = own["model"], own["pre_tokenizer"] or {}
        if own["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        if how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True):
            return None
        ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        single = [i for i, b in enumerate(self.bytes) if len(b) == 1]
        if sorted(ids) != ids or len(set(ids)) < len(ids) or len(single) != 256 or max(single) > ids[0] or {*ids, *single} != {i for i, b in enumerate(self.bytes) if b}:
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in [*single, *ids]}, special_tokens={})

    def one(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers."""
        if self.fast and FAST.fullmatch(text) and not (self.special and self.special.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def column(self, texts: pa.Array):
        """Ids of each text; null is empty."""
        return (self.one(t.as_py() or "") for t in texts)


_open: dict[tuple[str, bool], ByteTokenizer] = {}


def byte_tokenizer(path: str, plain: bool) -> ByteTokenizer:
    """The tokenizer of a file, opened once by each worker."""
    if (path, plain) not in _open:
        _open[path, plain] = ByteTokenizer(path, plain)
    return _open[path, plain]
