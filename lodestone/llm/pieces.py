"""SentencePiece encoding and decoding with a streaming Viterbi.

The lattice of a text has an edge for every piece that the text has at a place.  For a BPE model, a path is right if
each of its neighbours is: two pieces may follow one another if merging the text of both by the model's own order gives
those two again.  Every prefix of a text then has exactly one right last piece, so its backpointer is decided as soon
as the prefix ends, from the pieces that end there and the last pieces of the prefixes before them.  For a unigram
model, the backpointer is that of the best sum of scores.  An edge is never longer than the longest piece, so only that
many states live on; whenever the backpointer paths of all of them meet at one boundary, the ids up to it are final and
are handed out, and what lies before it is forgotten.

In models whose pieces have the word mark at their start only (checked when the model is opened), every path has a
boundary before a word, so a worker remembers the ids of words it has met, up to a bound.

A null text is empty and has no ids.  A character that no piece has becomes its UTF-8 bytes where the model has byte
pieces, else the unknown id.  Decoding gives the text back, but for U+2581, which is the model's own mark for a space,
and what became unknown.  Rows are independent of each other, so repeated rows, null ids and empty tables need no care.
Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.wordcache import WordCache, parts
from lodestone.runtime import ship

MARK = "▁"
#: Pairs of pieces whose order is remembered at most.
PAIRS = 500_000


class PieceModel:
    """A model file's pieces, with encoding and decoding."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normalization and marks before words are supported")
        if any(p.type == self.USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.bpe = proto.trainer_spec.model_type == 2
        if not self.bpe and proto.trainer_spec.model_type != 1:
            raise ValueError("only BPE and unigram models are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == self.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == self.NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == self.UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == self.BYTE}
        self.least = min(self.scores.values()) - 10
        self.longest = max(map(len, self.ids))
        self.by_word = self.bpe and not any(MARK in p.lstrip(MARK) for p in self.ids)
        skip = (self.CONTROL, self.UNKNOWN, self.UNUSED)
        self.surface = [b"" if p.type in skip else bytes([int(p.piece[1:-1], 16)]) if p.type == self.BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.surface[self.unknown] = b" \xe2\x81\x87 "
        self.names = {i: p for p, i in self.ids.items()}
        self._pairs: dict[int, bool] = {}
        self._ends: dict = {}  # pieces by their characters from the last one on; 0 leads to an id
        for p, i in self.ids.items():
            node = self._ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[0] = i
        line = self.by_line = not any("\n" in p for p in self.ids)
        self._chunks = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if line else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.words = WordCache(lambda words: [np.array(self.segment_ids(w), "<u4").tobytes() for w in words])

    # ---- the lattice

    def merge(self, text: str) -> list[str]:
        """Merges by score, the left-most first among equals; quadratic, for the text of two pieces."""
        parts = list(text)
        scores = self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, key: int) -> bool:
        """Whether merging the text of two pieces gives those two; key is left id << 20 | right id."""
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        left, right = self.names[key >> 20], self.names[key & 0xFFFFF]
        found = self._pairs[key] = self.merge(left + right) == [left, right]
        return found

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Pieces of a text that comes in parts, handed out as soon as they are final."""
        text, back, total = "", [0], [0.0]  # the window's text; back[i]: length of the last piece of its first i characters
        last = [-1]  # ids of those pieces, -1 if there is none
        ends, pairs, scores, longest, bpe = self._ends, self._pairs, self.scores, self.longest, self.bpe
        for part in symbols:
            for at in range(0, len(part), 4 * longest):
                text += part[at : at + 4 * longest]
                for end in range(len(back), len(text) + 1):
                    n = 1  # what remains if no piece has this character
                    if bpe:
                        own, node, start = -1, ends, end
                        while start:
                            start -= 1
                            node = node.get(text[start])
                            if node is None:
                                break
                            found = node.get(0)
                            if found is not None:
                                left = last[start]
                                if left >= 0:
                                    ok = pairs.get(left << 20 | found)
                                    if ok is None:
                                        ok = self.follows(left << 20 | found)
                                    if not ok:
                                        continue
                                n, own = end - start, found
                                break
                        last.append(own)
                    else:
                        best = total[end - 1] + self.least
                        for m in range(1, min(longest, end) + 1):
                            s = scores.get(text[end - m : end])
                            if s is not None and (x := total[end - m] + s) > best:
                                n, best = m, x
                        total.append(best)
                    back.append(n)
                if len(text) > longest and (cut := self._meet(back, len(text) - longest + 1, len(text))):
                    final = self._walk(text, back, cut)
                    yield from final
                    text, back, last = text[cut:], [0, *back[cut + 1 :]], last[cut:]
                    if not bpe:
                        total = [x - total[cut] for x in total[cut:]]
        yield from self._walk(text, back, len(text))

    @staticmethod
    def _meet(back: list[int], first: int, last: int) -> int:
        """The last boundary that the paths of all states in [first, last] share, 0 if none."""
        live = set(range(first, last + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - back[top])
        return live.pop()

    @staticmethod
    def _walk(text: str, back: list[int], end: int) -> list[str]:
        out = []
        while end:
            out.append(text[end - back[end] : end])
            end -= back[end]
        return out[::-1]

    # ---- ids

    def segment_ids(self, text: str) -> list[int]:
        """Ids of text in which spaces have become marks."""
        out: list[int] = []
        for piece in self.stream((text,)):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = self.prefix + text.replace(" ", MARK)
        return self.encode_column(pa.array([text]))[0] if self.by_word else np.array(self.segment_ids(marked), "<u4").tobytes()

    def word_lists(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """(words of each text, the texts' numbers in that order) of a model by words."""
        # without runs of spaces every space begins a word, and no piece crosses a line's end; others go by the pattern
        runs = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.equal(texts, ""), pc.match_substring(texts, MARK)))
        plain = texts.filter(pc.invert(runs))
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(self.prefix), plain, ""), " ", " " + MARK)
        if self.by_line:
            marked = pc.replace_substring(marked, "\n", " \n ")
        odd = [self._chunks.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts.filter(runs).to_pylist()]
        lists = pa.concat_arrays([pc.split_pattern(marked, " ").cast(pa.list_(pa.string())), pa.array(odd, pa.list_(pa.string()))])
        return lists, np.argsort(runs.to_numpy(zero_copy_only=False), kind="stable")

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """``encode`` for each text (null: empty); words of all of them are numbered by Arrow and looked up once."""
        texts = texts.fill_null("")
        if not self.by_word:
            return [self.encode(t) for t in texts.to_pylist()]
        lists, order = self.word_lists(texts)
        ids, at = self.words.columns(lists)
        out = [b""] * len(texts)
        for i, x, y in zip(order.tolist(), at, at[1:]):
            out[i] = ids[x:y].tobytes()
        return out

    def count_column(self, texts: pa.Array) -> list[int]:
        """How many ids each text has."""
        if not self.by_word:
            return [len(x) // 4 for x in self.encode_column(texts)]
        lists, order = self.word_lists(texts.fill_null(""))
        out = np.zeros(len(texts), np.int64)
        out[order] = self.words.counts(lists)
        return out.tolist()

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, opened once by each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def library_model(path: str) -> PieceModel:
    """A model whose words are encoded by the sentencepiece library, for counts, where nothing has to stream.

    The library puts a mark before each text, so it is given words without theirs; parts of texts that have none (a line's
    end, a line's first word) and models that are not by words or have unknown characters take the lattice.
    """
    own = PieceModel(path)
    if own.by_word and own.prefix and own.bytes:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(words: list[str]) -> list[bytes]:
            marked = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == MARK]
            lists = [None] * len(words)
            for i, ids in zip(marked, library.encode([words[i][1:] for i in marked], num_threads=1)):
                lists[i] = ids
            lists = [own.segment_ids(w) if x is None else x for w, x in zip(words, lists)]
            ends = np.cumsum([0, *map(len, lists)]) * 4
            data = np.fromiter(chain.from_iterable(lists), "<u4", int(ends[-1]) // 4).tobytes()
            ends = ends.tolist()
            return [data[x:y] for x, y in zip(ends, ends[1:])]

        own.words = WordCache(encode)
    return own


def _per_batch(df: DataFrame, id_col: str, column: str, path: str, fields: list[T.StructField], make) -> DataFrame:
    ship(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(column).alias("x"))
    schema = T.StructType([own.schema["id"], *fields])

    def run(batches):
        pieces = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *make(pieces, b.column(1))], schema.names)

    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids, an array of ints."""

    def make(pieces, texts):
        ids = [x for part in parts(texts) for x in pieces.encode_column(part)]
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

    return _per_batch(df, id_col, text_col, path, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text; null ids give an empty text."""

    def make(pieces, lists):
        return [pa.array([pieces.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in lists], pa.string())]

    return _per_batch(df, id_col, ids_col, path, [T.StructField("text", T.StringType())], make)


def encoding_report(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), decoded_crc32 and n_bytes (of the decoded text in UTF-8), round_trip."""

    def make(pieces, texts):
        out = ([], [], [], [], [])
        for text, ids in ((t.as_py() or "", x) for part in parts(texts) for t, x in zip(part, pieces.encode_column(part))):
            back = pieces.decode(ids)
            data = back.encode()
            for column, x in zip(out, (len(ids) // 4, zlib.crc32(ids), zlib.crc32(data), len(data), back == text)):
                column.append(x)
        return [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.bool_()])]

    fields = [*(T.StructField(c, T.LongType()) for c in ("n_ids", "ids_crc32", "decoded_crc32", "n_bytes")), T.StructField("round_trip", T.BooleanType())]
    return _per_batch(df, id_col, text_col, path, fields, make)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded: doc_id, n_ids, ids_crc32, decoded_crc32, n_bytes, round_trip."""
    import public_tokenizers

    return encoding_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
