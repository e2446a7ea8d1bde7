"""Alignment of two tokenizers' tokens by byte offsets.

Both tokenizers end a token before a space that follows a non-space character, whatever stands around it.  So a text is
cut there into segments, and what holds within a segment holds wherever it occurs.  Tasks that read documents number the
distinct segments of about ``BATCH`` bytes of texts and tokenize each of them once; the relational part runs over these:

* ``posexplode`` makes a row of each token, and a window over a segment sums up byte lengths to where each token ends.
* An equi-join on segment and end finds where tokens of both sides end: the cuts.
* The running count of cuts is a group's number within the segment; its tokens are those behind the cut before.
* The segments are joined with their cuts; each group has a range of tokens of either side, and all pairs of the two are its links.

Then each batch's documents meet their segments: a document's numbers are sums over its segments, its groups their groups
in order, its pairs the union of theirs.  Distinct pairs of a document are counted within batches and added up over all, and
the counts go back to the batches.  A segment is in one batch only with its own number, so no step gathers one frequent
word of the whole corpus in one task; a batch is bounded, but that a longer text is a batch of its own.

Texts that are null, empty, or not given back by the bytes of their tokens on either side (U+2581 in a text, say) have no
tokens: zeros, and ``groups_sha256`` ''.  Null ids, repeated rows (each is a document) and empty tables need no care.  Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm._rows import look_up
from lodestone.llm._workers import kept, trim
from lodestone.llm.bytebpe import ByteTokenizer
from lodestone.llm.pieces import MARK
from lodestone.llm.wordcache import parts
from lodestone.runtime import Scratch, shuffle_partitions

#: Bytes of texts in a batch, about; segments that are tokenized as one text.
BATCH, JOINED = 8 << 20, 512
#: Rows of an Arrow batch to or from a worker; segments whose links are held at once.
SENT, STEP = 2_000, 50_000
#: White space.
SPACES = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Texts that hold a space behind white space, or a NUL, are cut by a pattern; others wherever there is a space.
ODD = f"[{SPACES}] |\\x{{0}}"
CUT = re.compile(r"(?<=\S)(?= )")
#: A segment whose only space is at its start and that ends in no white space: in a run of them, a token that starts with a space starts a segment.
PLAIN = f"^ [^ {MARK}]*[^{MARK}{SPACES}]$"


def segments(texts: pa.Array) -> pa.ListArray:
    """Segments of " " + text, each of which begins with a space; none for null and empty texts."""
    texts = texts.fill_null("")
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
    odd = pc.or_(pc.match_substring_regex(spaced, ODD), pc.equal(texts, ""))
    plain = pc.split_pattern(pc.replace_substring(pc.utf8_slice_codeunits(spaced, 1), " ", "\0 "), "\0")
    # the first segment has lost its space, which split would have made an empty string of
    own = [CUT.split(s) if len(s) > 1 else [] for s in spaced.filter(odd).to_pylist()]
    first = pc.binary_join_element_wise(pa.scalar(" "), plain.flatten(), "")
    begins = np.zeros(len(first), bool)
    offsets = plain.offsets.to_numpy()
    begins[offsets[:-1] - offsets[0]] = True
    plain = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pc.if_else(pa.array(begins), first, plain.flatten()))
    order = np.zeros(len(texts), np.int64)
    is_odd = odd.to_numpy(zero_copy_only=False)
    order[~is_odd] = np.arange((~is_odd).sum())
    order[is_odd] = (~is_odd).sum() + np.arange(is_odd.sum())
    return pa.concat_arrays([plain.filter(pc.invert(odd)).cast(pa.list_(pa.string())), pa.array(own, pa.list_(pa.string()))]).take(pa.array(order))


class Side:
    """Ids and byte lengths of segments by one tokenizer: ``joined`` encodes a run of segments, ``single`` one of any kind."""

    def __init__(self, joined, single, surface: list[bytes]):
        self.joined, self.single, self.surface = joined, single, surface
        self.length = np.array([len(x) for x in surface], np.int32)
        self.first = np.array([x[:1] == b" " for x in surface])

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids.tolist()))

    def encode(self, own: list[str], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments one after another, how many each has, whether each is given back by its bytes)."""
        size, good = np.zeros(len(own), np.int64), np.ones(len(own), bool)
        ids, order = [], []

        def alone(k: int) -> None:
            new = self.single(own[k])
            ids.append(new)
            order.append([k])
            size[k], good[k] = len(new), self.text(new) == own[k].encode()

        rows = np.flatnonzero(simple)
        for at in range(0, len(rows), JOINED):
            some = rows[at : at + JOINED]
            text = "".join([own[k] for k in some.tolist()])
            new = self.joined(text)
            cuts = np.flatnonzero(self.first[new])
            if len(cuts) == len(some) and self.text(new) == text.encode():
                ids.append(new)
                order.append(some)
                size[some] = np.diff(cuts, append=len(new))
            else:
                for k in some.tolist():
                    alone(k)
        for k in np.flatnonzero(~simple).tolist():
            alone(k)
        if not ids:
            return np.zeros(0, np.uint32), size, good
        ids, order = np.concatenate(ids), np.concatenate(order).astype(np.int64)
        starts = np.zeros(len(own), np.int64)
        starts[order] = np.cumsum(size[order]) - size[order]
        return ids[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(ids))], size, good


def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both tokenizers, opened once by each worker that cuts texts; they go when its tasks are those of ``documents``."""
    opened = kept("alignment")
    if (a_path, b_path) not in opened:
        import sentencepiece

        a, b = ByteTokenizer(a_path, plain=True), sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        normal = [not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i) or b.is_unused(i)) for i in range(len(pieces))]
        before = len(b.encode("a"))
        if not b.encode("a", out_type=str)[0].startswith(MARK) or any(MARK in p.lstrip(MARK) for p, own in zip(pieces, normal) if own):
            raise ValueError("only models that put a mark before texts and have it nowhere within a piece are supported")
        surface = [p.replace(MARK, " ").encode() if own else bytes([int(p[1:-1], 16)]) if b.is_byte(i) else b"" for i, (p, own) in enumerate(zip(pieces, normal))]

        def quick(text: str) -> np.ndarray:
            return np.array(b.encode(text[1:]), np.uint32)

        def one(text: str) -> np.ndarray:
            return np.array(b.encode("a" + text)[before:], np.uint32)

        opened[a_path, b_path] = Side(a.one, a.one, a.bytes), Side(quick, one, surface)
    return opened[a_path, b_path]


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def cut_texts(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """slot, batch, seg, a, a_bytes, b, b_bytes: ids and lengths of the tokens of each segment of a batch; and for its documents a row without seg: ids, sizes, segs.

    sizes and segs are packed: how many segments each document has, and their numbers one after another.  slot numbers the batches by task.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids_type, ints = pa.list_(_arrow(own, "id")), pa.list_(pa.int32())
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("seg", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a", "a_bytes", "b", "b_bytes")), T.StructField("ids", T.ArrayType(own.schema["id"].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("segs", T.BinaryType())])

    def run(batches):
        both = sides(a_path, b_path)
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def send():
            nonlocal held, size, number
            batch, slot = number << 32 | task, task + 7919 * number
            words = pa.chunked_array([h[2] for h in held], pa.string()).dictionary_encode().combine_chunks()
            segs = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            known = words.dictionary.to_pylist()
            simple = pc.match_substring_regex(words.dictionary, PLAIN).to_numpy(zero_copy_only=False)
            ids, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            good, lists = np.ones(len(known), bool), []
            for side in both:
                tokens, n, right = side.encode(known, simple)
                good &= right
                offsets = pa.array(np.cumsum([0, *n]).astype(np.int32))
                lists += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (tokens.astype(np.int32), side.length[tokens])]
            rows = np.flatnonzero(good)
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                k = len(some)
                none = [pa.nulls(k, t) for t in (ids_type, pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, slot, np.int32)), pa.array(np.full(k, batch)), pa.array(some.astype(np.int32)), *(x.take(pa.array(some)) for x in lists), *none], schema.names)
            if not good.all():  # a document with such a segment has no tokens
                doc = np.repeat(np.arange(len(sizes)), sizes)
                out = np.zeros(len(sizes), bool)
                out[doc[~good[segs]]] = True
                segs, sizes = segs[~out[doc]], np.where(out, 0, sizes)
            packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (sizes, segs)]
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([batch]), pa.nulls(1, pa.int32()), *[pa.nulls(1, ints)] * 4, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(ids_type), *packed], schema.names)
            held, size, number = [], 0, number + 1
            del words, segs, known, simple, ids, sizes, lists, tokens, n, right, offsets
            trim()

        for b in batches:
            at = 0
            for part in parts(b.column(1)):
                lists = segments(part)
                held.append((b.column(0).slice(at, len(part)), pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()))
                at += len(part)
                size += pc.sum(pc.binary_length(part)).as_py() or 0
                if size >= BATCH:
                    yield from send()
        if held:
            yield from send()

    return own.mapInArrow(run, schema)


@contextmanager
def bucketed(df: DataFrame, scratch: Scratch, name: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` as written to the shared folder in buckets of batches, so that what is keyed by batch reads it without a shuffle; gone at the end."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch.path(name)).option("compression", "zstd").bucketBy(buckets, "slot").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        scratch.drop(name)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """While it holds, joins keyed by batch and more take a partitioning by batch as it is, and sorted rows are aggregated as they come; by default Spark would deal both sides anew by all keys, and sort again.

    Workers are sent ``SENT`` rows at a time: both sides of the pipe hold what is sent in whole, and a text may be long.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(SENT), "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def aligned(cut: DataFrame) -> DataFrame:
    """slot, batch, seg, a, b: the tokens of each segment; a_last, b_last: the last token of each of its groups, in order."""
    segs = cut.filter("seg IS NOT NULL")
    key = ["slot", "batch", "seg"]

    def ends(side: str) -> DataFrame:
        """Where each token ends."""
        rows = segs.select(*key, F.posexplode(f"{side}_bytes").alias(side, "n"))
        return rows.select(*key, side, F.sum("n").over(Window.partitionBy(*key).orderBy(side).rowsBetween(Window.unboundedPreceding, 0)).alias("end"))

    cuts = ends("a").join(ends("b").hint("merge"), [*key, "end"])
    group = F.row_number().over(Window.partitionBy(*key).orderBy("end"))
    met = cuts.select(*key, F.struct(group.alias("group"), "a", "b").alias("g"))
    lists = met.groupBy(*key).agg(F.sort_array(F.collect_list("g")).alias("g"))
    return segs.select(*key, "a", "b").join(lists.hint("merge"), key).select(*key, "a", "b", F.col("g.a").alias("a_last"), F.col("g.b").alias("b_last"))


def _lists(values: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists of neighbouring values, one behind the other."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts[:1], ends).astype(np.int32)), values)


def group_links(a: pa.ListArray, b: pa.ListArray, a_last: pa.ListArray, b_last: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(groups of each segment as text, a << 32 | b of all links, how many links each segment has)."""
    if not len(a):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = pc.list_value_length(a_last).to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(n)
    ends, text, tokens = [], [], []
    for side, cuts in ((a, a_last), (b, b_last)):
        size = pc.list_value_length(side).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = side.flatten()
        end = np.repeat(np.cumsum(size) - size, n) + cuts.flatten().to_numpy() + 1  # among all tokens of all segments
        ends.append((np.append(0, end[:-1]), end))
        text.append(pc.binary_join(_lists(ids.cast(pa.string()), *ends[-1]), ","))
        tokens.append(ids.to_numpy().astype(np.int64))
    text = pc.binary_join(_lists(pc.binary_join_element_wise(*text, "|"), last - n, last), ";")
    n_a, n_b = (z - x for x, z in ends)
    k = n_a * n_b
    group = np.repeat(np.arange(len(k)), k)
    within = np.arange(len(group)) - np.repeat(np.cumsum(k) - k, k)
    x = ends[0][0][group] + within // n_b[group]
    y = ends[1][0][group] + within % n_b[group]
    return text, tokens[0][x] << 32 | tokens[1][y], np.add.reduceat(k, last - n)


def coded_links(a: pa.ListArray, b: pa.ListArray, a_last: pa.ListArray, b_last: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(groups of each segment as text, distinct links, which of them each link is, how many links each segment has), by ``STEP`` segments at a time, so that no array of all links is sorted or held beside others."""
    text, own, code, n = [], [], [], []
    for at in range(0, max(len(a), 1), STEP):
        t, pairs, k = group_links(*(x.slice(at, STEP) for x in (a, b, a_last, b_last)))
        pairs, which = np.unique(pairs, return_inverse=True)
        for x, new in zip((text, own, code, n), (t, pairs, which.astype(np.int32), k)):
            x.append(new)
    known = np.unique(np.concatenate(own))
    return pa.concat_arrays(text), known, np.concatenate([np.searchsorted(known, x).astype(np.int32)[c] for x, c in zip(own, code)]), np.concatenate(n)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, of which each has its size."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def documents(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """Of one batch, its rows of documents and its aligned segments: the rows of ``batch_documents``."""
    kept("documents")
    batch = left.column("batch")[0].as_py()
    ids = pa.concat_arrays([c.flatten() for c in left.column("ids").chunks])
    sizes = np.concatenate([np.frombuffer(x, "<i4") for x in left.column("sizes").to_pylist()]).astype(np.int64)
    own = np.concatenate([np.frombuffer(x, "<i4") for x in left.column("segs").to_pylist()]).astype(np.int64)
    right = right.combine_chunks()
    seg = right.column("seg").to_numpy().astype(np.int64)
    top = int(seg.max()) + 1 if len(seg) else 0
    at = np.zeros(top, np.int64)
    at[seg] = np.arange(len(seg))
    own = at[own] if len(own) else own
    a, b, *last = (right.column(c).combine_chunks() for c in ("a", "b", "a_last", "b_last"))
    text, known, code, n_pairs = coded_links(a, b, *last)
    starts = np.cumsum(n_pairs) - n_pairs
    counts = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b, last[0])] + [n_pairs]
    numbers = [_sums(x[own], sizes) for x in counts]
    ends = np.cumsum(sizes)
    del right, a, b, last
    sha, distinct, links = [], [], []
    n_docs = np.zeros(len(known), np.int64)
    for a, z in zip(ends - sizes, ends):
        mine = own[a:z]
        if not len(mine):
            sha.append("")
            distinct.append(b"")
            links.append(b"")
            continue
        groups = text.take(pa.array(mine))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), groups), ";")
        sha.append(hashlib.sha256(groups[0].as_buffer()).hexdigest())
        mine, times = np.unique(mine, return_counts=True)
        k = n_pairs[mine]
        base = np.cumsum(k) - k
        found = code[np.repeat(starts[mine] - base, k) + np.arange(k.sum())]
        found, which = np.unique(found, return_inverse=True)
        n_docs[found] += 1
        distinct.append(found.astype("<i4").tobytes())
        links.append(np.bincount(which, np.repeat(times, k)).astype("<i8").tobytes())
    k, p = len(ids), np.flatnonzero(n_docs)
    columns = [pa.array(np.full(k + len(p), batch)), pa.concat_arrays([ids, pa.nulls(len(p), ids.type)])]
    columns += [pa.concat_arrays([pa.array(x.astype(np.int64)), pa.nulls(len(p), pa.int64())]) for x in numbers]
    columns += [pa.array([*x, *[None] * len(p)], t) for x, t in ((sha, pa.string()), (distinct, pa.binary()), (links, pa.binary()))]
    columns += [pa.concat_arrays([pa.nulls(k, t), pa.array(x, t)]) for x, t in ((p.astype(np.int32), pa.int32()), (known[p], pa.int64()), (n_docs[p], pa.int64()))]
    trim()
    return pa.Table.from_batches(pa.Table.from_arrays(columns, names).to_batches(SENT))


def batch_documents(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """Of each batch: documents with their numbers and packed distinct pairs (number within the batch, links); and its pairs with how many of its documents have them."""
    longs = ("n_a", "n_b", "n_groups", "n_links")
    element = docs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("id", element), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType()), T.StructField("own", T.BinaryType()), T.StructField("links", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("pair", T.LongType()), T.StructField("docs", T.LongType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return documents(left, right, schema.names)

    return docs.groupBy("slot", "batch").cogroup(segs.groupBy("slot", "batch")).applyInArrow(run, schema)


def align_tokens(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = df.sparkSession
    scratch = Scratch(spark, "alignment")
    with in_place(spark), bucketed(cut_texts(df, a_path, b_path, id_col, text_col), scratch, "cut", 4 * shuffle_partitions(spark)) as cut:
        docs = cut.filter("seg IS NULL").select(F.col("slot").alias("slot"), F.col("batch").alias("batch"), "ids", "sizes", "segs")  # aliases, as both sides are of one table
        rows = scratch.keep(batch_documents(docs, aligned(cut)), "rows")
    pairs = rows.filter("pair IS NOT NULL").select("batch", "number", "pair", "docs")
    counts = scratch.keep(pairs.groupBy("pair").agg(F.sum("docs").alias("n")), "pair_counts")
    a = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(a).agg(F.max("n").alias("most"))
    ranked = counts.select("pair", "n", a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = pairs.join(ranked, "pair").groupBy("batch").agg(F.collect_list("number").alias("number"), F.collect_list("n").alias("n"), F.collect_list("best").alias("best"))  # a batch's pairs, which its bytes bound
    key = F.unhex(F.lpad(F.hex("batch"), 16, "0"))
    table = told.select(key.alias("place"), "number", "n", "best")
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType())])

    def run(found_pairs):
        for b, found in found_pairs:
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            own, links = b.column(6).to_pylist(), b.column(7).to_pylist()
            for part, at, of in found:
                for j in np.unique(of):
                    number, n, best = (part.column(c)[int(j)].values.to_numpy(zero_copy_only=False) for c in ("number", "n", "best"))
                    count, top = np.zeros(int(number.max()) + 1, np.int64), np.zeros(int(number.max()) + 1, bool)
                    count[number], top[number] = n, best
                    for i in at[of == j].tolist():
                        mine, times = np.frombuffer(own[i], "<i4"), np.frombuffer(links[i], "<i8")
                        total[i], n_best[i] = times @ count[mine], times[top[mine]].sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n_best), pa.array(total), b.column(5)], schema.names)

    told_docs = rows.filter("pair IS NULL")
    return look_up(told_docs, table, scratch, "told", run, schema, "id", *longs[:4], "groups_sha256", "own", "links", key=key)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers

    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
