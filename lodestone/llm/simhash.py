"""SimHash near-dedup with bit-sliced comparison.

Fingerprints have 64 bits.  Two that differ in at most two bits agree in at least two of four 16-bit bands,
so distinct fingerprints meet in six tables keyed by a pair of bands (for another radius, by all ways to leave
``radius`` of ``radius + 2`` bands out).  What meets under a key is compared in cells: a key with many
fingerprints is split into blocks of about ``BLOCK``, and each pair of blocks is a cell, so a task never holds
more than two blocks.  Within a cell, bit planes are stored vertically: a machine word has one bit of 64
fingerprints.  Carry-save counters add up differing bits for all of them at once, and words in which every
lane has exceeded the radius are abandoned.  A cell returns a spanning forest of its links, not the pairs.

Words, shingles and fingerprints are as in ``fingerprint``; a null text has no words.  Copies share a
fingerprint and thus a component.  A component's id is the smallest id in it (null ids are passed over; a
component with none but null ids has a null id).  Repeated rows count like any others.  An empty table gives an
empty result.  Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._rows import keep_rows, place, placed
from lodestone.llm.components import components
from lodestone.runtime import Scratch, shuffle_partitions

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a block of a cell, about.
BLOCK = 1024
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words (of all words if fewer; none: no hash); A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    xxh = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh(joined, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    return np.fromiter((xxh(joined[a:z], seed) for a, z in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, width, seed))


def majority(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hashes: zero."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def planes_of(values: np.ndarray) -> np.ndarray:
    """[64, words]: bit planes of uint64 values, 64 values to a word; the last word is filled up with zeros."""
    n = len(values)
    bits = np.zeros((64, (n + 63) // 64 * 64), np.uint8)
    bits[:, :n] = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def sliced_within(plane, size: int, radius: int, start: np.ndarray | None = None) -> np.ndarray:
    """Words of lanes that differ in at most ``radius`` bits.

    ``plane(p, active)`` gives the words of differing bits of plane p at the indices ``active`` of ``size`` words.
    ``start`` has a bit for each lane that takes no part.
    """
    digits = (radius + 1).bit_length()
    active = np.arange(size)
    over = np.zeros(size, np.uint64) if start is None else start.copy()
    counters = [np.zeros(size, np.uint64) for _ in range(digits)]
    out = np.zeros(size, np.uint64)

    def beyond():
        """Lanes whose counter is over the radius."""
        above, equal = np.zeros(len(active), np.uint64), np.full(len(active), ALL)
        for d in reversed(range(digits)):
            if radius >> d & 1:
                equal = equal & counters[d]
            else:
                above |= equal & counters[d]
                equal = equal & ~counters[d]
        return above

    for p in range(0, 64, 2):
        a, b = plane(p, active), plane(p + 1, active)
        half = counters[0] ^ a
        carry = counters[0] & a | half & b  # a full adder: two planes and the units come to one word and a carry
        counters[0] = half ^ b
        for d in range(1, digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if p % 8 == 6:
            over |= beyond()
            alive = np.flatnonzero(over != ALL)
            if len(alive) < len(active):
                active, over, counters = active[alive], over[alive], [c[alive] for c in counters]
                if not len(active):
                    return out
    out[active] = ~over
    return out


def within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """[left, words]: a bit for each of ``right``, 64 to a word, that differs from a value of ``left`` in at most ``radius`` bits."""
    planes = planes_of(right)
    width = planes.shape[1]
    flips = np.where(np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), ALL, np.uint64(0))
    spare = np.zeros(width, np.uint64)
    if len(right) % 64:
        spare[-1] = ALL << np.uint64(len(right) % 64)
    found = sliced_within(lambda p, active: planes[p, active % width] ^ flips[active // width, p], len(left) * width, radius, np.tile(spare, len(left)))
    return found.reshape(len(left), width)


def forest(values: np.ndarray, cut: int | None, radius: int) -> list[tuple[int, int]]:
    """Pairs of positions that span the links among ``values``, or with ``cut`` those between values[:cut] and values[cut:]."""
    n = len(values)
    left, right = (values, values) if cut is None else (values[:cut], values[cut:])
    shift = 0 if cut is None else cut
    found = within(left, right, radius)
    label = np.arange(n)
    edges = []
    for i in np.flatnonzero(found.any(axis=1)):
        own = np.flatnonzero(np.unpackbits(found[i].view(np.uint8), bitorder="little")) + shift
        roots = np.unique(np.append(label[own], label[i]))
        if len(roots) > 1:
            edges += [(int(roots[0]), int(r)) for r in roots[1:]]
            label[np.isin(label, roots[1:])] = roots[0]
    return edges


def small_forest(values: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among neighbours of equal ``cell`` (sorted); lanes are all pairs at one distance in the sequence."""
    a, b = [], []
    shift = 1
    lanes = np.arange(len(values))
    while True:
        lanes = lanes[lanes < len(values) - shift]
        lanes = lanes[cell[lanes] == cell[lanes + shift]]
        if not len(lanes):
            break
        planes = planes_of(values[lanes] ^ values[lanes + shift])
        found = sliced_within(lambda p, active: planes[p, active], planes.shape[1], radius)
        hit = lanes[np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(lanes)])]
        a.append(hit)
        b.append(hit + shift)
        shift += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def fingerprints(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, fp (signed long), more."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = df.select(F.col(id_col).alias("id"), text.alias("text"), *more)
    schema = T.StructType([own.schema["id"], T.StructField("fp", T.LongType()), *own.schema.fields[2:]])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], schema.names)

    return own.mapInArrow(run, schema)


def band_keys(radius: int) -> list:
    """Columns of keys: fingerprints within the radius agree in one of them at least."""
    bands = radius + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    fp = F.col("fp")
    out = []
    for k, pick in enumerate(combinations(range(bands), 2)):
        key = F.lit(k).cast("long")
        parts = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1).cast("long")) for i in pick]
        out.append(F.struct(key.alias("t"), parts[0].alias("x"), parts[1].alias("y")))
    return out


def links(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``nodes`` has distinct longs fp.  Returns edges (u, v) that span the links within the radius."""
    n_part = shuffle_partitions(nodes.sparkSession)
    keyed = nodes.select("fp", F.explode(F.array(*band_keys(radius))).alias("k"))
    sizes = scratch.keep(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = keyed.join(sizes, "k").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    cells = cells.repartition(n_part, "k", "i", "j").sortWithinPartitions("k", "i", "j", "own")

    def compare(batches):
        held: list[np.ndarray] = []

        def flush(cols, cuts):
            """Whole cells: cols = own block, fp; cuts = where cells begin."""
            own, fp = cols
            fp = fp.view(np.uint64)
            sizes = np.diff(np.append(cuts, len(fp)))
            cell = np.repeat(np.arange(len(cuts)), sizes)
            few = np.repeat(sizes <= 64, sizes)
            a, b = small_forest(fp[few], cell[few], radius)
            us, vs = [fp[few][a]], [fp[few][b]]
            for c in np.flatnonzero(sizes > 64):
                part, side = fp[cuts[c] : cuts[c] + sizes[c]], own[cuts[c] : cuts[c] + sizes[c]]
                cut = int(np.searchsorted(side, side[-1])) or None
                pairs = np.array(forest(part, cut, radius), np.int64).reshape(-1, 2)
                us.append(part[pairs[:, 0]])
                vs.append(part[pairs[:, 1]])
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            k = b.column(0)
            cols = np.stack([*(k.field(x).to_numpy(zero_copy_only=False) for x in range(3)), *(b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(1, 5))])
            held.append(cols)
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero(np.append(True, (np.diff(rows[:5], axis=1) != 0).any(axis=0)))
            if len(new) > 1:  # the last cell may go on in the next batch
                yield flush(rows[5:, : new[-1]], new[:-1])
                rows = rows[:, new[-1] :]
            held = [rows]
        if held and held[0].shape[1]:
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero(np.append(True, (np.diff(rows[:5], axis=1) != 0).any(axis=0)))
            yield flush(rows[5:], new)

    return cells.mapInArrow(compare, "u long, v long")


def labelled(docs: DataFrame, link, scratch: Scratch) -> DataFrame:
    """``docs`` (id, fp, ...) with root and component_id; ``link`` gives the edges (u, v) among distinct fp."""
    nodes = scratch.keep(docs.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    edges = scratch.keep(link(nodes), "links")
    roots = scratch.keep(nodes.join(components(edges, scratch), nodes.fp == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    least = scratch.keep(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.keep(roots.join(least, "root").select("fp", "root", "component_id"), "named")
    return docs.join(named, "fp", "left")


def _labelled(df: DataFrame, id_col: str, text_col: str, radius: int, *more: Column) -> DataFrame:
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.keep(fingerprints(df, id_col, text_col, *more), "docs")
    return labelled(docs, lambda nodes: links(nodes, radius, scratch), scratch)


def one_left(df: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` (from ``placed``) with one row left of each root of ``rows`` (id, place, root, component_id)."""
    named = F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("place"))
    stays = scratch.keep(rows.groupBy("root").agg(F.min(named).alias("stay"), F.count("*").alias("n")).filter("n > 1"), "stays")
    return keep_rows(df, rows.join(stays, "root").filter("place <> stay"), scratch)


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``df``: id_col, fingerprint (16 hex digits), component_id."""
    return _labelled(df, id_col, text_col, radius).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row left of each component: the one with the component's id (of several with that id, one)."""
    scratch = Scratch(df.sparkSession, "simhash_drop")
    df = placed(df, scratch)
    return one_left(df, _labelled(df, id_col, text_col, radius, place(df).alias("place")), scratch)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint, component_id."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
