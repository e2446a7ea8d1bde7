"""SimHash near-dedup at a wide radius: five-word shingles, Jaccard similarity of 0.8 or more, checked exactly.

At a similarity of 0.8 two 64-bit SimHashes differ in about 10 bits, and in up to 19 in one pair of a thousand; no
band of bits is left that is both shared and rare.  So the keys under which fingerprints meet come from MinHash here:
``BANDS`` bands of as many minima each as keep the odds that a pair at the threshold meets in no band below ``MISS``
(0.8: five, 3 in a million).  Texts that share a band are linked to its smallest, and the components of these links
are groups of candidates.  All pairs within a group are compared, in cells of two blocks of about ``BLOCK`` texts each,
so a task never holds more than a cell: first their SimHashes, bit-sliced as in ``simhash``, within a radius that pairs
at the threshold exceed with odds below ``FAR``; then, of pairs within it, the whole shingle sets.  A cell returns a
spanning forest of the links that hold.

Words and shingles are as in ``simhash.shingle_hashes``.  Texts of equal sets are one node.  Ids, nulls, repeated rows
and empty tables are as in ``simhash``.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from math import comb, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._rows import look_up, place, placed
from lodestone.llm._workers import kept
from lodestone.llm.components import components
from lodestone.llm.simhash import labelled, majority, one_left, shingle_hashes, within
from lodestone.runtime import Scratch, shuffle_partitions

WIDTH, SIMILARITY = 5, 0.8
BANDS, MISS = 32, 1e-5
FAR = 1e-6
#: Texts in a block of a cell, about.
BLOCK = 256


def band_rows(similarity: float) -> int:
    """Minima of a band."""
    return max(1, int(log(1 - MISS ** (1 / BANDS)) / log(similarity))) if similarity < 1 else 8


def bit_odds(shared: int, left: int, right: int) -> float:
    """Odds that a SimHash bit differs between sets of ``shared`` common hashes and ``left`` and ``right`` of their own."""

    def over(own, x):
        """Odds of a set bit, given x set ones among the shared hashes."""
        return sum(comb(own, y) for y in range(max(0, (shared + own) // 2 - x + 1), own + 1)) / 2**own

    return sum(comb(shared, x) * (over(left, x) + over(right, x) - 2 * over(left, x) * over(right, x)) for x in range(shared + 1)) / 2**shared


@cache
def wide_radius(similarity: Fraction) -> int:
    """Bits that pairs of at least ``similarity`` exceed with odds below ``FAR``.

    The odds of a bit are the largest over all unions of up to 40 shingles; larger sets have smaller ones.
    """
    own = ((n, floor(n * (1 - similarity))) for n in range(1, 41))
    p = max(bit_odds(n - k, a, k - a) for n, most in own for k in range(most + 1) for a in range(k // 2 + 1))
    tail, r = 0.0, 64
    while r and tail + comb(64, r) * p**r * (1 - p) ** (64 - r) < FAR:
        tail += comb(64, r) * p**r * (1 - p) ** (64 - r)
        r -= 1
    return r


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def bands(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """[BANDS] signed longs: a hash of each band's number and minima; no shingles: none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1 << 9):
        np.minimum(least, (shingles[at : at + (1 << 9), None] * factors).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, -1))], np.uint64).view(np.int64)


def near_forest(sets: list[np.ndarray], cut: int | None, similarity: Fraction, prints: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that span the links among ``sets`` (none empty), or with ``cut`` those between sets[:cut] and sets[cut:].

    ``prints`` are the SimHashes of the sets.
    """
    if prints is None:
        prints = np.array([majority(s) for s in sets], np.uint64)
    met = within(prints[:cut], prints[cut or 0 :], wide_radius(similarity))
    sizes = np.array([len(x) for x in sets])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(vocabulary), np.int32)
    label = np.arange(len(sets))
    p, q = similarity.numerator, similarity.denominator
    edges = []
    for i in range(cut or len(sets)):
        start = cut or i + 1
        fit = np.unpackbits(met[i].view(np.uint8), bitorder="little")[start - (cut or 0) : len(sets) - (cut or 0)].astype(bool)
        fit &= (label[start:] != label[i]) & (np.minimum(sizes[start:], sizes[i]) * q >= np.maximum(sizes[start:], sizes[i]) * p)
        others = np.flatnonzero(fit) + start
        if not len(others):
            continue
        mark[codes[i]] = 1
        shared = np.add.reduceat(mark[np.concatenate([codes[k] for k in others])], np.cumsum(sizes[others]) - sizes[others])
        mark[codes[i]] = 0
        own = others[shared * (p + q) >= p * (sizes[others] + sizes[i])]
        roots = np.unique(np.append(label[own], label[i]))
        if len(roots) > 1:
            edges += [(int(roots[0]), int(r)) for r in roots[1:]]
            label[np.isin(label, roots[1:])] = roots[0]
    return edges


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """id, fp (signed long that names the shingle set), place, bands; ``df`` is from ``placed``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = df.select(F.col(id_col).alias("id"), text.alias("text"), place(df).alias("place"))
    schema = T.StructType([own.schema["id"], T.StructField("fp", T.LongType()), own.schema["place"], T.StructField("bands", T.ArrayType(T.LongType()))])
    factors = np.random.default_rng(42).integers(0, 1 << 63, BANDS * band_rows(similarity), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        kept("near")
        for b in batches:
            sets = [shingle_set(x.as_py(), width) for x in b.column(1)]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            met = pa.array([bands(s, factors) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2), met], schema.names)

    return own.mapInArrow(run, schema)


def links(df: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that span the links among the candidates; ``docs`` as from ``signatures``."""
    n_part = shuffle_partitions(df.sparkSession)
    exact = Fraction(str(similarity))
    met = docs.select("fp", F.explode("bands").alias("band"))
    first = scratch.keep(met.groupBy("band").agg(F.min("fp").alias("v"), F.max("fp").alias("z")).filter("v < z").select("band", "v"), "first")
    meet = scratch.keep(met.join(first, "band").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct(), "meet")
    groups = scratch.keep(components(meet, Scratch(df.sparkSession, "near_groups")).withColumnRenamed("node", "fp"), "groups")
    sizes = scratch.keep(groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "group_sizes")
    picks = docs.select("fp", "place").join(groups, "fp").groupBy("fp", "root").agg(F.min("place").alias("place")).join(sizes, "root")

    def whole(pairs):
        kept("near")
        for b, found in pairs:
            for part, rows, at in found:
                sets = [shingle_set(b.column(0)[i].as_py(), width) for i in rows]
                prints = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
                sets = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                own = part.take(at).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(own.column(c).combine_chunks() for c in ("fp", "root", "blocks")), sets, prints], ["fp", "root", "blocks", "set", "print"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    rows = scratch.keep(look_up(df, picks, scratch, "picks", whole, "fp long, root long, blocks int, set array<long>, print long", text), "sets")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "set", "print")
    cells = cells.repartition(n_part, "root", "i", "j").sortWithinPartitions("root", "i", "j", "own")

    def compare(batches):
        now, held = None, []

        def flush():
            """Edges of the cell that is held: own block, fp, set, print."""
            if len(held) < 2:
                return []
            cut = None if now[1] == now[2] else sum(x[0] == now[1] for x in held)
            if cut in (0, len(held)):
                return []
            prints = np.array([x[3] for x in held], np.int64).view(np.uint64)
            return [(held[a][1], held[b][1]) for a, b in near_forest([x[2] for x in held], cut, exact, prints)]

        def batch(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], ["u", "v"])

        for b in batches:
            edges = []
            root, i, j, own, fp = (b.column(k).to_pylist() for k in range(5))
            prints = b.column(6).to_pylist()
            values, offsets = b.column(5).values.to_numpy(), b.column(5).offsets.to_pylist()
            for k, cell in enumerate(zip(root, i, j)):
                if cell != now:
                    edges += flush()
                    now, held = cell, []
                held.append((own[k], fp[k], values[offsets[k] : offsets[k + 1]], prints[k]))
            yield batch(edges)
        yield batch(flush())

    return cells.mapInArrow(compare, "u long, v long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row left of each component of texts that are similar: the one with the component's id, see ``simhash_dedup``."""
    scratch = Scratch(df.sparkSession, "near")
    df = placed(df, scratch)
    docs = scratch.keep(signatures(df, id_col, text_col, width, similarity), "docs")
    edges = links(df, docs, id_col, text_col, width, similarity, scratch)
    return one_left(df, labelled(docs.select("id", "fp", "place"), lambda _: edges, scratch), scratch)
