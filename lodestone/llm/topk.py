"""Exact top-k by integer inner product over norm-sorted vectors.

Components become floor(scale * x) as integers.  All vectors are sorted by descending length and packed into
blocks; the queries are packed into blocks of their own, and each pair of blocks is one row of work.  A pair is
not even formed where the product of the largest lengths can't reach the least score that a query of the block
still needs.  Within a pair, vectors go by in descending length.  The first coordinates of an SVD rotation (of all
vectors, from their Gram matrix) give a partial sum, and Cauchy-Schwarz bounds what the others can add; only what
may still reach a query's k-th score gets its exact integer product.  Every query starts with the k-th score it has
among the longest vectors.

Vectors that are null or hold a null or non-finite component take no part.  Vectors of different dimensions are
filled up with zeros; an empty vector has inner product 0 with any.  A row is no candidate for itself; repeated rows
are candidates for each other.  Equal scores go to the smaller id, null ids last.  A table without queries or vectors
gives an empty result.  Scores beyond the range of a long are cut to it.  Only ``id_col`` (an integer) and
``vec_col`` are read, and what ``is_query`` reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.runtime import Scratch, shuffle_partitions

K, SCALE = 5, 256
#: Vectors and queries in a block; the longest vectors that give the first thresholds.
BLOCK, QUERIES, HEAD, STRIDE = 2048, 1024, 2048, 512
EXACT = float(1 << 53)
LOW = -float("inf")


def _matrix(vectors, dim: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    a, b = q.astype(np.float64), c.astype(np.float64)
    if np.sqrt((a * a).sum(axis=1)).max(initial=0) * np.sqrt((b * b).sum(axis=1)).max(initial=0) < EXACT / 2:
        return (a @ b.T).astype(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least, self.kept = k, least.copy(), np.full((n, k), LOW)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, q: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
        """Pairs with scores, each at least its query's threshold."""
        self.parts.append((q, c, score))
        order = np.lexsort((-score, q))
        q, score = q[order], score[order].astype(np.float64)
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        few = place < self.k
        both = np.full((len(self.kept), self.k), LOW)
        both[q[few], place[few]] = score[few]
        rows = np.unique(q)
        both = np.sort(np.concatenate([self.kept[rows], both[rows]], axis=1), axis=1)[:, ::-1]
        self.kept[rows] = both[:, : self.k]
        self.least[rows] = np.maximum(self.least[rows], self.kept[rows, self.k - 1])

    def best(self, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, candidate, score): k of each query, ties to smaller ids."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none
        q, c, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((tags[c], ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[few], c[few], score[few]


def search(q: np.ndarray, q_tags: np.ndarray, least: np.ndarray, c: np.ndarray, ids: np.ndarray, tags: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """One pair of blocks; the candidates are sorted by descending length."""
    dim = c.shape[1]
    turned_q, turned_c = q @ rotation, c @ rotation
    q_len, c_len = np.sqrt((turned_q**2).sum(axis=1)), np.sqrt((turned_c**2).sum(axis=1))
    cuts = sorted({max(1, dim // 4), max(1, dim // 2)})
    rest = [(np.sqrt((turned_q[:, m:] ** 2).sum(axis=1)), np.sqrt((turned_c[:, m:] ** 2).sum(axis=1))) for m in cuts]
    best = Best(len(q), k, least)
    for at in range(0, len(c), STRIDE):
        own = slice(at, min(at + STRIDE, len(c)))
        slack = 1e-9 * q_len * c_len[at] + 1e-6
        rows = np.flatnonzero(q_len * c_len[at] + slack >= best.least)
        if not len(rows):
            break  # all that follow are shorter
        live = np.ones((len(rows), own.stop - at), bool)
        done, partial = 0, 0.0
        for m, (q_rest, c_rest) in zip(cuts, rest):
            partial = partial + turned_q[rows, done:m] @ turned_c[own, done:m].T
            live &= partial + q_rest[rows, None] * c_rest[None, own] >= (best.least - slack)[rows, None]
            done = m
            keep = live.any(axis=1)
            rows, live, partial = rows[keep], live[keep], partial[keep]
        live &= q_tags[rows, None] != tags[None, own]
        columns = np.flatnonzero(live.any(axis=0))
        if len(columns):
            score = exact_products(q[rows].astype(np.int64), c[own][columns].astype(np.int64))
            r, x = np.nonzero(live[:, columns] & (score >= best.least[rows, None]))
            if len(r):
                best.add(rows[r], at + columns[x], score[r, x])
    return best.best(ids, tags)


def _gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products of all vectors."""

    def add(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    def join(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            for g in b.column(0).to_pylist():
                total += np.frombuffer(g).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    parts = vectors.select("v").mapInArrow(add, "gram binary").repartition(16).mapInArrow(join, "gram binary")
    return sum((np.frombuffer(r.gram).reshape(dim, dim) for r in parts.collect()), np.zeros((dim, dim)))


def _blocks(rows: DataFrame, size: int, dim: int) -> DataFrame:
    """ids, nulls, tags, vectors (packed longs) and the largest length, of ``size`` rows each, lengths descending."""

    def pack(batches):
        held = []

        def out(part):
            ids, nulls, tags, lengths, vectors = part
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, nulls, tags, vectors)] + [pa.array([float(lengths.max())])], ["ids", "nulls", "tags", "vectors", "longest"])

        for b in batches:
            ids = b.column(0)
            held.append((ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3), dim)))
            if sum(len(h[0]) for h in held) >= size:
                part = [np.concatenate(x) for x in zip(*held)]
                n = len(part[0]) // size * size
                for at in range(0, n, size):
                    yield out([x[at : at + size] for x in part])
                held = [[x[n:] for x in part]]
        if held and sum(len(h[0]) for h in held):
            yield out([np.concatenate(x) for x in zip(*held)])

    return rows.select("id", "tag", "len", "v").mapInArrow(pack, "ids binary, nulls binary, tags binary, vectors binary, longest double")


def _open(r, dim: int) -> tuple[np.ndarray, ...]:
    return np.frombuffer(r["vectors"], np.int64).reshape(-1, dim), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nulls"], bool), np.frombuffer(r["tags"], np.int64)


def exact_topk(df: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row that ``is_query`` holds for."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query"), fine.alias("fine")).filter("fine")
    rows = rows.withColumn("v", F.transform("x", lambda e: F.floor(e * scale).cast("long"))).withColumn("tag", F.monotonically_increasing_id())
    rows = rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))
    rows = scratch.keep(rows.select("id", "tag", "len", "is_query", "v"), "rows")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    rotation = np.linalg.eigh(_gram(rows, dim))[1][:, ::-1].copy()
    n = shuffle_partitions(spark)
    head = [r.asDict() for r in rows.orderBy(F.desc("len"), "tag").limit(HEAD).select("id", "tag", "v").collect()]
    top = np.zeros((len(head), dim), np.int64)
    for i, r in enumerate(head):
        top[i, : len(r["v"])] = r["v"]
    sent = spark.sparkContext.broadcast((rotation, top, np.array([r["tag"] for r in head], np.int64)))
    candidates = _blocks(rows.repartitionByRange(n, F.desc("len")).sortWithinPartitions(F.desc("len")), BLOCK, dim)

    def thresholds(batches):
        """With each query's k-th score among the longest vectors, and the least of them."""
        _, top, tags = sent.value
        for b in batches:
            least, lowest = [], []
            for r in b.to_pylist():
                q, _, _, own = _open(r, dim)
                score = exact_products(q, top).astype(np.float64)
                score[own[:, None] == tags[None, :]] = LOW
                kth = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), LOW)
                least.append(kth.tobytes())
                lowest.append(float(kth.min()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.binary()), pa.array(lowest)], q_names)

    q_names = ["ids", "nulls", "tags", "vectors", "longest", "least", "lowest"]
    queries = _blocks(rows.filter("is_query"), QUERIES, dim).mapInArrow(thresholds, "ids binary, nulls binary, tags binary, vectors binary, longest double, least binary, lowest double")
    q = scratch.keep(queries, "queries").select(*(F.col(c).alias(f"q_{c}") for c in q_names))
    c = scratch.keep(candidates, "candidates")
    pairs = q.join(c, F.col("longest") * F.col("q_longest") * (1 + 1e-9) + 1e-6 >= F.col("q_lowest"))

    def run(batches):
        rotation = sent.value[0]
        for b in batches:
            for r in b.to_pylist():
                own, own_ids, own_nulls, own_tags = _open({x: r[f"q_{x}"] for x in q_names}, dim)
                vectors, ids, nulls, tags = _open(r, dim)
                i, j, score = search(own.astype(np.float64), own_tags, np.frombuffer(r["q_least"]), vectors.astype(np.float64), ids, tags, rotation, k) if max(np.abs(own).max(initial=0), np.abs(vectors).max(initial=0)) < EXACT else _plain(own, own_tags, vectors, ids, tags, k)
                yield pa.RecordBatch.from_arrays([pa.array(own_tags[i]), pa.array(own_ids[i], mask=own_nulls[i]), pa.array(tags[j]), pa.array(ids[j], mask=nulls[j]), pa.array(score)], ["q_tag", "query_id", "tag", "vec_id", "score"])

    found = pairs.mapInArrow(run, "q_tag long, query_id long, tag long, vec_id long, score long")
    order = Window.partitionBy("q_tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plain(q, q_tags, c, ids, tags, k):
    """For components that floating point doesn't hold: all exact products."""
    score = exact_products(q, c)
    best = Best(len(q), k, np.full(len(q), LOW))
    r, x = np.nonzero(q_tags[:, None] != tags[None, :])
    best.parts.append((r, x, score[r, x]))
    return best.best(ids, tags)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows of ``embeddings`` whose vec_id is divisible by 50, against all rows."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
