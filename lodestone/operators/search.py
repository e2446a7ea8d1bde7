"""Keyword, semantic and hybrid search with reranking over one or more collections.

Each collection is a leg with a top-k of its own; legs are united and cut once more, so no more than legs * k rows meet.
A leg that has a stored index reads the postings of the query's terms; its texts are not read, but for the few hits that are
reranked.  A leg that has a stored vector index reads the cells that can hold a hit.  Scores are rounded to six decimals before they are compared; every order ends with the object id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.text import bm25, bm25_from_postings, impact, terms_of, tokens
from lodestone.functions.vectors import cosine
from lodestone.operators.cells import VectorIndex, nearest
from lodestone.operators.filters import build_filter
from lodestone.operators.index import Index
from lodestone.runtime import Scratch, ship, shuffle_partitions

OVERFETCH = 3


@dataclass
class Leg:
    """A collection to search.

    ``df`` has the ``keys`` that name a row (object_id if nothing else is said), the properties that filters know, and what
    ``text``, ``object_id`` and ``rerank`` are made of.  ``vectors`` has the keys and a column vector, where vectors are
    not a column of ``df`` itself.
    """

    name: str
    df: DataFrame
    text: Column
    vector: str | None = None
    rerank: Column | None = None
    keys: list[str] = field(default_factory=lambda: ["object_id"])
    object_id: Column = field(default_factory=lambda: F.col("object_id"))
    index: Index | None = None
    vectors: DataFrame | None = None
    cells: VectorIndex | None = None


def _check(limit: int, alpha: float) -> None:
    if not 1 <= limit <= 100:
        raise ValueError("limit is from 1 to 100")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is from 0 to 1")


def _within(leg: Leg, rows: DataFrame, where: Column | None) -> DataFrame:
    """Rows (keys, ...) whose objects fulfil the condition."""
    return rows if where is None else rows.join(leg.df.filter(where).select(*leg.keys), leg.keys, "left_semi")


def keyword(leg: Leg, query: str, where: Column | None = None) -> DataFrame:
    """keys, score of the objects that have a term."""
    if leg.index is None:
        return bm25(leg.df, leg.text, query, leg.keys, where).withColumnRenamed("bm25", "score")
    return _within(leg, bm25_from_postings(leg.index.postings, leg.index.corpus, query, leg.keys), where).withColumnRenamed("bm25", "score")


#: Postings that the rarest terms of a query may have together to be scored first: this share of all of the query's, and this many for each hit at least.
FIRST_SHARE, FIRST_EACH = 0.05, 16
#: Blocks whose numbers reach the scan as literals; more are joined.
NEAR_BLOCKS = 2000


def keyword_top(leg: Leg, query: str, limit: int, where: Column | None = None, read: dict | None = None) -> DataFrame:
    """keys, score of rows among which the best ``limit`` of ``keyword`` are, with the same scores.

    The rarest terms are scored first.  The ``limit``-th best of these scores is a bound that no better row is below.  Of the
    other terms only blocks are read in which some row can still reach it: its score so far, or none, and the
    most that each of the other terms scores in that block.  Frequent terms, whose postings are nearly all that a query has, are
    mostly passed over.  ``read`` is told how many postings of the other terms there are and how many were read.
    """
    index, terms = leg.index, terms_of(query)
    if index is None or index.blocks is None or len(terms) < 2:
        return keyword(leg, query, where)
    own = index.blocks.filter(F.col("term").isin(terms))
    total = {r.term: r.n for r in own.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term
    corpus = index.corpus.first()
    order = sorted(total, key=lambda t: (total[t], t))
    most, first, used = max(FIRST_SHARE * sum(total.values()), FIRST_EACH * limit), [], 0
    for t in order:
        if first and used + total[t] > most:
            break
        first.append(t)
        used += total[t]
    rest = order[len(first) :]
    if not rest:
        return keyword(leg, query, where)
    weight = F.create_map(*(x for t in order for x in (F.lit(t), F.lit(math.log(1 + (corpus.n - total[t] + 0.5) / (total[t] + 0.5))))))
    posted = index.postings.withColumn("avgdl", F.lit(corpus.avgdl)).select("term", "block", *leg.keys, (weight[F.col("term")] * impact()).alias("part"))
    parts = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("part"))), F.lit(0.0)) for t in terms]
    scratch = Scratch(leg.df.sparkSession, "keyword_top")
    found = scratch.keep(_within(leg, posted.filter(F.col("term").isin(first)), where), "first")
    scores = found.groupBy("block", *leg.keys).agg(reduce(add, parts).alias("score"))
    bound = scores.select("score").orderBy(F.desc("score")).limit(limit).collect()
    if len(bound) < limit:
        return keyword(leg, query, where)
    least = bound[-1].score - 1e-6  # scores are compared after they have been rounded
    can = own.filter(F.col("term").isin(rest)).groupBy("block").agg(F.sum(weight[F.col("term")] * F.col("impact")).alias("can"), F.sum("n").alias("n"))
    so_far = scores.groupBy("block").agg(F.max("score").alias("has"))
    blocks = scratch.keep(can.join(so_far, "block", "left").filter(F.col("can") + F.coalesce("has", F.lit(0.0)) >= least).select("block", "n"), "blocks")
    n_blocks, n = blocks.agg(F.count("*"), F.sum("n")).first()
    if read is not None:
        read |= {"postings": sum(total[t] for t in rest), "read": n or 0}
    more = posted.filter(F.col("term").isin(rest))
    if n_blocks <= NEAR_BLOCKS:
        more = more.filter(F.col("block").isin([r.block for r in blocks.collect()]))
    else:
        more = more.join(blocks, "block", "left_semi")
    return found.unionByName(_within(leg, more, where)).groupBy(*leg.keys).agg(reduce(add, parts).alias("score"))


def semantic(leg: Leg, vector: DataFrame, where: Column | None = None) -> DataFrame:
    """keys, score of the objects that have a vector.  ``vector`` is one row with an array ``q``."""
    own = leg.df.select("*", F.col(leg.vector).alias("__v")) if leg.vectors is None else leg.vectors.withColumnRenamed("vector", "__v")
    own = (own if where is None else own.filter(where)) if leg.vectors is None else _within(leg, own.join(leg.df.select(*leg.keys), leg.keys, "left_semi"), where)
    return own.filter("__v IS NOT NULL").crossJoin(F.broadcast(vector)).select(*leg.keys, cosine(F.col("__v"), F.col("q")).alias("score"))


def semantic_top(leg: Leg, vector: DataFrame, limit: int, where: Column | None = None, read: dict | None = None) -> DataFrame:
    """keys, score of rows among which the best ``limit`` of ``semantic`` are, with the same scores: those of the cells that can hold one."""
    probe = vector.first() if leg.cells is not None else None
    if probe is None or probe.q is None:
        return semantic(leg, vector, where)
    among = leg.df.filter(where).select(*leg.keys) if where is not None else leg.df.select(*leg.keys) if leg.vectors is not None else None
    return nearest(leg.cells, list(probe.q), limit, among, read)


def hybrid(leg: Leg, query: str, vector: DataFrame, alpha: float = 0.5, where: Column | None = None) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword, each scaled from 0 to 1 over its own rows (constant ones: 1); what a side doesn't have scores 0 there.

    Both sides are scored once, into narrow tables, which give their extremes and then their rows.
    """
    scratch = Scratch(leg.df.sparkSession, "hybrid")
    sides = []
    for name, rows in (("k", keyword(leg, query, where)), ("v", semantic(leg, vector, where))):
        rows = scratch.keep(rows, name)
        low, high = rows.agg(F.min("score"), F.max("score")).first()
        scaled = F.lit(1.0) if low == high else (F.col("score") - F.lit(low)) / (F.lit(high) - F.lit(low))
        sides.append(rows.select(*leg.keys, scaled.alias(name)))
    both = sides[0].join(sides[1], leg.keys, "full")
    return both.select(*leg.keys, (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("k", F.lit(0.0))).alias("score"))


def overlap(query: str, text: Column) -> Column:
    """The deterministic second stage: Jaccard similarity of the query's tokens and a text's."""
    q = F.array(*(F.lit(t) for t in terms_of(query)))
    own = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    return F.size(F.array_intersect(q, own)) / F.size(F.array_union(q, own))


def top(hits: DataFrame, limit: int, leg: Leg | None = None) -> DataFrame:
    """The best ``limit`` of (keys, score), with object_id."""
    named = hits if leg is None else hits.withColumn("object_id", leg.object_id)
    return named.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "object_id").limit(limit)


def with_properties(leg: Leg, hits: DataFrame, **columns: Column) -> DataFrame:
    """Hits (at most some hundreds) with columns of their objects.  Their keys reach the scan as literals."""
    rows = hits.collect()
    found = hits.sparkSession.createDataFrame(rows, hits.schema)
    near = [F.col(k).isin([r[k] for r in rows]) for k in leg.keys]
    own = leg.df.filter(reduce(lambda a, b: a & b, near)).select(*leg.keys, *(c.alias(n) for n, c in columns.items()))
    return own.join(F.broadcast(found), leg.keys)


def search(legs: list[Leg], query: str, mode: str = "hybrid", limit: int = 10, alpha: float = 0.5, vector: DataFrame | None = None, rerank: bool = False, skipped: dict[str, str] | None = None, **conditions: str | None) -> DataFrame:
    """collection, object_id, score, rerank_score, place (from 1) of the best ``limit`` hits over all legs.

    A leg that is reranked fetches three times as many first.  Order: rerank score (legs without one last), score, order of
    legs, place in the leg.  A leg that can't be searched (a column that isn't there, no vectors) is left out and named in
    ``skipped`` with the reason; without ``skipped`` it raises, as does a search of which no leg is left.
    """
    _check(limit, alpha)
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"no search mode {mode!r}")
    out = []
    for n, leg in enumerate(legs):
        try:
            out.append(_leg_hits(leg, n, query, mode, limit, alpha, vector, rerank, conditions))
        except (AnalysisException, NotSearchable) as e:
            if skipped is None:
                raise
            skipped[leg.name] = str(e).split("\n")[0]
    if not out:
        raise ValueError(f"no collection could be searched: {skipped}")
    return merge(out, limit)


class NotSearchable(ValueError):
    """A leg lacks what a search mode needs."""


def _leg_hits(leg: Leg, n: int, query: str, mode: str, limit: int, alpha: float, vector: DataFrame | None, rerank: bool, conditions: dict[str, str | None]) -> DataFrame:
    if mode != "keyword" and (leg.vector is None and leg.vectors is None or vector is None):
        raise NotSearchable(f"{leg.name} has no vectors to search")
    where = build_filter(leg.df, **conditions)
    again = rerank and leg.rerank is not None
    fetched = limit * OVERFETCH if again else limit
    if mode == "keyword":
        hits = keyword_top(leg, query, fetched, where)
    elif mode == "semantic":
        hits = semantic_top(leg, vector, fetched, where)
    else:
        hits = hybrid(leg, query, vector, alpha, where)
    hits = top(hits, fetched, leg)
    score = F.lit(None).cast("double")
    if again:
        hits = with_properties(leg, hits, __r=leg.rerank)
        score = F.round(overlap(query, F.col("__r")), 6)
    hits = hits.select(F.lit(leg.name).alias("collection"), F.lit(n).alias("leg"), "object_id", "score", score.alias("rerank_score"))
    return hits.orderBy(F.desc_nulls_last("rerank_score"), F.desc("score"), "object_id").limit(limit)


def merge(legs: list[DataFrame], limit: int) -> DataFrame:
    """One ranking of all legs' hits."""
    rows = reduce(DataFrame.unionByName, legs)
    order = [F.coalesce("rerank_score", F.lit(-1.0)).desc(), F.desc("score"), F.asc("leg"), F.asc("object_id")]
    rows = rows.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order))  # over at most 100 rows
    return rows.withColumn("place", place).drop("leg")


def related(df: DataFrame, object_id: str, limit: int = 5, id_col: str = "object_id", vector_col: str = "vector", cells: VectorIndex | None = None) -> DataFrame:
    """The nearest other objects to one: id, score; with ``cells``, an index of the vectors by ``id_col``, from the cells that can hold one."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is from 1 to 50")
    q = df.filter(F.col(id_col).cast("string") == str(object_id)).select(F.col(vector_col).alias("q")).limit(1)
    probe = q.first() if cells is not None else None
    if probe is not None and probe.q is not None:
        found = nearest(cells, list(probe.q), limit + 1).filter(F.col(id_col).cast("string") != str(object_id))  # one more, as it may be itself
        return found.select(F.col(id_col).alias("object_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "object_id").limit(limit)
    rest = df.filter(F.col(id_col).cast("string") != str(object_id)).filter(F.col(vector_col).isNotNull())
    scored = rest.crossJoin(F.broadcast(q)).select(F.col(id_col).alias("object_id"), F.round(cosine(F.col(vector_col), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "object_id").limit(limit)


#: Bytes of vectors in a block of either side, about.
BLOCK = 32 << 20


def nearest_join(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """left_id, right_id, score, rank: the k nearest rows of ``right`` (id, vector) for each row of ``left``.

    Both sides are dealt into blocks of about ``BLOCK`` bytes, and every cell of a left and a right block is a task's work:
    rows of ``left`` go to a row of cells, those of ``right`` to a column.  A task holds one left block and sees the right one
    in Arrow batches, as products of matrices of unit vectors; it keeps the k best rows for each vector and nothing else, so
    no pairs are made as rows and nothing passes through the driver.  What the cells keep is ranked once more.  Ties go to
    the smaller id.  A null or zero vector scores 0 against all others, as does one of another length.
    """
    spark = left.sparkSession
    ship(spark)
    n_part = shuffle_partitions(spark)
    schema = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    across = _blocks(left, n_part)
    down = max(_blocks(right, n_part), -(-n_part // across))  # as many cells as tasks at least

    def side(df: DataFrame, number: int, own: int, others: int, cell) -> DataFrame:
        ids = [F.col("id") if number == i else F.lit(None) for i in (0, 1)]
        block = F.pmod(F.xxhash64("id", "vector"), F.lit(own))
        rows = df.select(F.lit(number).alias("side"), *(c.cast(f.dataType).alias(f.name) for c, f in zip(ids, schema)), F.col("vector").cast("array<double>").alias("vector"), block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))
        return rows.select(cell(F.col("own"), F.col("other")).cast("long").alias("cell"), "side", "left_id", "right_id", "vector")

    rows = side(left, 0, across, down, lambda own, other: own * down + other).unionByName(side(right, 1, down, across, lambda own, other: other * down + own))
    cells = rows.repartitionById(n_part, F.pmod(F.col("cell"), F.lit(n_part)).cast("int")).sortWithinPartitions("cell", "side", "right_id")
    kept = cells.mapInArrow(_nearest(k, schema.names), schema)
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(df: DataFrame, n_part: int) -> int:
    """Blocks for a frame by the size that Spark expects it to have; as many as tasks if it expects nothing."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n_part if size > 1 << 60 else max(1, -(-size // BLOCK))


def _unit(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of length 1; zeros for null and zero vectors and for those that don't have ``width`` components (default: the most there are)."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    width = width or int(sizes.max(initial=1)) or 1
    out = np.zeros((len(vectors), width))
    full = np.flatnonzero((sizes == width) & vectors.is_valid().to_numpy(zero_copy_only=False))
    out[full] = np.nan_to_num(vectors.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def _nearest(k: int, names: list[str]):
    """A mapInArrow function over rows sorted by cell, side and right id: the k best of a cell's right rows for each of its left rows."""

    def run(batches):
        now, ids, block, best, who = None, [], [], None, None

        def done():
            if best is not None and best.shape[1]:
                own, n = pa.concat_arrays(ids), best.shape[1]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(np.repeat(np.arange(len(own)), n))), pa.array(who.ravel(), kind), pa.array(best.ravel())], names)

        for b in batches:
            cell, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            kind = b.column(3).type
            cuts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0))
            for a, z in zip(cuts, [*cuts[1:], b.num_rows]):
                if cell[a] != now:
                    yield from done()
                    now, ids, block, best, who = cell[a], [], [], None, None
                if not side[a]:
                    ids.append(b.column(2).slice(a, z - a))
                    block.append(b.column(4).slice(a, z - a))
                    continue
                if not ids:
                    continue
                if best is None:
                    block = _unit(pa.concat_arrays(block))
                    best, who = np.zeros((len(block), 0)), np.zeros((len(block), 0), object)
                for at in range(a, z, 1024):
                    n = min(1024, z - at)
                    other = b.column(3).slice(at, n).to_numpy(zero_copy_only=False)
                    scores = np.round(block @ _unit(b.column(4).slice(at, n), block.shape[1]).T, 6) + 0.0
                    if n > k:  # the k best, ties to the first, as rows are in the order of their ids
                        step = np.round(scores * 1e6).astype(np.int64) * n + np.arange(n, 0, -1) - 1
                        pick = np.argpartition(-step, k - 1, axis=1)[:, :k]
                    else:
                        pick = np.broadcast_to(np.arange(n), scores.shape)
                    best = np.hstack([best, np.take_along_axis(scores, pick, 1)])
                    who = np.hstack([who, other[pick]]) if who.shape[1] else other[pick]
                    if best.shape[1] > k:
                        pick = np.lexsort((who, -best), axis=1)[:, :k]
                        best, who = np.take_along_axis(best, pick, 1), np.take_along_axis(who, pick, 1)
        yield from done()

    return run
