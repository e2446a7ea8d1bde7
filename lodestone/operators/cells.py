"""Stored vector indexes: unit vectors in cells around centres, so that a query reads near cells only and is still exact.

A unit vector v of a cell with centre c and radius r is at least |q - c| - r away from a unit vector q, and its cosine is
1 - |q - v|**2 / 2; so no row of a cell scores more than 1 - max(0, |q - c| - r)**2 / 2.  A query reads the cells with the
highest bounds first; their ``limit``-th best score then tells which of the other cells can hold a better row, and those
are read too.  Nothing is approximate: scores are computed from the vectors as they are, and cells are passed over by proof.

An index is two tables below the shared folder: rows (cell, keys, vector), sorted by cell over the whole table, so that Parquet
statistics lead a query to its cells; and cells (cell, n, centre, radius), of which there are ``MOST`` at most.  Centres are
vectors of a bounded sample of rows, moved to the means of what is near them; all rows are indexed.  Vectors that have no
direction (null or non-finite components, zero length, another number of components than most) are in cell -1, which is always read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vectors import cosine
from lodestone.operators.index import dealt, mark
from lodestone.runtime import ship, shared_dir, shuffle_partitions

#: Part of an index's name; to be raised when its tables change.
VERSION = 1
#: Cells at most (their centres are held by the driver and by each task), rows in a cell, about, and rows that centres are chosen from.
MOST, EACH, SAMPLE = 1024, 256, 16384
#: Scores are compared after they have been rounded to six decimals, and bounds are sums of rounded numbers.
SLACK = 2e-6


@dataclass
class VectorIndex:
    """Rows (cell, keys, vector) and the cells they are in."""

    rows: DataFrame
    cells: DataFrame
    keys: tuple[str, ...]


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):  # what overflows has no direction here
        size = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=(size > 1e-150) & np.isfinite(size))


def _centres(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of unit vectors: every so many-th of them, moved to the mean directions of those that are nearest, some rounds long."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def build(df: DataFrame, keys: tuple[str, ...], vector: str, path: str, each: int = EACH) -> VectorIndex:
    """Write an index of ``vector``; ``keys`` name a row.  Rows whose vector is null are not in it.

    ``df`` is read three times (its width and size, the sample, the rows); rows are shuffled once, by ranges of cells.
    """
    spark = df.sparkSession
    ship(spark)
    own = df.filter(F.col(vector).isNotNull()).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(vector).cast("array<double>").alias("vector"))
    width = own.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()  # one row
    total, width = (width[0]["count"], width[0].w) if width else (0, 0)
    right = own.filter((F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    picked = right.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()  # SAMPLE rows at most
    sample = _unit(np.array([r.vector for r in picked], float).reshape(-1, max(width, 1)))
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    n = min(MOST, max(1, total // each), len(sample))
    centres = _centres(sample, n) if n else np.zeros((0, max(width, 1)))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), *own.schema.fields])

    def deal(batches):
        for b in batches:
            vectors = b.column(b.num_columns - 1)
            cell, far = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for at in range(0, b.num_rows if len(centres) else 0, 4096):
                full = at + np.flatnonzero(sizes[at : at + 4096] == width)
                if not len(full):
                    continue
                v = vectors.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                v = _unit(v)
                good = np.isfinite(v).all(axis=1) & v.any(axis=1)
                v, full = v[good], full[good]
                if len(full):
                    near = np.argmax(v @ centres.T, axis=1)
                    cell[full], far[full] = near, np.linalg.norm(v - centres[near], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *b.columns], schema.names)

    placed = dealt(own).mapInArrow(deal, schema)
    kept = [f"k{i}" for i in range(len(keys))]
    placed.repartitionByRange(shuffle_partitions(spark), "cell", *kept).sortWithinPartitions("cell").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/rows")
    found = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each cell
    cells = [(r.cell, r.n, [float(x) for x in centres[r.cell]] if r.cell >= 0 else None, r.radius) for r in found]
    spark.createDataFrame(cells, "cell int, n long, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return opened(spark, keys, path)


def opened(spark, keys: tuple[str, ...], path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/rows")
    return VectorIndex(rows.select("cell", *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), F.col("vector").alias("__v")), spark.read.parquet(f"{path}/cells"), tuple(keys))


def stored(df: DataFrame, keys: tuple[str, ...], vector: str) -> VectorIndex:
    """The index of a column of ``df``, a plain scan of files; built if there is none for these files as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/vectors/{'-'.join(keys)}-{vector}-{VERSION}-{mark(df)}"
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        own = f"{path}.{uuid.uuid4().hex[:12]}"
        build(df, keys, vector, own)
        if not fs.rename(jvm.Path(own), at):  # someone else was first
            fs.delete(jvm.Path(own), True)
    return opened(spark, keys, path)


def bounds(index: VectorIndex, q: list[float]) -> list[tuple[float, int, int]]:
    """(most that a row can score, cell, n) of all cells, the highest first.

    Cell -1 and a query without a direction allow anything: such rows' scores follow other rules than the bound's.
    """
    told = index.cells.collect()  # MOST + 1 rows at most
    probe = np.array([math.nan if x is None else x for x in q], float)
    size = np.linalg.norm(probe)
    out = []
    for r in told:
        most = math.inf
        if r.cell >= 0 and np.isfinite(size) and size > 1e-150 and len(r.centre) == len(probe):
            away = max(0.0, float(np.linalg.norm(probe / size - np.array(r.centre))) - r.radius)
            most = 1 - away * away / 2
        out.append((most, r.cell, r.n))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def nearest(index: VectorIndex, q: list[float], limit: int, among: DataFrame | None = None, read: dict | None = None) -> DataFrame:
    """keys, score of rows among which the ``limit`` nearest to ``q`` are, with the scores of a full scan.

    ``among`` (keys) says which rows take part.  ``read`` is told how many cells and rows there are and how many were read.
    """
    spark = index.rows.sparkSession
    order = bounds(index, q)
    probe = F.array(*(F.lit(None if x is None else float(x)).cast("double") for x in q))

    def scored(cells: list[int]) -> DataFrame:
        own = index.rows.filter(F.col("cell").isin(cells))
        own = own if among is None else own.join(among.select(*index.keys), list(index.keys), "left_semi")
        return own.select(*index.keys, cosine(F.col("__v"), probe).alias("score"))

    first, held = [], 0
    for most, cell, n in order:
        if held >= limit and most < math.inf:
            break
        first.append(cell)
        held += n if most < math.inf else 0
    best = scored(first).select("score").orderBy(F.desc("score")).limit(limit).collect() if first else []  # limit rows
    least = best[-1].score - SLACK if len(best) == limit else -math.inf
    near = [(cell, n) for most, cell, n in order if cell in set(first) or most >= least]
    if read is not None:
        read |= {"cells": len(order), "rows": sum(n for *_, n in order), "read_cells": len(near), "read_rows": sum(n for _, n in near)}
    if not near:
        return spark.createDataFrame([], T.StructType([*(index.rows.schema[k] for k in index.keys), T.StructField("score", T.DoubleType())]))
    return scored([cell for cell, _ in near])
