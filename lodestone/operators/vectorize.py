"""Vectors made by the engine: hashed token counts of a collection's vectorized properties, stored beside it in versions.

The vectorizer stands in for a remote one.  A token's slot comes from its MD5, so other systems can recompute it.  A version is a folder with
the vectors' index of cells; it counts once its marker, written last, is there.  That one file is the switch: searches
read the version before until then, and a run that is lost half-way leaves a folder that nobody reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions.text import tokens
from lodestone.functions.vectors import DIMENSIONS, norm
from lodestone.operators import cells, search
from lodestone.operators.store import CollectionStore

MARKER = "_WHOLE"


def slot(token: Column, dimensions: int) -> Column:
    """The component that a token counts in: the first 28 bits of its MD5, modulo."""
    return (F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % dimensions).cast("int")


def hashed_vectors(df: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, vector (length 1; zeros for a text without tokens, null or empty) of rows with unique keys.

    Tokens are counted where they are read; one narrow row for each key and task is shuffled, however long its text is.
    """
    own = df.select(F.col(key).alias("key"), F.explode_outer(tokens(F.coalesce(text, F.lit("")))).alias("token"))
    at = own.select("key", slot(F.col("token"), dimensions).alias("slot"))
    counts = at.groupBy("key").agg(*(F.count_if(F.col("slot") == i).alias(f"c{i}") for i in range(dimensions)))
    vector = counts.select(F.col("key").alias(key), F.array(*(F.col(f"c{i}").cast("double") for i in range(dimensions))).alias("counts")).withColumn("size", norm(F.col("counts")))
    return vector.select(key, F.transform("counts", lambda c: F.when(F.col("size") > 0, c / F.col("size")).otherwise(0.0)).alias("vector"))


def query_vector(spark: SparkSession, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row with the vector of a query, ``q``."""
    return hashed_vectors(spark.createDataFrame([(0, text)], "id int, text string"), "id", F.col("text"), dimensions).select(F.col("vector").alias("q"))


def _versions(store: CollectionStore, name: str) -> list[tuple[int, int, bool]]:
    """(number, dimensions, whole) of all versions of a collection's vectors."""
    fs, p = store._path(f"{store.root}/{name}.vectors")
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((*map(int, n[1:].split("-")), fs.exists(store._path(f"{store.root}/{name}.vectors/{n}/{MARKER}")[1])) for n in found)


def revectorize(store: CollectionStore, name: str, dimensions: int = DIMENSIONS) -> int:
    """Make the vectors of all objects anew and switch to them; the number of the version.  Objects and edges stay as they are."""
    number = max((n for n, *_ in _versions(store, name)), default=0) + 1
    path = f"{store.root}/{name}.vectors/v{number}-{dimensions}"
    made = hashed_vectors(store.read(name).select("object_id", schema.search_text(name, vectorized=True).alias("text")), "object_id", F.col("text"), dimensions)
    made.write.mode("overwrite").parquet(f"{path}/made")
    cells.build(store.spark.read.parquet(f"{path}/made"), ("object_id",), "vector", path)
    fs, at = store._path(f"{path}/made")
    fs.delete(at, True)  # the index has them
    fs.create(store._path(f"{path}/{MARKER}")[1]).close()
    return number


def vectors_of(store: CollectionStore, name: str) -> tuple[cells.VectorIndex, int]:
    """(index, dimensions) of the last whole version; raises where there is none."""
    whole = [(n, d) for n, d, ready in _versions(store, name) if ready]
    if not whole:
        raise search.NotSearchable(f"{name} has no vectors to search")
    number, dimensions = whole[-1]
    return cells.opened(store.spark, ("object_id",), f"{store.root}/{name}.vectors/v{number}-{dimensions}"), dimensions


def near_text(store: CollectionStore, name: str, text: str, limit: int, where: Column | None = None, read: dict | None = None) -> DataFrame:
    """object_id, score of the ``limit`` objects whose vectors are nearest to the text's."""
    index, dimensions = vectors_of(store, name)
    leg = search.Leg(name, store.read(name), schema.search_text(name), cells=index)
    return search.top(search.semantic_top(leg, query_vector(store.spark, text, dimensions), limit, where, read), limit)
