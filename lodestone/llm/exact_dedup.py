"""Exact dedup with two-pass Bloom filtering.

The first pass reads every whole text once, writes a digest row for each document, and fills a Bloom filter
of the hashes that possibly occur twice.  The second pass holds the digest rows against that filter: those
that it names are shuffled by digest, all others pass straight through as groups of one.  No text is shuffled:
``exact_dedup`` drops rows by their place, where they are read (a frame that does more than read files is written first).

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty.  Of
equal texts the row with most code points in the original stays, then the smallest id (a null id last); of rows
that agree in all of that, one.  An empty table gives an empty result.  Only ``id_col`` and ``text_col`` are read,
so further columns may have any names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._rows import SPACE, keep_rows, place, placed
from lodestone.llm._workers import kept
from lodestone.llm.bloom import RepeatedFilter, filter_bits, repeated_filter
from lodestone.runtime import Scratch


def _digests(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, digest (SHA-256 of the text without white space), n_chars, h (the digest's first 8 bytes), more."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), text.alias("text"), *more)
    schema = T.StructType([own.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("n_chars", T.LongType()), T.StructField("h", T.LongType()), *own.schema.fields[2:]])

    def digest(batches):
        kept("exact")
        sha = hashlib.sha256
        for b in batches:
            text = b.column(1)
            out = [sha(x.translate(None, SPACE)).digest() for x in text.cast(pa.binary()).to_pylist()]
            h = [int.from_bytes(x[:8], "little", signed=True) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pc.utf8_length(text).cast(pa.int64()), pa.array(h, pa.int64()), *b.columns[2:]], schema.names)

    return own.mapInArrow(digest, schema)


def _groups(df: DataFrame, id_col: str, text_col: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass straight through, rows in groups with the columns best and n)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(_digests(df, id_col, text_col, *more), "digests").withColumn("row", F.monotonically_increasing_id())
    bits = filter_bits(digests.count())
    sent = spark.sparkContext.broadcast(repeated_filter(digests, "h", bits))

    def flag(batches):
        seen = RepeatedFilter(sent.value, bits)
        at = names.index("h")
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seen.maybe(b.column(at).to_numpy(zero_copy_only=False)))], [*names, "maybe"])

    names = digests.columns
    flagged = scratch.keep(digests.mapInArrow(flag, T.StructType([*digests.schema, T.StructField("maybe", T.BooleanType())])), "flagged")
    scratch.drop("digests")
    rows = flagged.filter("maybe")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("null"), "id", "row")
    groups = scratch.keep(rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("n")), "groups")
    return flagged.filter("NOT maybe"), rows.join(groups, "digest")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id_col, keep_id, group_size, kept, text_sha256."""
    single, grouped = _groups(df, id_col, text_col)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    a = single.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    b = grouped.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), sha)
    return a.unionByName(b)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row left of each group of equal texts."""
    scratch = Scratch(df.sparkSession, "exact_drop")
    df = placed(df, scratch)
    _, grouped = _groups(df, id_col, text_col, place(df).alias("place"))
    return keep_rows(df, grouped.filter(F.col("row") != F.col("best.row")), scratch)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT sha256(norm) AS text_sha256, min_by(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(norm) AS text_sha256 FROM d) JOIN g USING (text_sha256)
"""
