"""Stored keyword indexes: a corpus is tokenised once, and every query reads the postings of its own terms only.

An index is three tables below the shared folder: postings (term, block, keys, tf, dl), sorted by term and block over the whole
table, so that Parquet statistics lead a query to its terms; blocks (term, block, n, impact), which tell how many postings a
term has in a block of about ``BLOCK`` texts and the most that one of them can score but for the term's weight; and a row with
the number of texts that have a token and their mean length.  It is named by what the corpus's files are (paths, sizes, times of change); a corpus that has changed gets a new one.  It is
written under a name of its own and renamed when whole, so a lost or second builder does no harm.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import impact, postings
from lodestone.runtime import shared_dir, shuffle_partitions

#: Part of an index's name; to be raised when tokens or tables change.
VERSION = 2
#: Texts in a block, about.  All terms have the same blocks.
BLOCK = 128


@dataclass
class Index:
    """Postings with the corpus's one row of n and avgdl."""

    postings: DataFrame
    corpus: DataFrame
    keys: tuple[str, ...]
    blocks: DataFrame | None = None


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where it has fewer (one small file, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def build(df: DataFrame, keys: tuple[str, ...], text: Column | str, path: str) -> Index:
    """Write an index of ``text``; ``keys`` name a row.  Two shuffles of narrow rows, counted before each."""
    spark = df.sparkSession
    own = dealt(df.select(*keys, (F.col(text) if isinstance(text, str) else text).alias("__text")))
    block = F.pmod(F.xxhash64(*keys), F.lit(-(-df.count() // BLOCK) or 1)).cast("int")
    table = postings(own, list(keys), "__text").select("term", block.alias("block"), *keys, "tf", "dl")
    table.repartitionByRange(shuffle_partitions(spark), "term", "block", *keys).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy(*keys).agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/corpus")
    scored = stored.crossJoin(F.broadcast(spark.read.parquet(f"{path}/corpus").select("avgdl")))  # one row
    blocks = scored.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(impact()).alias("impact"))
    blocks.repartitionByRange(shuffle_partitions(spark), "term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    return opened(spark, keys, path)


def opened(spark, keys: tuple[str, ...], path: str) -> Index:
    postings, corpus, blocks = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "corpus", "blocks"))
    return Index(postings, corpus, tuple(keys), blocks)


def mark(df: DataFrame) -> str:
    """A name for the state of the files that ``df``, a plain scan, reads; their status tells it, no job runs."""
    spark = df.sparkSession
    files, fs = [], None
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = fs or path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(path)
        files.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return f"{len(files)}-{sha256(chr(10).join(files).encode()).hexdigest()[:16]}"


def stored(df: DataFrame, keys: tuple[str, ...], text: str) -> Index:
    """The index of a column of ``df``, a plain scan of files; built if there is none for these files as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/indexes/{text}-{VERSION}-{mark(df)}"
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        own = f"{path}.{uuid.uuid4().hex[:12]}"
        build(df, keys, text, own)
        if not fs.rename(jvm.Path(own), at):  # someone else was first
            fs.delete(jvm.Path(own), True)
    return opened(spark, keys, path)
