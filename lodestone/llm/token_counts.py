"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so they are kept by adding signed deltas: an insert adds a
document's counts, a delete takes them away, and a revised count does both at once.  A batch of deltas is summed up by
key in the tasks that read it, written to a folder named by its batch id, and committed by the marker that Spark's
file committer writes last.  Committing an id again changes nothing, whether the first attempt was lost before its
marker (it is then written anew) or not.  ``compact`` folds committed batches into one snapshot that remembers their ids.

A null source, language or text is a key or a text like any other: nulls form groups of their own, a null text has no
tokens.  Repeated rows count as often as they occur.  Keys whose documents and tokens have come to zero are left out of
the totals.  An empty batch commits without a change.  Only the columns named in the arguments are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._workers import kept
from lodestone.llm.packing import word_ids
from lodestone.llm.pieces import library_model
from lodestone.llm.wordcache import parts, split_words
from lodestone.runtime import Scratch, ship

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"

#: Tokenizer versions: kind of tokenizer by name, see ``counter``.
WORD, PIECE = "word_bpe", "piece_bpe"


def counter(kind: str, path: str):
    """A column of texts -> numbers of tokens."""
    if kind == WORD:
        cache = word_ids(path)
        return lambda texts: cache.counts(split_words(texts)).tolist()
    if kind == PIECE:
        memos = kept("words")
        if (kind, path) not in memos:
            memos[kind, path] = library_model(path)
        return memos[kind, path].count_column
    raise ValueError(f"no tokenizer {kind!r}")


def deltas(df: DataFrame, tokenizers: dict[str, tuple[str, str]], sign: int | Column = 1, extra: int = 0, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Signed counts of ``df``, summed up in each task: one row for each key that a task has met.

    ``tokenizers`` maps a version to (kind, file).  ``sign`` is 1 for inserts, -1 for deletes, or a column of numbers;
    ``extra`` tokens are added to each document's count (an end mark, say).
    """
    ship(df.sparkSession)
    number = sign if isinstance(sign, Column) else F.lit(sign)
    own = df.select(*(F.col(c).cast("string") for c in (source_col, lang_col, text_col)), number.cast("long").alias("sign"))

    def run(batches):
        count = {v: counter(*how) for v, how in tokenizers.items()}
        docs, tokens = defaultdict(int), defaultdict(int)
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in (0, 1, 3)))
            for texts in parts(b.column(2)):
                found = {v: f(texts) for v, f in count.items()}
                for i, (source, lang, n) in enumerate(islice(keys, len(texts))):
                    for v in count:
                        docs[source, lang, v] += n
                        tokens[source, lang, v] += n * (found[v][i] + extra)
        if docs:
            keys = list(docs)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*keys)), pa.array([docs[k] for k in keys], pa.int64()), pa.array([tokens[k] for k in keys], pa.int64())], [*KEYS, "documents", "tokens"])

    return own.mapInArrow(run, DELTAS)


def revisions(before: DataFrame, after: DataFrame, tokenizers: dict[str, tuple[str, str]], **how) -> DataFrame:
    """Deltas that turn the counts of ``before`` into those of ``after``."""
    return deltas(before, tokenizers, -1, **how).unionByName(deltas(after, tokenizers, 1, **how))


class TokenRollup:
    """The rollup in a folder.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        """Committed entries of a folder."""
        fs, p = self._fs(f"{self.root}/{folder}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.root}/{folder}/{n}/_SUCCESS")[1]))

    def _snapshot(self) -> str | None:
        return max(self._names("snapshots"), key=int, default=None)

    def folded(self) -> set[str]:
        """Batch ids in the snapshot."""
        now = self._snapshot()
        if now is None:
            return set()
        return {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.root}/folded/{now}").collect()}

    def committed(self) -> set[str]:
        return self.folded() | set(self._names("batches"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it is in already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch_id):
            raise ValueError(f"a batch id has letters, digits, dots and dashes: {batch_id!r}")
        if batch_id in self.committed():
            return False
        changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.root}/batches/{batch_id}")
        return True

    def _parts(self) -> tuple[DataFrame, list[str]]:
        now, old = self._snapshot(), self.folded()
        new = [b for b in self._names("batches") if b not in old]
        paths = [f"{self.root}/batches/{b}" for b in new] + ([f"{self.root}/snapshots/{now}"] if now is not None else [])
        if not paths:
            return self.spark.createDataFrame([], DELTAS), new
        return self.spark.read.schema(DELTAS).parquet(*paths), new

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        rows, _ = self._parts()
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; a crash at any point loses and doubles nothing."""
        _, new = self._parts()
        if not new:
            return
        n = int(self._snapshot() or 0) + 1
        ids = self.spark.createDataFrame([(b,) for b in sorted(self.folded() | set(new))], "batch string")
        ids.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folded/{n}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/snapshots/{n}")  # its marker makes the snapshot valid
        for b in new:
            fs, p = self._fs(f"{self.root}/batches/{b}")
            fs.delete(p, True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of ``documents`` for two tokenizer versions, with one token more for each document (an end mark).

    They come about as those of a living corpus do: French documents are first inserted as stubs of one line; the batch comes
    again, which changes nothing; short documents are inserted a second time by a further batch, and deleted again; the
    stubs are revised to whole documents; and all counts are revised to include the end mark."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = {"word_bpe_49k@1": (WORD, public_tokenizers.path("word_bpe_49k.json")), "piece_bpe_32k@1": (PIECE, public_tokenizers.path("piece_bpe_32k.model"))}
    rollup = TokenRollup(spark, Scratch(spark, "token_counts").root)
    stub = F.col("lang").eqNullSafe("fr")
    line = F.substring_index("text", "\n", 1)
    short = docs.filter("n_chars < 300")
    whole = docs.filter(stub)
    first = deltas(docs.withColumn("text", F.when(stub, line).otherwise(F.col("text"))), versions)
    rollup.commit("insert-1", first)
    rollup.commit("insert-1", first)
    rollup.commit("insert-2", deltas(short, versions))
    rollup.commit("delete-2", deltas(short, versions, -1))
    rollup.commit("revise-1", revisions(whole.withColumn("text", line), whole, versions))
    marks = rollup.totals().select(*KEYS, F.lit(0).cast("long").alias("documents"), F.col("documents").alias("tokens"))
    rollup.commit("revise-2", marks)
    return rollup.totals()
