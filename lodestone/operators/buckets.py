"""A table whose rows lie in folders by hash bucket of their id: an upsert or a delete rewrites the buckets it touches only.

Which buckets those are is known from the ids alone; old rows of other buckets are neither read nor written, and a point
lookup reads one bucket.  A bucket's new files are staged beside the old ones and take their place when the job commits
(dynamic partition overwrite), so a failed or repeated job leaves whole buckets; one that fails while it commits may leave
some buckets new and others old, and running it again ends that, as upserts and deletes of the same rows do no harm twice.
One writer at a time.

Ids are unique in the table; a null id is an id like any other.  Of new rows with the same id the one with the
largest ``order`` counts, of equals the largest row.  Empty batches change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.store import last_write_wins
from lodestone.runtime import Scratch

BUCKETS = 64


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.column = "bucket"
        while self.column in schema.fieldNames():
            self.column += "_"

    def _of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _rows(self) -> DataFrame:
        """All rows with their bucket, which prunes folders."""
        own = T.StructType([*self.schema.fields, T.StructField(self.column, T.IntegerType())])
        fs, p = self._fs(self.path)
        return self.spark.read.schema(own).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], own)

    def read(self) -> DataFrame:
        return self._rows().drop(self.column)

    def fetch(self, key) -> DataFrame:
        """The row of one id, from its bucket."""
        asked = F.lit(key)
        return self._rows().filter((F.col(self.column) == self._of(asked)) & F.col(self.key).eqNullSafe(asked)).drop(self.column)

    def _replace(self, new: DataFrame, gone: DataFrame, scratch: Scratch) -> list[int]:
        """Write the buckets of ``gone`` (key, bucket) anew: old rows but those, and ``new``.  Returns the buckets."""
        touched = sorted(r[0] for r in gone.select(self.column).distinct().collect())  # a number for each bucket at most
        if touched:
            old = self._rows().filter(F.col(self.column).isin(touched))
            keys = gone.select(F.col(self.key).alias("__k"), F.lit(True).alias("__gone")).distinct()
            stays = old.join(keys, old[self.key].eqNullSafe(keys["__k"]), "left_anti")
            rows = scratch.keep(stays.unionByName(new), "rows")
            left = {r[0] for r in rows.select(self.column).distinct().collect()}
            dealt = rows.hint("rebalance", self.column)  # a large bucket is split
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column).parquet(self.path)
            for b in touched:
                if b not in left:  # an overwrite leaves folders alone for which it has no rows
                    fs, p = self._fs(f"{self.path}/{self.column}={b}")
                    fs.delete(p, True)
            scratch.drop("rows")
        return touched

    def upsert(self, df: DataFrame, order: Sequence[str] = ()) -> list[int]:
        """Rows of ``df`` replace those with their id or add to them; the buckets that were written."""
        scratch = Scratch(self.spark, "buckets")
        own = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
        rest = [c for c in own.columns if c != self.key and not c.startswith("__o")]
        best = last_write_wins(own, [self.key], [*(f"__o{i}" for i in range(len(order))), *rest]) if rest or order else own.distinct()
        new = scratch.keep(best.select(*self.schema.fieldNames(), self._of(F.col(self.key)).alias(self.column)), "new")
        return self._replace(new, new.select(self.key, self.column), scratch)

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows whose id is in the column of that name go; the buckets that were written."""
        scratch = Scratch(self.spark, "buckets")
        gone = scratch.keep(keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).distinct().withColumn(self.column, self._of(F.col(self.key))), "gone")
        return self._replace(self._rows().limit(0), gone, scratch)
