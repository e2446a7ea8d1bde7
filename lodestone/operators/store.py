"""Mutations: appends, upserts by deterministic id, edges, folds and schema evolution.

Plain Parquet has no MERGE, so an upsert unites old and new rows, keeps the last write of each id by a struct maximum
(which is combined before the shuffle, so a hot id costs one row a task), and writes a new version folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schema
from lodestone.functions.scalars import uuid5


def last_write_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the one with the largest ``order``.  A replaced row keeps nothing of the old one."""
    rest = [c for c in rows.columns if c not in keys]
    first = [*order, *(c for c in rest if c not in order)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*first), F.struct(*order)).alias("__b"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "object_id") -> DataFrame:
    """``new`` (unique keys) replaces rows of ``old`` or adds to them."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns)


def delete_prefix(df: DataFrame, column: str, content_id: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go): those whose name begins with the id and an underscore; all without an id."""
    gone = F.lit(True) if content_id is None else F.col(column).startswith(content_id + "_")
    return df.filter(~gone), df.filter(gone)


def fetch(df: DataFrame, object_id: str, key: str = "object_id") -> DataFrame:
    """One row: found, and the object's columns (null if there is none)."""
    asked = df.sparkSession.createDataFrame([(object_id,)], f"__asked {dict(df.dtypes)[key]}")
    found = asked.join(df.filter(F.col(key) == F.lit(object_id)).limit(1), F.col("__asked") == F.col(key), "left")
    return found.select(F.col(key).isNotNull().alias("found"), *df.columns)


def unknown_properties(given: Column, collection: str) -> Column:
    """Names in an array that the collection doesn't have, sorted."""
    return F.array_sort(F.array_except(given, F.array(*(F.lit(p.name) for p in schema.properties(collection)))))


def validate(rows: list[dict], collection: str) -> None:
    """Names only, as an ingest does; raises with the allowed names and types."""
    allowed = {p.name: p.type for p in schema.properties(collection)}
    bad = sorted({k for r in rows for k in r} - set(allowed))
    if bad:
        raise ValueError(f"unknown properties {bad}; {collection} has {', '.join(f'{k}:{v}' for k, v in allowed.items())}")


def report_rows(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parent and child rows, edges) of reports with an array of findings.

    ``reports``: report_key, topic, scope, executive_summary, findings array<struct<claim, evidence_tier, reasoning>>.
    """
    parent_id = uuid5(F.concat(F.lit("report:"), F.col("report_key")))
    parent = reports.select(parent_id.alias("object_id"), "topic", "scope", F.lit("").alias("claim"), F.lit("").alias("evidence_tier"), F.lit("").alias("reasoning"), "executive_summary", F.lit("").alias("report_uuid"))
    child = reports.select(parent_id.alias("report_uuid"), "report_key", "topic", "scope", F.posexplode("findings").alias("n", "f"))
    child = child.select(uuid5(F.concat(F.lit("finding:"), F.col("report_key"), F.lit(":"), F.col("n").cast("string"))).alias("object_id"), "topic", "scope", F.col("f.claim").alias("claim"), F.col("f.evidence_tier").alias("evidence_tier"), F.col("f.reasoning").alias("reasoning"), F.lit("").alias("executive_summary"), "report_uuid")
    edges = child.select(F.lit("ResearchFindings").alias("from_collection"), F.col("object_id").alias("from_id"), F.lit("belongs_to_report").alias("ref_name"), F.lit("ResearchFindings").alias("to_collection"), F.col("report_uuid").alias("to_id"))
    return parent.unionByName(child), edges


def resolve(rows: DataFrame, edges: DataFrame, targets: DataFrame, ref: str, key: str = "object_id") -> DataFrame:
    """``rows`` with an array of the targets that exist, in order; dangling edges are passed over."""
    own = edges.filter(F.col("ref_name") == ref).join(targets.select(F.col(key).alias("to_id")), "to_id", "left_semi")
    own = own.groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias(ref))
    return rows.join(own, rows[key] == own["from_id"], "left").drop("from_id").withColumn(ref, F.coalesce(ref, F.array().cast("array<string>")))


def dangling(edges: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Edges (source, target) with an end that is no node: source, target, side.  Empty ids count only if ``strict``."""
    out = None
    for side in ("source", "target"):
        bad = edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti")
        if not strict:
            bad = bad.filter(F.coalesce(side, F.lit("")) != "")
        bad = bad.select("source", "target", F.lit(side).alias("side"))
        out = bad if out is None else out.unionByName(bad)
    return out


def missing(desired: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """What a schema still lacks."""
    return desired.join(existing.select(*on), list(on), "left_anti")


def fold_appends(base: DataFrame, items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``base`` (key, values array) with the ordered new values behind the old ones."""
    new = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("__new"))
    empty = F.array().cast(base.schema["values"].dataType)
    return base.join(new, key, "left").select(key, F.concat(F.coalesce("values", empty), F.coalesce("__new", empty)).alias("values"))


class CollectionStore:
    """A folder for each collection, and one for edges.  One writer at a time.

    A collection is its last version (v1, v2, ...) and what was appended to that (v2-a1, v2-a2, ...), each a Parquet folder
    that counts once its marker is there.  Appends write new rows only; upserts, deletes and rebuilds write a new version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self, name: str) -> tuple[int, list[int]]:
        """(last version or 0, numbers of what was appended to it)."""
        fs, p = self._path(f"{self.root}/{name}")
        if not fs.exists(p):
            return 0, []
        whole = [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(self._path(f"{self.root}/{name}/{n}/_SUCCESS")[1])]
        found = [(int(v), int(a or 0)) for v, a in (n.removeprefix("v").split("-a") if "-a" in n else (n.removeprefix("v"), "") for n in whole)]
        last = max((v for v, _ in found), default=0)
        return last, sorted(a for v, a in found if v == last and a)

    def schema_of(self, name: str) -> T.StructType:
        return schema.struct(name) if name in schema.COLLECTIONS else T._parse_datatype_string(schema.EDGE_SCHEMA)

    def _folders(self, name: str) -> list[str]:
        last, appended = self._parts(name)
        base = f"{self.root}/{name}/v{last}"
        return [base] * (last > 0) + [f"{base}-a{n}" for n in appended]

    def read(self, name: str) -> DataFrame:
        """All rows; properties that a file lacks are null."""
        folders, own = self._folders(name), self.schema_of(name)
        return self.spark.read.schema(own).parquet(*folders) if folders else self.spark.createDataFrame([], own)

    def create(self, name: str) -> list[str]:
        """Make the collection if it isn't there; the properties that what is there lacks, which are null from now on."""
        folders = self._folders(name)
        if not folders:
            self._write(name, self.spark.createDataFrame([], self.schema_of(name)))
            return []
        have = self.spark.read.option("mergeSchema", True).parquet(*folders).columns
        return [f for f in self.schema_of(name).fieldNames() if f not in have]

    def _write(self, name: str, df: DataFrame) -> None:
        df.select(*self.schema_of(name).fieldNames()).write.mode("overwrite").parquet(f"{self.root}/{name}/v{self._parts(name)[0] + 1}")

    def _fit(self, name: str, df: DataFrame) -> DataFrame:
        own = self.schema_of(name)
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own))

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Rows get random ids and, where they have none, the time of writing; returns them as written.  Nothing else is touched."""
        own = self._fit(name, df)
        if name in schema.COLLECTIONS:
            own = own.withColumn("object_id", F.coalesce("object_id", F.uuid())).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        last, appended = self._parts(name)
        if not last and not appended:
            path = f"{self.root}/{name}/v1"
        else:
            path = f"{self.root}/{name}/v{last}-a{max(appended, default=0) + 1}"
        own.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema_of(name)).parquet(path)

    def ingest(self, name: str, df: DataFrame) -> DataFrame:
        """``append`` of rows whose columns are all properties of the collection; raises with the allowed names and types."""
        validate([dict.fromkeys(df.columns)], name)
        return self.append(name, df)

    def append_edges(self, edges: DataFrame) -> DataFrame:
        """Concept edges: texts that are missing are empty, a missing type is related_to, a missing tool video_analyze."""
        default = {"source_tool": "video_analyze", "relationship_type": "related_to"}
        names = ("source_tool", "from_concept", "to_concept", "relationship_type", "source_url", "source_category")
        given = lambda c: F.col(c).cast("string") if c in edges.columns else F.lit(None).cast("string")
        return self.append("RelationshipEdges", edges.select(*(F.coalesce(given(c), F.lit(default.get(c, ""))).alias(c) for c in names)))

    def upsert(self, name: str, df: DataFrame, key: Column, order: Column | None = None) -> None:
        """Rows get the id of their ``key``; an empty key gets a random one.  Of rows with the same id the one with the largest
        ``order`` counts; without one, the last as ``df`` comes, which only says something of a frame in a definite order."""
        named = df.withColumn("object_id", F.when(F.coalesce(key, F.lit("")) == "", F.uuid()).otherwise(uuid5(key)))
        named = named.withColumn("__n", F.struct((F.lit(0) if order is None else order).alias("o"), F.monotonically_increasing_id().alias("i")))
        own = self._fit(name, last_write_wins(named, ["object_id"], ["__n"]))
        own = own.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        self._write(name, upsert(self.read(name), own))

    def delete(self, name: str, ids: list[str]) -> int:
        old = self.read(name)
        gone = old.filter(F.col("object_id").isin(ids)).count()
        if gone:
            self._write(name, old.filter(~F.col("object_id").isin(ids)))
        return gone

    def link(self, edges: DataFrame) -> None:
        """Edges that aren't there yet are appended."""
        own = self._fit("edges", edges).distinct()
        self.append("edges", own.join(self.read("edges"), own.columns, "left_anti"))

    def export(self, name: str) -> DataFrame:
        """Every object with an array of ids for each reference of its collection."""
        out, edges = self.read(name), self.read("edges")
        for source, ref, target in schema.REFERENCES:
            if source == name:
                out = resolve(out, edges.filter(F.col("from_collection") == name), self.read(target), ref)
        return out

    def rebuild(self, name: str, change) -> None:
        """Write a new version from the last one by a function of DataFrames (a new vectorization, say)."""
        self._write(name, self._fit(name, change(self.read(name))))
