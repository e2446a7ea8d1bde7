"""JSON Schema: a complexity guard, and conversion to Spark types for schema-driven extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.runtime import Scratch

MAX_DEPTH, MAX_PROPERTIES, MAX_ENUM = 5, 50, 20
SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


#: Where a schema holds others: by name (one level down), for elements (one level down), side by side (same level).
ALTERNATIVES = ("allOf", "anyOf", "oneOf")


def measure(schema) -> tuple[int, int, int]:
    """(depth of nesting, properties in all, largest enum) over properties, items and alternatives; what is no object has none."""
    if not isinstance(schema, dict):
        return 0, 0, 0
    own = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
    down = [*own.values(), *([schema["items"]] if isinstance(schema.get("items"), dict) else [])]
    beside = [s for k in ALTERNATIVES if isinstance(schema.get(k), list) for s in schema[k]]
    below, level = [measure(s) for s in down], [measure(s) for s in beside]
    depth = max([1 + d for d, *_ in below] + [d for d, *_ in level], default=0)
    enum = len(schema["enum"]) if isinstance(schema.get("enum"), list) else 0
    return depth, len(own) + sum(n for _, n, _ in below + level), max([enum, *(e for *_, e in below + level)])


def measure_schemas(df: DataFrame, key: str, schema: str) -> DataFrame:
    """key, depth, properties, enum of schemas kept as JSON texts, one row for each of ``df``: nulls where a text isn't JSON.

    Schemas are variants that are walked level by level, all of them at once; a level's nodes are a table, so the walk has
    as many steps as the deepest schema has levels, and no Python runs on rows.
    """
    scratch = Scratch(df.sparkSession, "schemas")
    rows = scratch.keep(df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.try_parse_json(schema).alias("node")), "rows")
    own = "map<string,variant>"
    named = F.map_values(F.try_variant_get("node", "$.properties", own))
    items = F.try_variant_get("node", "$.items", own)

    def nodes(values: Column, down: int) -> Column:
        return F.coalesce(F.transform(values, lambda v: F.struct(v.alias("node"), F.lit(down).alias("down"))), F.array().cast("array<struct<node:variant,down:int>>"))

    held = [nodes(named, 1), nodes(F.when(items.isNotNull(), F.array(F.try_variant_get("node", "$.items", "variant"))), 1), *(nodes(F.try_variant_get("node", f"$.{k}", "array<variant>"), 0) for k in ALTERNATIVES)]
    level, told, n = rows.filter("node IS NOT NULL").select("row", "node", F.lit(0).alias("depth")), [], 0
    while True:
        size = F.coalesce(F.size(F.try_variant_get("node", "$.enum", "array<variant>")), F.lit(0))
        told.append(level.select("row", "depth", F.coalesce(F.size(named), F.lit(0)).alias("properties"), F.greatest(size, F.lit(0)).alias("enum")))
        below = level.select("row", "depth", F.explode(F.concat(*held)).alias("n")).select("row", F.col("n.node").alias("node"), (F.col("depth") + F.col("n.down")).alias("depth"))
        level, n = scratch.keep(below, f"level{n}"), n + 1
        if level.isEmpty():
            break
    sums = reduce(DataFrame.unionByName, told).groupBy("row").agg(F.max("depth").alias("depth"), F.sum("properties").cast("int").alias("properties"), F.max("enum").alias("enum"))
    return rows.select("key", "row").join(sums, "row", "left").select(F.col("key").alias(key), "depth", "properties", "enum")


def guard(schema: dict) -> None:
    """Raises where a caller's schema is too complex."""
    for what, value, most in zip(("depth", "properties", "enum values"), measure(schema), (MAX_DEPTH, MAX_PROPERTIES, MAX_ENUM)):
        if value > most:
            raise ValueError(f"the schema has {value} {what}; {most} are allowed")


def spark_type(schema: dict) -> T.DataType:
    kind = schema.get("type", "string")
    if kind == "object":
        own = schema.get("properties")
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in own.items()]) if own else T.MapType(T.StringType(), T.StringType())
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {})))
    return SCALARS.get(kind, T.StringType())


def extract(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """``df`` with ``data`` (null where the text doesn't fit) and ``error``."""
    guard(schema)
    kind = spark_type(schema)
    if not isinstance(kind, T.StructType):
        raise ValueError("the schema's top is an object with properties")
    full = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    own = df.withColumn("data", F.from_json(column, full, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("data").isNull() | F.col("data._corrupt").isNotNull()
    return own.withColumn("error", F.when(bad, "not valid JSON for the schema").otherwise("")).withColumn("data", F.when(~bad, F.col("data").dropFields("_corrupt")))
