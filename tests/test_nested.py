"""Nested values as JSON and schemas measured in variants, against plain Python."""

import base64
import datetime as dt
import io
import json
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import json_schema as js
from lodestone.functions.nested import json_safe, properties_json

DDL = (
    "n int, day date, at timestamp, ntz timestamp_ntz, raw binary, secret string,"
    " inner struct<day:date, list:array<struct<at:timestamp, secret:string, more:array<array<date>>>>, by:map<string,timestamp_ntz>>,"
    " days:map<date,struct<day:date>>, plain:array<struct<a:int>>, gone:struct<secret:string>"
)


@pytest.fixture(scope="module")
def kind(spark):
    return T.StructType.fromDDL(DDL)


def slow(x, drop=("secret",)):
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(bytes(x)).decode()
    if isinstance(x, dict):
        own = {slow(k): slow(v) for k, v in x.items() if k not in drop}
        return {k: v for k, v in own.items() if v is not None}
    if isinstance(x, list):
        return [slow(v) for v in x]
    return x


def row(r):
    zone = dt.timezone.utc
    day = lambda: r.choice([None, dt.date(r.randrange(1900, 2100), 2, r.randrange(1, 29))])
    time = lambda z=None: r.choice([None, dt.datetime(2024, 3, r.randrange(1, 29), r.randrange(24), 5, 9, r.choice([0, 1000, 123456]), z)])
    element = lambda: {"at": time(zone), "secret": "s", "more": r.choice([None, [], [[day(), day()], []]])}
    inner = {"day": day(), "list": r.choice([None, [], [element(), element()], [None, element()]]), "by": {"a": time() or dt.datetime(2024, 1, 1)}}
    return {"n": r.choice([None, 3]), "day": day(), "at": time(zone), "ntz": time(), "raw": r.choice([None, b"", b"\x00\xff"]), "secret": "s", "inner": r.choice([None, inner]), "days": r.choice([None, {dt.date(2020, 1, 2): {"day": day()}}]), "plain": [{"a": 1}], "gone": {"secret": "s"}}


def test_against_plain_python(spark, kind):
    r = random.Random(4)
    rows = [row(r) for _ in range(200)] + [dict.fromkeys(kind.names)]
    df = spark.createDataFrame(rows, kind)
    got = [json.loads(x.j) for x in df.select(properties_json(df, df.columns, frozenset({"secret"})).alias("j")).collect()]

    def cut(x):  # the struct of which nothing is left is null, and nulls are left out
        return {k: v for k, v in slow(x).items() if k != "gone"}

    assert got == [cut(x) for x in rows]


def test_plain_columns_stay_and_no_python_runs(spark, kind):
    df = spark.createDataFrame([], kind)
    assert df.select(json_safe(F.col("plain"), kind["plain"].dataType)).schema[0].dataType == kind["plain"].dataType
    out = io.StringIO()
    with redirect_stdout(out):
        df.select(properties_json(df, df.columns)).explain()
    assert "Python" not in out.getvalue()


def test_names_with_dots(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), 1)], "`a.b` date, `c d` int")
    assert df.select(properties_json(df, df.columns).alias("j")).first().j == '{"a.b":"2024-01-02","c d":1}'


def schema(r, deep):
    own = {"type": r.choice(["object", "array", "string"])}
    if r.random() < 0.3:
        own["enum"] = list(range(r.randrange(30)))
    if deep:
        if r.random() < 0.6:
            own["properties"] = {f"p{i}": schema(r, deep - 1) for i in range(r.randrange(4))}
        if r.random() < 0.4:
            own["items"] = r.choice([schema(r, deep - 1), [schema(r, 1)], True, None])
        for k in js.ALTERNATIVES:
            if r.random() < 0.2:
                own[k] = [schema(r, deep - 1), "x"]
        own["additionalProperties"] = {"properties": {"not": {}, "counted": {}}}
    return own


def test_schemas(spark):
    r = random.Random(8)
    own = [schema(r, r.randrange(5)) for _ in range(150)] + [{}, [], 3, None, {"properties": []}, {"enum": 4}, {"properties": {"properties": {"enum": [1]}}}]
    texts = [json.dumps(s) for s in own]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, "{no json"), (901, None), (902, "")], "row int, node string")
    got = {x.row: (x.depth, x.properties, x.enum) for x in js.measure_schemas(df, "row", "node").collect()}
    assert got == {i: js.measure(s) for i, s in enumerate(own)} | dict.fromkeys((900, 901, 902), (None, None, None))
    assert js.measure(own[-1]) == (1, 1, 1)
    assert js.measure({"items": {"items": {}}, "anyOf": [{"properties": {"a": {}, "b": {}}}]}) == (2, 2, 0)


def test_no_schemas(spark):
    assert js.measure_schemas(spark.createDataFrame([], "k int, s string"), "k", "s").collect() == []
