"""Files, projects, contracts and schemas: SURVEY A9-A13, A20, A21, A24, A25, B14, B19, D6, D11, D12, D19, E12, E15, E18, J."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import json_schema as js
from lodestone.functions.nested import properties_json
from lodestone.plans.registry import query, sql_values, values
from lodestone.plans.search_queries import CONTENTS
from lodestone.runtime import Scratch
from lodestone.sources import files
from lodestone.sources.tables import contents, table

NAMES = ["b.md", "a.txt", "c.exe", "d.pdf", "e.mp4", "notes/x.md"]


def _folder(spark):
    root = Scratch(spark, "files").root
    for n in NAMES:
        files.put_text(spark, f"{root}/{n}", f"text of {n}")
    return root


@query("SELECT * FROM (VALUES ('a.txt', 13::BIGINT, 'text/plain'), ('b.md', 12, 'text/markdown'), ('d.pdf', 13, 'application/pdf')) x(name, length, mime)")
def directory_scan(spark, d):
    """Supported extensions, sorted, capped."""
    from lodestone.functions.scalars import basename

    return files.scan_directory(spark, _folder(spark), files.CONTENT).select(basename(F.col("path")).alias("name"), "length", "mime")


@query("SELECT * FROM (VALUES ('e.mp4', 'video/mp4')) x(name, mime)")
def video_scan(spark, d):
    """A11."""
    from lodestone.functions.scalars import basename

    return files.scan_directory(spark, _folder(spark), files.VIDEOS).select(basename(F.col("path")).alias("name"), "mime")


@query("SELECT * FROM (VALUES (0::BIGINT, 'd.pdf'), (2, 'a.txt')) x(n, name)")
def listed_scan(spark, d):
    """A10: the caller's order; other extensions are dropped."""
    from lodestone.functions.scalars import basename

    root = _folder(spark)
    return files.scan_paths(spark, [f"{root}/{n}" for n in ("d.pdf", "c.exe", "a.txt")], files.CONTENT).select("n", basename(F.col("path")).alias("name"))


@query("SELECT 'b.md' AS name, 'text of b.md' AS body, substr(sha256('text of b.md'), 1, 16) AS hash")
def whole_file_read(spark, d):
    """A12, H11."""
    from lodestone.functions.scalars import basename

    own = files.scan_directory(spark, _folder(spark), ["md"], "b*", content=True)
    return own.select(basename(F.col("path")).alias("name"), F.col("content").cast("string").alias("body"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"))


LISTING = [("p1", "script/script.json"), ("p1", "output/final.mp4"), ("p2", "readme.md"), (".hidden", "script/script.json"), ("p1", "script/script.json")]
STEPS = sql_values(*((i, s, f) for i, (s, f) in enumerate(files.PROJECT_STEPS)))
STATUS = f"WITH l(project, file) AS ({sql_values(*LISTING)}), s(n, step, file) AS ({STEPS}), st AS (SELECT project, n, step, EXISTS (SELECT 1 FROM l x WHERE x.project = p.project AND x.file = s.file) AS completed FROM (SELECT DISTINCT project FROM l WHERE NOT starts_with(project, '.')) p, s)"


@query(f"{STATUS} SELECT * FROM st")
def project_status(spark, d):
    """A20."""
    return files.project_status(values(spark, "project string, file string", *LISTING))


@query(f"{STATUS} SELECT project, count(*) FILTER (completed) AS completed_steps, count(*) AS steps, bool_or(step = 'render' AND completed) AS rendered FROM st GROUP BY 1")
def project_list(spark, d):
    """A21, E12."""
    return files.project_list(project_status(spark, d))


TOOLS = [("b_tool", True, 2), ("a_tool", False, 1)]


@query(f"SELECT name, '{{\"read_only\":' || ro || ',\"arguments\":' || n || '}}' AS contract FROM ({sql_values(*TOOLS)}) x(name, ro, n)")
def tool_contracts(spark, d):
    """A25."""
    t = values(spark, "name string, read_only boolean, arguments int", *TOOLS)
    return t.select("name", F.to_json(F.struct("read_only", "arguments")).alias("contract")).orderBy("name")


ENTRIES = ['{"query": "a", "n": 1}', "broken", '{"query": "b", "n": "x"}', '{"query": "c"}']


@query("SELECT 2::BIGINT AS inserted, 2::BIGINT AS failed")
def bulk_entries(spark, d):
    """Entries of a file, those that fit and those that don't."""
    root = Scratch(spark, "entries").root
    files.put_text(spark, f"{root}/e.json", "\n".join(ENTRIES))
    own = files.read_entries(spark, f"{root}/e.json", "query string, n int").cache()
    return own.agg(F.count_if(F.col("_corrupt_record").isNull()).alias("inserted"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("failed"))


@query(f"WITH {CONTENTS} SELECT doc_id, '{{\"category\":\"' || category || '\",\"created_at\":\"' || strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00\"}}' AS properties FROM contents")
def property_json(spark, d):
    """Properties as JSON with ISO dates, secrets dropped."""
    own = contents(spark, d).withColumn("secret", F.lit("x")).drop("secret")
    return own.select("doc_id", properties_json(own, ["category", "created_at"]).alias("properties"))


QUERIES = [("how do I learn this video",), ("a paper on graphs",), ("anything",)]


@query(f"SELECT q, CASE WHEN contains(lower(q), 'video') THEN 'VideoAnalyses' WHEN contains(lower(q), 'paper') THEN 'ResearchFindings' ELSE 'all' END AS scope FROM ({sql_values(*QUERIES)}) x(q)")
def keyword_scope(spark, d):
    """A query's words choose the collections."""
    q = values(spark, "q string", *QUERIES)
    low = F.lower("q")
    return q.select("q", F.when(low.contains("video"), "VideoAnalyses").when(low.contains("paper"), "ResearchFindings").otherwise("all").alias("scope"))


SCHEMAS = [({"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"enum": ["x", "y", "z"]}}}}}}, 3, 3, 3), ({"type": "string"}, 0, 0, 0), ({"type": "object", "properties": {}}, 0, 0, 0)]


@query(f"SELECT s AS schema, dep AS depth, p AS properties, e AS enum FROM ({sql_values(*((json.dumps(s), a, b, c) for s, a, b, c in SCHEMAS))}) x(s, dep, p, e)")
def schema_complexity(spark, d):
    """Depth, properties and largest enum of a caller's schema."""
    own = values(spark, "schema string", *((json.dumps(s),) for s, *_ in SCHEMAS))
    return js.measure_schemas(own.withColumn("text", F.col("schema")), "schema", "text")


@query("""WITH k AS (SELECT user_id, event_type, count(DISTINCT props->>'$.k') AS n FROM events GROUP BY ALL)
SELECT user_id, 3 AS depth, (2 * count(*))::INTEGER AS properties, max(n)::INTEGER AS enum FROM k GROUP BY 1""")
def event_schema_complexity(spark, d):
    """A schema of what each user's events hold, by type an array of objects with an enum, measured as a caller's would be."""
    k = F.get_json_object("props", "$.k")
    types = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set(k)).alias("enum"))  # distinct values
    one = F.struct(F.lit("array").alias("type"), F.struct(F.lit("object").alias("type"), F.struct(F.struct("enum").alias("k")).alias("properties")).alias("items"))
    schemas = types.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", one))).alias("properties"))
    return js.measure_schemas(schemas.select("user_id", F.to_json(F.struct(F.lit("object").alias("type"), "properties")).alias("schema")), "user_id", "schema")


@query("""WITH l AS (SELECT l_orderkey, list({'number': l_linenumber, 'part': l_partkey, 'shipped': strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S'),
  'state': {'flag': l_returnflag, 'seen': [strftime(l_shipdate, '%Y-%m-%d'), NULL]}} ORDER BY l_linenumber, l_partkey, l_shipdate, l_returnflag) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, to_json({'status': o_orderstatus, 'ordered': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00', 'lines': lines})::VARCHAR AS properties FROM orders JOIN l ON l_orderkey = o_orderkey""")
def nested_properties(spark, d):
    """Orders with their lines, three levels with dates and times in each; what is secret goes wherever it is."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"), F.struct(F.col("l_returnflag").alias("flag"), F.array(F.col("l_shipdate").cast("date"), F.lit(None)).alias("seen"), F.lit("x").alias("secret")).alias("state"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # an order's lines
    own = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ordered"), "lines")
    return own.select("o_orderkey", properties_json(own, ["status", "ordered", "lines"], frozenset({"secret"})).alias("properties"))


NESTED = [("r1", [["a", "b"], ["c"]]), ("r2", [[]]), ("r3", [["d"]])]


@query(f"SELECT r, flatten(f) AS findings FROM ({sql_values(*NESTED)}) x(r, f)")
def flatten_findings(spark, d):
    """E15."""
    return values(spark, "r string, f array<array<string>>", *NESTED).select("r", F.flatten("f").alias("findings"))


@query("SELECT doc_id, n_chars, text IS NOT NULL AS fits FROM documents")
def schema_driven_extract(spark, d):
    """J (content_extract): JSON texts by a caller's schema."""
    own = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("n_chars"), "lang")).alias("t"))
    out = js.extract(own, "t", {"type": "object", "properties": {"n_chars": {"type": "integer"}, "lang": {"type": "string"}}})
    return out.select("doc_id", F.col("data.n_chars").alias("n_chars"), (F.col("error") == "").alias("fits"))
