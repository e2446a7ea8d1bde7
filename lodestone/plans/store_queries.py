"""Counts, lookups, mutations, references: SURVEY A1-A8, B3-B15, C1-C15, E1-E16, F18, G3-G7."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone import schema
from lodestone.functions.scalars import uuid5
from lodestone.operators import joins, stats, store
from lodestone.operators.buckets import BucketedTable
from lodestone.plans.registry import query, sql_values, values
from lodestone.plans.search_queries import CONTENTS, UUID5
from lodestone.runtime import Scratch
from lodestone.sources.tables import contents, first_line, table, transcripts, web_pages


@query("SELECT 'ContentAnalyses' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'SessionTranscripts', count(*) FROM conversations UNION ALL SELECT 'WebSearchResults', count(*) FROM pages UNION ALL SELECT '(total)', (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM pages)")
def stats_counts(spark, d):
    """E1, E3."""
    return stats.counts({"ContentAnalyses": table(spark, d, "documents"), "SessionTranscripts": transcripts(spark, d), "WebSearchResults": web_pages(spark, d)})


@query(f"WITH {CONTENTS} SELECT coalesce(evidence_tier, '(empty)') AS value, count(*) AS n FROM contents GROUP BY 1")
def stats_grouped(spark, d):
    """Rows without a label make the group '(empty)'."""
    return stats.grouped(contents(spark, d), "evidence_tier")


@query("SELECT NULL::VARCHAR AS value, NULL::BIGINT AS n WHERE false")
def stats_grouped_unknown_property(spark, d):
    """A property that isn't there gives no groups."""
    return stats.grouped(contents(spark, d), "no_such_property")


TIERS = sql_values(*((t,) for t in schema.EVIDENCE_TIERS))


@query(f"WITH {CONTENTS}, t(value) AS ({TIERS}) SELECT value, count(evidence_tier) AS n FROM t LEFT JOIN contents ON evidence_tier = value GROUP BY 1")
def tier_histogram(spark, d):
    """All five tiers, zero-filled."""
    return stats.histogram(contents(spark, d), "evidence_tier", schema.EVIDENCE_TIERS)


RISKS = [("s1", "install", "high"), ("s2", "install", "low"), ("s3", "upgrade", "critical"), ("s4", "upgrade", "high"), ("s5", "uninstall", "medium"), ("s6", "config_merge", "medium")]


@query(f"WITH r(id, category, risk) AS ({sql_values(*RISKS)}) SELECT 'category' AS dimension, category AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'risk', risk, count(*) FROM r GROUP BY 2")
def risk_counts(spark, d):
    """Both groupings in one pass by grouping sets."""
    r = values(spark, "id string, category string, risk string", *RISKS)
    both = r.groupingSets([["category"], ["risk"]], "category", "risk").agg(F.count("*").alias("n"), F.grouping("category").alias("g"))
    return both.select(F.when(F.col("g") == 0, "category").otherwise("risk").alias("dimension"), F.when(F.col("g") == 0, F.col("category")).otherwise(F.col("risk")).alias("value"), "n")


@query("SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (starts_with(event_type, 'p')) AS p_types FROM events")
def batch_tally(spark, d):
    """E5, E10, E11."""
    e = F.col("event_type")
    return stats.tally(table(spark, d, "events"), {"failed": e == "error", "passed": e != "error", "p_types": e.startswith("p")})


@query("SELECT count(*) AS files, round(sum(n_chars) / 1048576.0, 2) AS total_mb FROM documents")
def cache_storage(spark, d):
    """E4."""
    return stats.storage(table(spark, d, "documents"), "n_chars")


@query(f"WITH {CONTENTS} SELECT true AS found, object_id, title, source_tool FROM contents WHERE doc_id = 17")
def fetch_by_id_hit(spark, d):
    """A2."""
    own = contents(spark, d)
    object_id = spark.range(1).select(uuid5(F.lit("doc:17"))).first()[0]
    return store.fetch(own.select("object_id", "title", "source_tool"), object_id)


@query("SELECT false AS found, NULL::VARCHAR AS object_id, NULL::VARCHAR AS title")
def fetch_by_id_miss(spark, d):
    """A2: a miss is a row, not an error."""
    return store.fetch(contents(spark, d).select("object_id", "title"), "no such id")


CATALOG = [(c, i, p.name, p.type, p.vectorized, p.searchable, p.ranged) for c in schema.COLLECTIONS for i, p in enumerate(schema.properties(c))]


@query(f"SELECT c AS collection, n AS position, p AS property, t AS type, v AS vectorized, s AS searchable, r AS ranged FROM ({sql_values(*CATALOG)}) x(c, n, p, t, v, s, r)")
def schema_catalog(spark, d):
    """F18, D20."""
    return schema.catalog(spark)


GIVEN = [("WebSearchResults", ["query", "response", "score"]), ("WebSearchResults", ["query"]), ("WebSearchResults", ["zz", "aa", "aa"])]


@query(f"""SELECT c AS collection, g AS given, list_sort(list_distinct(list_filter(g, lambda x: NOT list_contains(['created_at', 'updated_at', 'source_tool', 'query', 'response', 'sources_json'], x)))) AS unknown FROM ({sql_values(*GIVEN)}) x(c, g)""")
def ingest_unknown_properties(spark, d):
    """G3, B2."""
    g = values(spark, "collection string, given array<string>", *GIVEN)
    return g.withColumn("unknown", store.unknown_properties(F.col("given"), "WebSearchResults"))


@query(f"WITH {CONTENTS} SELECT doc_id, object_id FROM contents")
def object_ids_uuid5(spark, d):
    """H21."""
    return contents(spark, d).select("doc_id", "object_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(spark, d):
    """The last write of each key."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.last_write_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN -1.0 ELSE value END AS value FROM events")
def upsert_merge(spark, d):
    """Rows of a batch replace old ones or add to them."""
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    new = e.filter("event_type IN ('error', 'signup')").withColumn("value", F.lit(-1.0))
    return store.upsert(e.filter("event_type <> 'signup'"), new, "event_id").drop("event_type")


@query("""SELECT 'doc:' || doc_id AS object_id, CASE WHEN quality = 1 THEN 'reviewed: ' ELSE '' END || split_part(text, chr(10), 1) AS title, lang, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS writes
FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1""")
def upsert_and_read_back(spark, d):
    """B5-B8, B12, B13, J video_analyze: documents are upserted, those of good quality once more with another title, toxic ones are deleted; the table as it is then."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    named = docs.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("object_id"), F.substring_index("text", "\n", 1).alias("title"), "lang")
    t = BucketedTable(spark, f"{Scratch(spark, 'bucketed').root}/table", T.StructType().add("object_id", "string").add("title", "string").add("lang", "string").add("writes", "integer"), "object_id")
    t.upsert(named.withColumn("writes", F.lit(1)))
    good = named.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    t.upsert(good.withColumn("title", F.concat(F.lit("reviewed: "), F.coalesce("title", F.lit("")))).withColumn("writes", F.lit(2)))
    t.delete(labels.filter("toxic = 1").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("object_id")))
    return t.read()


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, last_value(event_id) OVER w AS last, last_value(event_type) OVER w AS kind, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hops
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN kind <> 'error' THEN last END AS "end", CASE WHEN kind <> 'error' THEN hops END AS hops, kind = 'error' AS cycle FROM e""")
def event_chains(spark, d):
    """Each event leads to its user's next one, the last one of a user nowhere, but an error back to the user's first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "event_type", F.lead("event_id").over(w).alias("after"), F.first("event_id").over(w).alias("first"))
    links = e.select(F.col("event_id").alias("id"), F.when(F.col("after").isNull() & (F.col("event_type") == "error"), F.col("first")).otherwise(F.col("after")).alias("next"))
    return joins.chain_ends(links).withColumnRenamed("id", "event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def delete_rows(spark, d):
    """B13."""
    e = table(spark, d, "events")
    return store.delete(e, e.filter("event_type = 'error'"), "event_id").select("event_id")


FILES = [("vid1_analyze_default_abc.json",), ("vid12_analyze_default_abc.json",), ("vid1_x.json",), ("other.json",)]


@query(f"SELECT f AS file FROM ({sql_values(*FILES)}) x(f) WHERE NOT starts_with(f, 'vid1_')")
def cache_clear_prefix(spark, d):
    """vid1 doesn't clear vid12."""
    return store.delete_prefix(values(spark, "file string", *FILES), "file", "vid1")[0]


REPORTS = """
r AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS claim, lang FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)),
p AS (SELECT doc_id, {p} AS parent FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('report:' || doc_id)) AS h FROM documents)),
c AS (SELECT doc_id, n, claim, lang, {p} AS child FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('finding:' || doc_id || ':' || n)) AS h FROM r))
""".format(p=UUID5.format(h="h"))


def _reports(spark, d):
    """Every document as a report, its lines as findings."""
    docs = table(spark, d, "documents")
    findings = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("claim"), F.col("lang").alias("evidence_tier"), F.lit("").alias("reasoning")))
    return docs.select(F.col("doc_id").cast("string").alias("report_key"), F.concat(F.lit("topic of "), F.col("doc_id").cast("string")).alias("topic"), F.lit("quick").alias("scope"), F.lit("sum").alias("executive_summary"), findings.alias("findings"))


@query(f"WITH {REPORTS} SELECT parent AS object_id, 'topic of ' || doc_id AS topic, '' AS claim, '' AS evidence_tier, '' AS report_uuid FROM p UNION ALL SELECT child, 'topic of ' || doc_id, claim, lang, parent FROM c JOIN p USING (doc_id)")
def report_parent_child(spark, d):
    """One parent row and a row for each finding, which names its parent."""
    return store.report_rows(_reports(spark, d))[0].select("object_id", "topic", "claim", "evidence_tier", "report_uuid")


@query(f"WITH {REPORTS} SELECT child AS object_id, [parent] AS belongs_to_report FROM c JOIN p USING (doc_id) UNION ALL SELECT parent, []::VARCHAR[] FROM p")
def edges_resolved(spark, d):
    """References as arrays of ids."""
    rows, edges = store.report_rows(_reports(spark, d))
    return store.resolve(rows.select("object_id"), edges, rows, "belongs_to_report")


NODES, EDGES = [("a",), ("b",), ("c",)], [("a", "b"), ("a", "x"), ("y", "b"), ("", "c"), (None, "a"), ("z", "w")]


@query(f"WITH n(id) AS ({sql_values(*NODES)}), e(source, target) AS ({sql_values(*EDGES)}) SELECT source, target, 'source' AS side FROM e WHERE coalesce(source, '') <> '' AND source NOT IN (SELECT id FROM n) UNION ALL SELECT source, target, 'target' FROM e WHERE coalesce(target, '') <> '' AND target NOT IN (SELECT id FROM n)")
def edges_dangling(spark, d):
    """Empty ids are passed over."""
    return store.dangling(values(spark, "source string, target string", *EDGES), values(spark, "id string", *NODES))


@query(f"WITH n(id) AS ({sql_values(*NODES)}), e(source, target) AS ({sql_values(*EDGES)}) SELECT source, target, 'source' AS side FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE id = source) UNION ALL SELECT source, target, 'target' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE id = target)")
def edges_dangling_strict(spark, d):
    """A missing id counts too."""
    return store.dangling(values(spark, "source string, target string", *EDGES), values(spark, "id string", *NODES), strict=True)


@query(f"""WITH {CONTENTS}, t AS (SELECT DISTINCT object_id AS b, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: len(x) > 6)) AS item FROM contents)
SELECT item, a, b FROM (SELECT item, min(b) OVER (PARTITION BY item) AS a, b FROM t) WHERE a < b""")
def concept_shared_pairs(spark, d):
    """C14: objects whose titles share long words, as a star for each word."""
    return joins.shared_items(_title_words(spark, d), "object_id", "words")


def _title_words(spark, d):
    """The same from documents alone: a left join to labels adds no object, but would shuffle whole texts."""
    from lodestone.functions.text import tokens

    own = uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("object_id")
    return table(spark, d, "documents").select(own, F.filter(tokens(first_line()), lambda w: F.length(w) > 6).alias("words"))


LONG_WORDS = f"{CONTENTS}, t AS (SELECT DISTINCT object_id AS a, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: len(x) > 6)) AS w FROM contents)"


@query(f"WITH {LONG_WORDS} SELECT w AS item, min(a) OVER (PARTITION BY w) AS representative, a AS object_id FROM t")
def concept_shared_members(spark, d):
    """C14 without loss and without pairs: every object of every long word."""
    return joins.shared_members(_title_words(spark, d), "object_id", "words")


@query(f"WITH {LONG_WORDS} SELECT x.a AS a, y.a AS b, count(*) AS n FROM t x JOIN t y ON x.w = y.w AND x.a < y.a GROUP BY 1, 2")
def concept_shared_all_pairs(spark, d):
    """C14: all pairs of objects whose titles share long words."""
    return joins.shared_pairs(joins.held_items(_title_words(spark, d), "object_id", "words"), "object_id")


HAVE = [("WebSearchResults", "query"), ("WebSearchResults", "created_at"), ("WebSearchResults", "old")]


@query(f"SELECT p AS property FROM ({sql_values(*HAVE)}) x(c, p) RIGHT JOIN (VALUES ('created_at'), ('updated_at'), ('source_tool'), ('query'), ('response'), ('sources_json')) y(q) ON p = q WHERE p IS NULL".replace("SELECT p AS", "SELECT q AS"))
def schema_evolution_missing(spark, d):
    """Properties that a stored table still lacks."""
    return store.missing(schema.catalog(spark, "WebSearchResults"), values(spark, "collection string, property string", *HAVE), ["collection", "property"]).select("property")


@query("SELECT conv_id, list(text ORDER BY turn)[1:1] AS report, list('turn:' || conv_id || ':' || turn ORDER BY turn)[2:] AS follow_up_ids, list(text ORDER BY turn)[2:] AS follow_ups FROM conversations GROUP BY 1")
def followup_fold(spark, d):
    """Ids and texts of all later turns are put behind each conversation's first one, in order."""
    c = table(spark, d, "conversations").withColumn("id", F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    first = c.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f"))
    later = c.join(first, "conv_id").filter("turn > f.turn").select("conv_id", "turn", "id", "text")
    none = first.select("conv_id", F.array().cast("array<string>").alias("values"))
    ids, texts = (store.fold_appends(none, later, "conv_id", "turn", v).withColumnRenamed("values", n) for v, n in (("id", "follow_up_ids"), ("text", "follow_ups")))
    return first.select("conv_id", F.array("f.text").alias("report")).join(ids, "conv_id").join(texts, "conv_id")


@query("SELECT conv_id, list(text ORDER BY turn, text) AS values FROM conversations GROUP BY 1")
def followup_fold_all(spark, d):
    """All later turns are put behind each conversation's first one, in order."""
    c = table(spark, d, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.min("turn").alias("first")), "conv_id")
    base = c.filter("turn = first").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("values"))
    return store.fold_appends(base, c.filter("turn > first"), "conv_id", "turn", "text")


SHIPPED, PRESENT, NOTED = [("a", "1"), ("b", "2"), ("c", "2"), ("d", "2"), ("n", "1")], [("b", "2"), ("c", "1"), ("d", "9"), ("o", "1"), ("u", "8"), ("x", "1"), ("n", "7")], [("b", "2"), ("c", "1"), ("d", "1"), ("o", "1"), ("u", "1"), ("g", "1")]


@query(f"""WITH s(path, s) AS ({sql_values(*SHIPPED)}), i(path, d) AS ({sql_values(*PRESENT)}), m(path, m) AS ({sql_values(*NOTED)})
SELECT path, CASE WHEN s IS NULL AND m IS NOT NULL THEN CASE WHEN d IS NULL THEN 'gone' WHEN d = m THEN 'obsolete' ELSE 'user modified' END WHEN s IS NULL THEN 'foreign' WHEN d IS NULL THEN 'new' WHEN d = s THEN 'up to date' WHEN m IS NULL OR d <> m THEN 'user modified' ELSE 'updated' END AS action
FROM s FULL JOIN i USING (path) FULL JOIN m USING (path)""")
def manifest_three_way(spark, d):
    """C12."""
    return joins.three_way(*(values(spark, "path string, hash string", *x) for x in (SHIPPED, PRESENT, NOTED)))


CODES, LABELS = [("10",), ("27",), ("999",)], {"10": "Music", "27": "Education", "28": "Science & Technology"}


@query(f"SELECT code, CASE code WHEN '10' THEN 'Music' WHEN '27' THEN 'Education' ELSE code END AS label FROM ({sql_values(*CODES)}) x(code)")
def category_label_lookup(spark, d):
    """C6."""
    c = values(spark, "code string", *CODES)
    return c.select("code", joins.label(c, "code", LABELS).alias("label"))


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def label_join(spark, d):
    """C6 on tables (engine coverage)."""
    return table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


SUMMARIES = [("h1", 1, 0.5, "old", ["title"]), ("h1", 2, 0.9, "new", ["title"]), ("h2", 1, 0.1, "none useful", ["nope"])]
HITS = [("h1", "T1", "B1"), ("h2", "T2", "B2"), ("h3", "T3", "B3")]


@query(f"""WITH s(id, n, relevance, summary, useful) AS ({sql_values(*SUMMARIES)}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1), h(id, title, body) AS ({sql_values(*HITS)})
SELECT h.id AS object_id, relevance::DOUBLE AS relevance, summary, CASE WHEN list_contains(useful, 'title') THEN 'title=' || title ELSE 'body=' || body || ',title=' || title END AS properties FROM h LEFT JOIN l USING (id)""")
def summaries_left_join_trim(spark, d):
    """C1, D10, F10."""
    hits = values(spark, "object_id string, title string, body string", *HITS).select("object_id", F.create_map(F.lit("title"), "title", F.lit("body"), "body").alias("properties"))
    out = joins.with_summaries(hits, values(spark, "object_id string, n int, relevance double, summary string, useful_properties array<string>", *SUMMARIES))
    return out.withColumn("properties", F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))


ZIPS = [(1, ["a", "b", "c"], ["x", "y"]), (2, [], ["x"]), (3, ["a"], ["x"])]


@query(f"SELECT id, list_transform(list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))]), lambda p: p[1] || p[2]) AS pairs FROM ({sql_values(*ZIPS)}) x(id, a, b)")
def positional_zip(spark, d):
    """As long as the shortest."""
    z = values(spark, "id int, a array<string>, b array<string>", *ZIPS)
    return z.select("id", F.transform(joins.zip_shortest("a", "b"), lambda p: F.concat(p["a"], p["b"])).alias("pairs"))


PRESETS, CONFIGS = [(1, "best", "m1", "high"), (2, "stable", "m1", "high"), (3, "fast", "m2", "low")], [(1, "m1", "high"), (2, "m2", "low"), (3, "m2", "high")]


@query(f"WITH p(n, name, model, level) AS ({sql_values(*PRESETS)}), c(id, model, level) AS ({sql_values(*CONFIGS)}) SELECT id, min_by(name, n) AS name FROM c LEFT JOIN p USING (model, level) GROUP BY id")
def preset_lookup(spark, d):
    """C11."""
    return joins.first_match(values(spark, "id int, model string, level string", *CONFIGS), values(spark, "n int, name string, model string, level string", *PRESETS), ["model", "level"]).select("id", "name")


HOPS, STARTS = [("a", "b"), ("b", "c"), ("c", "d"), ("l", "m"), ("m", "l")], [("1", "a"), ("2", "c"), ("3", "z"), ("4", "l")]


@query(f"""WITH RECURSIVE h(src, dst) AS ({sql_values(*HOPS)}), s(key, place) AS ({sql_values(*STARTS)}),
r AS (SELECT key, place AS target, 0 AS hops FROM s UNION ALL SELECT key, dst, hops + 1 FROM r JOIN h ON src = target WHERE hops < 5)
SELECT key, arg_max(target, hops) AS target, max(hops)::INTEGER AS hops FROM r GROUP BY key""")
def redirect_closure(spark, d):
    """At most five hops."""
    return joins.closure(values(spark, "key string, at string", *STARTS), values(spark, "src string, dst string", *HOPS))


MAPPING = [("a.md", "x/a.md"), ("b.md", "x/b.md"), ("c.md", "x/a.md")]


@query(f"SELECT dst, count(*) AS n FROM ({sql_values(*MAPPING)}) x(src, dst) GROUP BY 1 HAVING count(*) > 1")
def mapping_duplicates(spark, d):
    """C15."""
    return values(spark, "src string, dst string", *MAPPING).groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1")


ENVS = [("A", "1", None), ("B", "2", "x"), ("C", "3", ""), ("D", None, "kept"), ("E", "5", "${E:-}")]


@query(f"SELECT k, CASE WHEN coalesce(have, '') = '' OR starts_with(have, '${{') THEN given ELSE have END AS value FROM ({sql_values(*ENVS)}) x(k, given, have)")
def env_merge(spark, d):
    """What is there wins, unless it is blank or a placeholder."""
    e = values(spark, "k string, given string, have string", *ENVS)
    blank = (F.coalesce("have", F.lit("")) == "") | F.col("have").startswith("${")
    return e.select("k", F.when(blank, F.col("given")).otherwise(F.col("have")).alias("value"))


SETS = [(1, ["b", "a"], ["a", "b"]), (2, ["a"], None), (3, None, None), (4, ["a"], ["a", "a"]), (5, [], None)]


@query(f"SELECT id, list_sort(a) IS NOT DISTINCT FROM list_sort(b) AS same FROM ({sql_values(*SETS)}) x(id, a, b)")
def set_equality(spark, d):
    """Order doesn't count, null is not a list."""
    s = values(spark, "id int, a array<string>, b array<string>", *SETS)
    return s.select("id", F.array_sort("a").eqNullSafe(F.array_sort("b")).alias("same"))
