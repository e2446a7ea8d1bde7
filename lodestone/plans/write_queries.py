"""Writes and session lookups: SURVEY A3-A5, A16, A24, B1, B2, B4, B10, B11, B16-B19, D12, F15, F17, G2, H12, H33, H35, H40, H41, E17."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import scalars as x
from lodestone.operators import render, search, stats
from lodestone.operators.store import CollectionStore
from lodestone.plans.registry import query, sql_values, values
from lodestone.plans.search_queries import COSINE, QUERY, TERMS, CONTENTS, _docs_leg, bm25_sql
from lodestone.runtime import Scratch
from lodestone.sources import files
from lodestone.sources.tables import contents, first_line, table


def _store(spark, name: str) -> CollectionStore:
    return CollectionStore(spark, Scratch(spark, name).root)


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def filtered_fetch(spark, d):
    """A3: the newest object with a property."""
    e = table(spark, d, "events").filter("user_id = 7")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


def _sessions(spark, d):
    """Conversations as a session store: a row for each, its history a JSON text."""
    turns = table(spark, d, "conversations")
    turn = F.struct("turn", "role", "text")
    own = turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(turn))).alias("history"), F.count("*").alias("turn_count"))
    own = own.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "history", "turn_count")
    return Scratch(spark, "sessions").keep(own, "sessions")


@query("SELECT 's11' AS session_id, turn, role, text FROM conversations WHERE conv_id = 11")
def session_lookup(spark, d):
    """A4: a session by its id, its history decoded."""
    own = _sessions(spark, d).filter("session_id = 's11'")
    turns = F.from_json("history", "array<struct<turn bigint, role string, text string>>")
    return own.select("session_id", F.explode(turns).alias("t")).select("session_id", "t.*")


@query("SELECT DISTINCT 's' || conv_id AS session_id FROM conversations")
def session_ids(spark, d):
    """A5."""
    return _sessions(spark, d).select("session_id")


@query("SELECT lang AS category, count(*) AS objects, count(*) AS ids, count(*) AS dated FROM documents GROUP BY 1")
def append_contents(spark, d):
    """Two appends; ids are random and all different, and rows get a time."""
    s = _store(spark, "append")
    docs = table(spark, d, "documents").select(first_line().alias("title"), F.col("text").alias("summary"), F.col("lang").alias("source"))
    s.append("ContentAnalyses", docs.filter("source = 'en'"))
    s.append("ContentAnalyses", docs.filter("source <> 'en'"))
    return s.read("ContentAnalyses").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("objects"), F.count_distinct("object_id").alias("ids"), F.count("created_at").alias("dated"))


@query("""SELECT 'known' AS batch, (SELECT count(*) FROM pages) AS inserted, '' AS error
UNION ALL SELECT 'unknown', 0, 'unknown properties [''page_id'', ''url'']; WebSearchResults has created_at:date, updated_at:date, source_tool:text, query:text, response:text, sources_json:text'""")
def ingest_validated(spark, d):
    """B2: a batch with a property that the collection doesn't have is refused as a whole, with what is allowed."""
    s = _store(spark, "ingest")
    pages = table(spark, d, "pages")
    batches = {"known": pages.select(F.col("url").alias("query"), F.col("html").alias("response")), "unknown": pages.select("page_id", "url")}
    out = []
    for name, rows in batches.items():
        try:
            out.append((name, s.ingest("WebSearchResults", rows).count(), ""))
        except ValueError as e:
            out.append((name, 0, str(e)))
    return spark.createDataFrame(out, "batch string, inserted long, error string")


@query("""SELECT CASE WHEN event_type = 'click' THEN 'builds_on' ELSE 'related_to' END AS relationship_type, 'video_analyze' AS source_tool, count(*) AS edges, count(*) AS without_url
FROM events GROUP BY 1""")
def append_edges(spark, d):
    """A batch of concept edges, of which most have no type; an empty batch changes nothing."""
    s = _store(spark, "edges")
    e = table(spark, d, "events")
    edges = e.select(F.col("user_id").alias("from_concept"), F.col("event_id").alias("to_concept"), F.when(F.col("event_type") == "click", "builds_on").alias("relationship_type"))
    s.append_edges(edges)
    s.append_edges(edges.limit(0))
    return s.read("RelationshipEdges").groupBy("relationship_type", "source_tool").agg(F.count("*").alias("edges"), F.count_if(F.col("source_url") == "").alias("without_url"))


@query(f"""WITH l AS (SELECT vec_id AS left_id, embedding::DOUBLE[] AS a FROM embeddings WHERE label = 3),
p AS (SELECT left_id, vec_id AS right_id, round({COSINE}, 6) AS score FROM (SELECT left_id, a, vec_id, embedding::DOUBLE[] AS b FROM l, embeddings WHERE label <> 3)),
t AS (SELECT left_id, right_id FROM p QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) <= 5)
SELECT 'r' || left_id AS object_id, list('f' || right_id ORDER BY 'f' || right_id) AS related_findings FROM t GROUP BY 1""")
def insert_with_links(spark, d):
    """New reports are linked to the five findings next to them; links to findings that aren't there are passed over."""
    s = _store(spark, "linked")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    new, old = e.filter("label = 3"), e.filter("label <> 3")
    s.append("ResearchFindings", old.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("object_id")))
    s.append("DeepResearchReports", new.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("object_id")))
    named = lambda to: (F.lit("DeepResearchReports").alias("from_collection"), F.concat(F.lit("r"), F.col("left_id").cast("string")).alias("from_id"), F.lit("related_findings").alias("ref_name"), F.lit("ResearchFindings").alias("to_collection"), to.alias("to_id"))
    near = Scratch(spark, "near").keep(search.nearest_join(new, old, 5), "near")  # both links read it
    s.link(near.select(*named(F.concat(F.lit("f"), F.col("right_id").cast("string")))))
    s.link(near.filter("rank = 1").select(*named(F.lit("no such finding"))))
    return s.export("DeepResearchReports").select("object_id", "related_findings")


LATER = ["updated_at", "source_tool", "instruction", "summary", "key_points", "entities", "raw_result", "structure_notes", "quality_assessment", "local_filepath"]


@query(f"SELECT p AS property, (SELECT count(*) FROM documents) AS objects, 0::BIGINT AS with_value FROM ({sql_values(*((p,) for p in LATER))}) x(p)")
def create_and_evolve(spark, d):
    """A collection is made once; what an older schema lacks is found, and null when read."""
    s = _store(spark, "evolve")
    made = s.create("WebSearchResults") + s.create("WebSearchResults")
    old = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_id"), first_line().alias("title"), F.col("source"), F.current_timestamp().alias("created_at"))
    old.write.parquet(f"{s.root}/ContentAnalyses/v1")
    added = s.create("ContentAnalyses") + made
    rows = s.read("ContentAnalyses").agg(F.count("*").alias("objects"), *(F.count(p).alias(p) for p in added))
    return rows.select("objects", F.explode(F.map_from_arrays(F.array(*(F.lit(p) for p in added)), F.array(*added))).alias("property", "with_value"))


@query("""WITH v AS (SELECT doc_id, count(*) FILTER (vec_id IS NOT NULL) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1)
SELECT count(*) AS objects, count(*) AS updated, sum(n)::BIGINT AS links FROM v""")
def rebuild_collection(spark, d):
    """Every object is written anew with a changed property; edges stay."""
    s = _store(spark, "rebuild")
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    s.append("VideoAnalyses", docs.select(F.col("doc_id").cast("string").alias("object_id"), first_line().alias("title")))
    s.append("VideoMetadata", vectors.select(F.col("vec_id").cast("string").alias("object_id")))
    s.link(docs.select(F.lit("VideoAnalyses").alias("from_collection"), F.col("doc_id").cast("string").alias("from_id"), F.lit("has_metadata").alias("ref_name"), F.lit("VideoMetadata").alias("to_collection"), F.col("doc_id").cast("string").alias("to_id")))
    s.rebuild("VideoAnalyses", lambda df: df.withColumn("updated_at", F.current_timestamp()))
    return s.export("VideoAnalyses").agg(F.count("*").alias("objects"), F.count("updated_at").alias("updated"), F.sum(F.size("has_metadata")).alias("links"))


NOTES = [("p1", "first note"), ("p2", "second: é\nwith a line"), ("p1", "replaced")]


@query("SELECT * FROM (VALUES ('p1', 'replaced'), ('p2', 'second: é' || chr(10) || 'with a line')) t(project, note)")
def inject_notes(spark, d):
    """Text files of projects; a later one takes the place of an earlier one."""
    root = Scratch(spark, "notes").root
    for project, note in NOTES:
        files.put_text(spark, f"{root}/{project}/input.txt", note)
    own = spark.read.text(f"{root}/*/input.txt", wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("note"))
    return own.select(F.regexp_extract("f", "/([^/]+)/input.txt$", 1).alias("project"), "note")


VIDEOS = [("A \"b\" 100%", "Ch", "Music", "4:13", ["x", "y"]), ("T", "Ch", "", "0:00", []), ("T", "Ch", None, "1:00", [str(i) for i in range(12)])]


@query("SELECT * FROM (VALUES ('Video context: \"A \"b\" 100%\" by Ch (Music, 4:13). Tags: x, y'), ('Video context: \"T\" by Ch (Unknown, 0:00). Tags: none'), ('Video context: \"T\" by Ch (Unknown, 1:00). Tags: 0, 1, 2, 3, 4, 5, 6, 7, 8, 9')) t(preamble)")
def metadata_preamble(spark, d):
    """H35, H42."""
    v = values(spark, "title string, channel string, category string, duration string, tags array<string>", *VIDEOS)
    return v.select(render.preamble("title", "channel", "category", "duration", x.tag_list(F.col("tags"))).alias("preamble"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents")
def description_excerpt(spark, d):
    """F16."""
    return table(spark, d, "documents").select("doc_id", render.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, CASE WHEN contains(n, '.') THEN n ELSE 'document.pdf' END AS name FROM (SELECT page_id, string_split(string_split(url, '/')[-1], '?')[1] AS n FROM pages)")
def download_names(spark, d):
    """H33."""
    return table(spark, d, "pages").select("page_id", x.download_name(F.col("url")).alias("name"))


@query("SELECT place, path FROM (SELECT row_number() OVER (ORDER BY part, n) AS place, path FROM (SELECT 0 AS part, doc_id AS n, 'local/' || doc_id AS path FROM documents WHERE lang = 'de' UNION ALL SELECT 1, page_id, url FROM pages)) WHERE place <= 50")
def ordered_union(spark, d):
    """Given paths first, then downloaded ones, each in their order; the first fifty."""
    given = table(spark, d, "documents").filter("lang = 'de'").select(F.lit(0).alias("part"), F.col("doc_id").alias("n"), F.concat(F.lit("local/"), F.col("doc_id").cast("string")).alias("path"))
    both = given.unionByName(table(spark, d, "pages").select(F.lit(1).alias("part"), F.col("page_id").alias("n"), F.col("url").alias("path")))
    from pyspark.sql.window import Window

    own = both.orderBy("part", "n").limit(50)
    return own.select(F.row_number().over(Window.orderBy("part", "n")).cast("long").alias("place"), "path")  # fifty rows


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'error') AS first_error, bool_or(event_type = 'purchase') AS any_purchase FROM events GROUP BY 1")
def first_and_any(spark, d):
    """the first match and whether there is any."""
    e = table(spark, d, "events")
    hit = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(F.min_by(F.when(hit, F.col("event_id")), F.when(hit, F.struct("ts", "event_id"))).alias("first_error"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"))


USAGE = [("a", '{"usage":{"total_input_tokens":5,"total_output_tokens":7,"total_tokens":12,"x":1}}'), ("b", '{"usage":{}}'), ("c", "{}"), ("d", None)]


@query("SELECT * FROM (VALUES ('a', 5::BIGINT, 7::BIGINT, 12::BIGINT, NULL::BIGINT), ('b', NULL, NULL, NULL, NULL), ('c', NULL, NULL, NULL, NULL), ('d', NULL, NULL, NULL, NULL)) t(id, total_input_tokens, total_output_tokens, total_tokens, total_thought_tokens)")
def token_usage(spark, d):
    """H40."""
    u = F.from_json("body", "usage struct<total_input_tokens bigint, total_output_tokens bigint, total_tokens bigint, total_thought_tokens bigint>")
    return values(spark, "id string, body string", *USAGE).select("id", u.alias("u")).select("id", "u.usage.*")


def _page(*rows):
    return '{"items":[' + ",".join('{"snippet":{"topLevelComment":{"snippet":{"textDisplay":"%s","likeCount":%s,"authorDisplayName":"%s"}}}}' % r for r in rows) + "]}"


@query("SELECT * FROM (VALUES (0, 'one', 3::BIGINT, 'a'), (1, 'two', 0::BIGINT, 'b'), (2, 'three', 9::BIGINT, 'a'), (3, 'four', 1::BIGINT, '')) t(n, text, likes, author)")
def comments_paged(spark, d):
    """Pages in their order up to a cap."""
    pages = [(1, _page(("three", 9, "a"), ("four", 1, ""), ("five", 2, "c"))), (0, _page(("one", 3, "a"), ("two", "null", "b"))), (2, "{}")]
    return files.comment_rows(values(spark, "page int, body string", *pages), 4)


@query("""WITH c AS (SELECT lang, source, doc_id, n_chars AS likes, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS s FROM documents JOIN labels USING (doc_id)),
t AS (SELECT lang, s, source, max((likes, doc_id::VARCHAR)) AS b, count(*) AS n FROM c WHERE s <> 'neutral' GROUP BY 1, 2, 3),
r AS (SELECT lang, s, list(source || ': ' || b[2] ORDER BY b[1] DESC, n DESC, source)[1:3] AS l FROM t GROUP BY 1, 2)
SELECT lang, count(*) AS comments, round(count(*) FILTER (s = 'positive') * 100 / count(*), 1) AS positive, round(count(*) FILTER (s = 'negative') * 100 / count(*), 1) AS negative, round(count(*) FILTER (s = 'neutral') * 100 / count(*), 1) AS neutral,
  coalesce((SELECT l FROM r WHERE r.lang = c.lang AND s = 'positive'), []) AS supportive, coalesce((SELECT l FROM r WHERE r.lang = c.lang AND s = 'negative'), []) AS critical FROM c GROUP BY lang""")
def comment_opinions(spark, d):
    """Percentages, and the most liked comment of the most liked themes."""
    own = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    own = own.select("lang", "source", kind.alias("sentiment"), F.col("n_chars").alias("likes"), F.col("doc_id").cast("string").alias("text"))
    return stats.opinions(own, "lang", "sentiment", "source", "likes", "text")


YAML = "- query: \"deep sea\"\n  response: squids\n- query: ice\n  score: 3\n"
MARKDOWN = "# Entries\n\n## Deep sea\n- response: squids\n\n## Ice\n* response: cold\n* source_tool: web\n"


@query("""SELECT * FROM (VALUES ('yaml', 1, '{query=deep sea, response=squids}', []::VARCHAR[]), ('yaml', 2, '{query=ice, score=3}', ['score']),
('markdown', 1, '{response=squids, title=Deep sea}', ['title']), ('markdown', 2, '{response=cold, source_tool=web, title=Ice}', ['title'])) t(kind, entry, properties, unknown)""")
def bulk_entry_files(spark, d):
    """Entries of YAML and markdown files, with the properties that the collection doesn't have."""
    from lodestone.operators.store import unknown_properties

    out = None
    for kind, text in (("yaml", YAML), ("markdown", MARKDOWN)):
        path = f"{Scratch(spark, 'entries').root}/e.{kind}"
        files.put_text(spark, path, text)
        found = files.entry_blocks(files.dotenv_lines(spark, path), kind)
        own = found.groupBy(F.col("entry").cast("int").alias("entry")).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("p"))
        shown = F.concat(F.lit("{"), F.array_join(F.transform("p", lambda e: F.concat(e["name"], F.lit("="), e["value"])), ", "), F.lit("}"))
        own = own.select(F.lit(kind).alias("kind"), "entry", shown.alias("properties"), unknown_properties(F.col("p.name"), "WebSearchResults").alias("unknown"))
        out = own if out is None else out.unionByName(own)
    return out


CONFIG = [("model-1", "k1", "k2", "k3", "t", 8)]


@query("SELECT 'model-1' AS model, 8 AS concurrency")
def config_redacted(spark, d):
    """Secrets of a configuration are dropped by name."""
    own = values(spark, "model string, gemini_api_key string, youtube_api_key string, weaviate_api_key string, infra_admin_token string, concurrency int", *CONFIG)
    return own.drop(*schema.SECRETS)


@query(f"""WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)}
SELECT 'ContentAnalyses' AS collection, id AS object_id, title, true AS deprecated FROM (SELECT id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 10) JOIN contents ON object_id = id""")
def knowledge_query(spark, d):
    """retrieval with properties, marked as deprecated."""
    leg = _docs_leg(spark, d)
    hits = search.with_properties(leg, search.top(search.keyword(leg, QUERY), 10, leg), title=F.col("title"))
    return hits.select(F.lit(leg.name).alias("collection"), "object_id", "title", F.lit(True).alias("deprecated"))
