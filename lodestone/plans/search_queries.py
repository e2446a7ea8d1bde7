"""Retrieval queries: SURVEY F1-F11, F17, C7, C8, D1-D6, G1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cells
from lodestone.operators import search as s
from lodestone.operators import vectorize
from lodestone.functions.scalars import uuid5
from lodestone.functions.vectors import norm
from lodestone.operators.filters import apply_filter
from lodestone.operators.index import build, stored
from lodestone.operators.store import CollectionStore
from lodestone.plans.registry import query
from lodestone.runtime import Scratch
from lodestone.sources.tables import contents, first_line, table

QUERY = "the worthless idea of an idiot"
TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
UUID5 = "(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h},17,1)), 1)||substr({h},18,3)||'-'||substr({h},21,12))"
CONTENTS = f"""
contents AS (
  SELECT {UUID5.format(h="h")} AS object_id, doc_id, split_part(text, chr(10), 1) AS title, text AS summary, source AS source_tool, lang AS category,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'CONFIRMED' WHEN toxic = 1 THEN 'SPECULATION' WHEN quality = 0 THEN 'INFERENCE' END AS evidence_tier,
         to_timestamp(1735689600 + doc_id * 3600) AS created_at, n_chars
  FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents) LEFT JOIN labels USING (doc_id)
)"""


def bm25_sql(name: str, source: str, key: str, text: str, terms: list[str]) -> str:
    """CTEs up to ``name`` (key, score)."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
{name}_t AS (SELECT {key} AS id, {TOKENS.format(text)} AS t FROM {source}),
{name}_d AS (SELECT id, t, len(t) AS dl FROM {name}_t WHERE len(t) > 0),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_d),
{name}_p AS (SELECT id, dl, q, len(list_filter(t, lambda x: x = q)) AS tf FROM {name}_d, (SELECT unnest([{listed}]) AS q)),
{name}_f AS (SELECT q, count(*) AS df FROM {name}_p WHERE tf > 0 GROUP BY q),
{name} AS (
  SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_p JOIN {name}_f USING (q), {name}_s WHERE tf > 0 GROUP BY id
)"""


TERMS = s.terms_of(QUERY)
COSINE = "coalesce(list_inner_product(a, b) / nullif(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 0), 0)"


def _docs_leg(spark: SparkSession, d: str) -> s.Leg:
    """Documents with the vectors that some of them have; texts are indexed by document."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    named = uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return s.Leg("ContentAnalyses", contents(spark, d), F.col("summary"), None, F.col("title"), ["doc_id"], named, stored(table(spark, d, "documents"), ("doc_id",), "text"), vectors)


def _turns_leg(spark: SparkSession, d: str) -> s.Leg:
    named = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    turns = table(spark, d, "conversations")
    return s.Leg("SessionTranscripts", turns.withColumn("turn_response", F.col("text")), F.col("text"), None, F.col("text"), ["conv_id", "turn"], named, stored(turns, ("conv_id", "turn"), "text"))


def _pages_leg(spark: SparkSession, d: str) -> s.Leg:
    pages = table(spark, d, "pages")
    return s.Leg("WebSearchResults", pages, F.col("html"), None, None, ["page_id"], F.concat(F.lit("page:"), F.col("page_id").cast("string")), stored(pages, ("page_id",), "html"))


def _probe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q"))


@query(f"WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)} SELECT id AS object_id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 10")
def search_keyword_topk(spark, d):
    """F2, F7."""
    leg = _docs_leg(spark, d)
    return s.top(s.keyword_top(leg, QUERY, 10), 10, leg).select("object_id", "score")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS b FROM embeddings)
SELECT vec_id, round({COSINE}, 6) AS score FROM v ORDER BY 2 DESC, 1 LIMIT 10""")
def search_semantic_topk(spark, d):
    """from the cells of the stored vector index that can hold a hit."""
    e = table(spark, d, "embeddings")
    leg = s.Leg("e", e, F.lit(""), "embedding", keys=["vec_id"], object_id=F.col("vec_id"), cells=cells.stored(e, ("vec_id",), "embedding"))
    return s.top(s.semantic_top(leg, _probe(spark, d), 10), 10, leg).select("vec_id", "score")


@query("SELECT count(*) AS vectors, true AS whole, true AS apart FROM embeddings WHERE embedding IS NOT NULL")
def vector_index(spark, d):
    """an index of all vectors, built anew; no row is outside its cell's radius, and rows that have no direction are in a cell of their own."""
    e = table(spark, d, "embeddings")
    index = cells.build(e, ("vec_id",), "embedding", Scratch(spark, "vector_index").root)
    rows = index.rows.join(F.broadcast(index.cells), "cell")  # a row for each cell, of which there is a greatest number
    size = norm(F.col("__v"))
    away = F.sqrt(F.aggregate(F.zip_with("__v", "centre", lambda x, y: F.pow(x / size - y, 2)), F.lit(0.0), lambda a, x: a + x))
    return rows.agg(F.count("*").alias("vectors"), F.bool_and((F.col("cell") < 0) | (away <= F.col("radius") + 1e-9)).alias("whole"), F.bool_and((F.col("cell") < 0) == F.coalesce(~(size > 0), F.lit(True))).alias("apart"))


HYBRID = f"""
{CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)},
v AS (SELECT object_id AS id, {COSINE} AS score FROM (
  SELECT object_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS b FROM contents JOIN embeddings ON vec_id = doc_id)),
ks AS (SELECT id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS k FROM k),
vs AS (SELECT id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS v FROM v)"""


@query(f"WITH {HYBRID} SELECT id AS object_id, round(0.3 * coalesce(v, 0) + 0.7 * coalesce(k, 0), 6) AS score FROM ks FULL JOIN vs USING (id) ORDER BY 2 DESC, 1 LIMIT 20")
def search_hybrid_topk(spark, d):
    """F4."""
    leg = _docs_leg(spark, d)
    return s.top(s.hybrid(leg, QUERY, _probe(spark, d), 0.3), 20, leg).select("object_id", "score")


def jaccard_sql(text: str) -> str:
    q = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
    own = f"list_distinct({TOKENS.format(text)})"
    return f"round(len(list_intersect({q}, {own}))::DOUBLE / len(list_distinct(list_concat({q}, {own}))), 6)"


@query(f"""WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)},
c AS (SELECT id AS object_id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 30),
r AS (SELECT 'ContentAnalyses' AS collection, object_id, score, {jaccard_sql('title')} AS rerank_score FROM c JOIN contents USING (object_id))
SELECT *, (row_number() OVER (ORDER BY rerank_score DESC, score DESC, object_id))::INTEGER AS place FROM r QUALIFY place <= 10""")
def search_reranked_topk(spark, d):
    """F5, F6."""
    return s.search([_docs_leg(spark, d)], QUERY, "keyword", 10, rerank=True)


TURNS = "turns AS (SELECT 'turn:' || conv_id || ':' || turn AS object_id, text AS turn_response FROM conversations)"
PAGES = "web AS (SELECT 'page:' || page_id AS object_id, html AS response FROM pages)"
CROSS = f"""WITH {CONTENTS}, {TURNS}, {PAGES}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)}, {bm25_sql('t', 'turns', 'object_id', 'turn_response', TERMS)}, {bm25_sql('w', 'web', 'object_id', 'response', TERMS)},
kc AS (SELECT id AS object_id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 30),
tc AS (SELECT id AS object_id, round(score, 6) AS score FROM t ORDER BY 2 DESC, 1 LIMIT 30),
wc AS (SELECT id AS object_id, round(score, 6) AS score FROM w ORDER BY 2 DESC, 1 LIMIT 10),
u AS (
  SELECT 0 AS leg, 'ContentAnalyses' AS collection, object_id, score, {jaccard_sql('title')} AS rerank_score FROM kc JOIN contents USING (object_id)
  UNION ALL SELECT 1, 'SessionTranscripts', object_id, score, {jaccard_sql('turn_response')} FROM tc JOIN turns USING (object_id)
  UNION ALL SELECT 2, 'WebSearchResults', object_id, score, NULL FROM wc
)
SELECT collection, object_id, score, rerank_score, (row_number() OVER (ORDER BY coalesce(rerank_score, -1) DESC, score DESC, leg, object_id))::INTEGER AS place FROM u QUALIFY place <= 10"""


@query(CROSS)
def search_cross_collection(spark, d):
    """Three collections, one of them never reranked."""
    return s.search([_docs_leg(spark, d), _turns_leg(spark, d), _pages_leg(spark, d)], QUERY, "keyword", 10, rerank=True)


@query(f"""WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)}
SELECT id AS object_id, round(score, 6) AS score FROM k JOIN contents ON object_id = id
WHERE evidence_tier = 'CONFIRMED' AND category = 'en' AND created_at >= TIMESTAMPTZ '2025-01-05 00:00:00+00' AND created_at <= TIMESTAMPTZ '2025-01-25 12:00:00+00' ORDER BY 2 DESC, 1 LIMIT 10""")
def search_filtered(spark, d):
    """Filters never change scores; an empty string is no filter; a bad date is none."""
    leg = _docs_leg(spark, d)
    found = s.search([leg], QUERY, "keyword", 10, evidence_tier="CONFIRMED", category="en", source_tool="", date_from="2025-01-05", date_to="2025-01-25T12:00:00Z")
    return found.select("object_id", "score")


@query(f"WITH {CONTENTS} SELECT object_id, evidence_tier, category FROM contents WHERE category = 'de' AND created_at >= TIMESTAMPTZ '2025-01-10 00:00:00+00'")
def filter_builder(spark, d):
    """video_id isn't a property of this collection, so that condition is passed over."""
    return apply_filter(contents(spark, d), category="de", video_id="x", date_from="20250110", date_to="not a date").select("object_id", "evidence_tier", "category")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 42) AS b FROM embeddings WHERE vec_id <> 42)
SELECT vec_id AS object_id, round({COSINE}, 6) AS score FROM v ORDER BY 2 DESC, 1 LIMIT 5""")
def related_objects(spark, d):
    """From the cells that can hold a neighbour."""
    e = table(spark, d, "embeddings")
    return s.related(e, "42", 5, "vec_id", "embedding", cells.stored(e, ("vec_id",), "embedding"))


@query(f"""WITH l AS (SELECT vec_id AS left_id, embedding::DOUBLE[] AS a FROM embeddings WHERE label = 3),
p AS (SELECT left_id, vec_id AS right_id, round({COSINE}, 6) AS score FROM (SELECT left_id, a, vec_id, embedding::DOUBLE[] AS b FROM l, embeddings WHERE label <> 3))
SELECT left_id, right_id, score, (row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id))::INTEGER AS rank FROM p QUALIFY rank <= 5""")
def knn_cross_reference(spark, d):
    """The objects of one label against all others."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return s.nearest_join(e.filter("label = 3"), e.filter("label <> 3"), 5)


@query(f"""WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)}, c AS (SELECT id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 5)
SELECT 'Found 5 objects: ' || string_agg(title, ' | ' ORDER BY score DESC, id) AS answer, list(id ORDER BY score DESC, id) AS sources FROM c JOIN contents ON object_id = id""")
def knowledge_ask(spark, d):
    """the extractive stand-in, an answer with the ids that it cites."""
    leg = _docs_leg(spark, d)
    hits = s.with_properties(leg, s.top(s.keyword_top(leg, QUERY, 5), 5, leg), title=F.col("title"))
    rows = hits.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), "object_id", "title"))).alias("h"))
    return rows.select(F.concat(F.lit("Found "), F.size("h").cast("string"), F.lit(" objects: "), F.array_join(F.col("h.title"), " | ")).alias("answer"), F.col("h.object_id").alias("sources"))


@query(f"""WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)}, c AS (SELECT id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 100)
SELECT (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS place, id AS object_id, substr(summary, 1, 300) AS snippet FROM c JOIN contents ON object_id = id""")
def summary_prompt_batch(spark, d):
    """the first 100 hits, values cut to 300 characters."""
    from pyspark.sql.window import Window

    leg = _docs_leg(spark, d)
    hits = s.with_properties(leg, s.top(s.keyword_top(leg, QUERY, 100), 100, leg), summary=F.col("summary"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "object_id"))  # 100 rows at most
    return hits.select(place.alias("place"), "object_id", F.substring("summary", 1, 300).alias("snippet"))


@query(f"""WITH {bm25_sql('k', 'documents', 'doc_id', 'text', ['x'])}, p AS (SELECT id, unnest(list_distinct(t)) AS term FROM k_d)
SELECT n AS texts, round(avgdl, 6) AS mean_length, (SELECT count(DISTINCT term) FROM p) AS terms, (SELECT count(*) FROM p) AS postings FROM k_s""")
def keyword_index(spark, d):
    """an index of all documents, built anew."""
    index = build(table(spark, d, "documents"), ("doc_id",), "text", Scratch(spark, "keyword_index").root)
    sizes = index.postings.groupBy("term").count().agg(F.count("*").alias("terms"), F.sum("count").alias("postings"))
    return index.corpus.crossJoin(F.broadcast(sizes)).select(F.col("n").alias("texts"), F.round("avgdl", 6).alias("mean_length"), "terms", "postings")  # one row each


@query(f"""WITH {CONTENTS}, {bm25_sql('k', 'contents', 'object_id', 'summary', TERMS)}
SELECT id AS object_id, round(score, 6) AS score, 'VideoAnalyses, WebSearchResults' AS skipped FROM k ORDER BY 2 DESC, 1 LIMIT 5""")
def search_partial(spark, d):
    """F8: collections that can't be searched are left out and named; the rest is returned."""
    legs = [s.Leg("VideoAnalyses", table(spark, d, "events"), F.col("summary"), keys=["event_id"], object_id=F.col("event_id")), _docs_leg(spark, d), s.Leg("WebSearchResults", table(spark, d, "pages"), F.col("response"), keys=["page_id"], object_id=F.col("page_id"))]
    skipped: dict[str, str] = {}
    found = s.search(legs, QUERY, "keyword", 5, skipped=skipped)
    return found.select("object_id", "score", F.lit(", ".join(sorted(skipped))).alias("skipped"))


HASHED = """
{0}_n AS (SELECT id, ('0x' || substr(md5(t), 1, 7))::INTEGER % 64 AS s, count(*) AS n FROM {0}_t GROUP BY ALL),
{0}_z AS (SELECT id, sqrt(sum(n * n)) AS z FROM {0}_n GROUP BY 1)"""
VECTORS = f"""{CONTENTS}, d_t AS (SELECT object_id AS id, unnest({TOKENS.format("concat_ws(' ', title, summary)")}) AS t FROM contents), {HASHED.format('d')}"""


def _vectorized(spark: SparkSession, d: str, name: str, *versions: int) -> CollectionStore:
    """All documents in a store, with vectors of so many components, one version after another."""
    store = CollectionStore(spark, Scratch(spark, name).root)
    named = uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    docs = table(spark, d, "documents")  # without labels, a join with which would shuffle whole texts
    store.append("ContentAnalyses", docs.select(named.alias("object_id"), first_line().alias("title"), F.col("text").alias("summary"), F.col("source").alias("source_tool"), F.col("lang").alias("category")))
    for dimensions in versions:
        vectorize.revectorize(store, "ContentAnalyses", dimensions)
    return store


@query(f"""WITH {VECTORS}, q_t AS (SELECT 0 AS id, unnest({TOKENS.format(f"'{QUERY}'")}) AS t), {HASHED.format('q')}
SELECT d_n.id AS object_id, round(sum(d_n.n * q_n.n) / any_value(d_z.z * q_z.z), 6) AS score FROM d_n JOIN q_n USING (s) JOIN d_z ON d_z.id = d_n.id, q_z GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def search_near_text(spark, d):
    """A text's nearest documents by vectors that the engine has made of title and summary."""
    return vectorize.near_text(_vectorized(spark, d, "near_text", 64), "ContentAnalyses", QUERY, 10).select("object_id", "score")


@query(f"""WITH {VECTORS}, w AS (SELECT id, s, n / z AS w FROM d_n JOIN d_z USING (id))
SELECT object_id, count(w) AS slots, round(coalesce(sum(w), 0), 6) AS total, arg_max(s, (w, -s)) AS heaviest FROM contents LEFT JOIN w ON id = object_id GROUP BY 1""")
def revectorized(spark, d):
    """The vectors of all documents after they have been made anew."""
    index, dimensions = vectorize.vectors_of(_vectorized(spark, d, "revectorized", 16, 64), "ContentAnalyses")
    own = index.rows.select("object_id", F.posexplode("__v").alias("s", "w")).groupBy("object_id").agg(F.count_if(F.col("w") > 0).alias("slots"), F.round(F.sum("w"), 6).alias("total"), F.max_by(F.when(F.col("w") > 0, F.col("s")), F.struct("w", -F.col("s"))).alias("heaviest"))
    return own.select("object_id", "slots", "total", "heaviest")
