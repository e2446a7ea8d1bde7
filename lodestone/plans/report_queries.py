"""Reports as files, answers in pages, research results in their collections: SURVEY A16, A17, B14, B16, C4, E19, E29, F14, H26, H41, J."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import render
from lodestone.operators.store import CollectionStore
from lodestone.plans.registry import query
from lodestone.runtime import Scratch
from lodestone.sources import filesink, paged
from lodestone.sources.tables import first_line, table


def _reports(spark, d):
    """Conversations as results: a report of each, its turns the sections, moments and concepts.  A report is one row, and one file of each kind."""
    c = F.col
    turns = table(spark, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda t: F.coalesce(F.substring_index(t["text"], "\n", 1), F.lit(""))
    word = lambda t: F.substring_index(head(t), " ", 1)
    language = F.element_at(F.array(*(F.lit(x) for x in ("en", "es", "nl", "de"))), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    following = F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t")).alias("b"))
    return own.select(
        "conv_id",
        language.alias("lang"),
        head(c("t")[0]).alias("title"),
        F.concat(F.lit("conv:"), c("conv_id").cast("string")).alias("source"),
        F.coalesce(F.get(F.filter("t", lambda t: t["role"] == "assistant"), 0)["text"], F.lit("")).alias("summary"),
        F.transform(F.filter("t", lambda t: t["role"] == "user"), head).alias("points"),
        F.array_sort(F.array_distinct(F.filter(F.transform("t", lambda t: t["role"]), lambda r: r.isNotNull()))).alias("topics"),
        F.transform("t", lambda t: F.struct(F.concat(t["turn"].cast("string"), F.lit(":00")).alias("time"), head(t).alias("description"))).alias("times"),
        F.transform("t", lambda t: F.struct(t["role"].alias("heading"), t["text"].alias("content"))).alias("sections"),
        F.transform("t", lambda t: F.struct(word(t).alias("id"), head(t).alias("label"))).alias("nodes"),
        F.transform(following, lambda p: F.struct(word(p["a"]).alias("source"), word(p["b"]).alias("target"), p["b"]["role"].alias("label"))).alias("edges"),
    )


#: What reports are made of, in SQL: headings h, turns t, reports r.
REPORTS = """h(lang, summary, points, times, topics, notes, map, source, see) AS (VALUES
  ('en', 'Summary', 'Key Points', 'Timestamps', 'Topics', 'Strategic Notes', 'Concept Map', 'Source', 'See also'),
  ('de', 'Summary', 'Key Points', 'Timestamps', 'Topics', 'Strategic Notes', 'Concept Map', 'Source', 'See also'),
  ('nl', 'Samenvatting', 'Kernpunten', 'Tijdstempels', 'Onderwerpen', 'Strategische Notities', 'Conceptkaart', 'Bron', 'Zie ook'),
  ('es', 'Resumen', 'Puntos Clave', 'Marcas de Tiempo', 'Temas', 'Notas Estratégicas', 'Mapa Conceptual', 'Fuente', 'Ver también')),
t AS (SELECT *, split_part(head, ' ', 1) AS word FROM (SELECT conv_id, turn, role, text, coalesce(split_part(text, chr(10), 1), '') AS head, ['en', 'es', 'nl', 'de'][conv_id % 4 + 1] AS lang,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, greatest(floor(sqrt(count(*) OVER (PARTITION BY conv_id)))::INT, 1) AS cols FROM conversations)),
r AS (SELECT conv_id, lang, arg_min(head, i) AS title, coalesce(arg_min(text, i) FILTER (role = 'assistant'), '') AS body,
  string_agg('- ' || head || chr(10), '' ORDER BY i) FILTER (role = 'user') AS users, string_agg('| ' || turn || ':00 | ' || head || ' |' || chr(10), '' ORDER BY i) AS moments,
  string_agg(DISTINCT role, ', ' ORDER BY role) AS roles, string_agg('## ' || coalesce(role, 'Section') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY i) AS sections FROM t GROUP BY conv_id, lang)"""
ANALYSIS = """'# ' || title || chr(10) || chr(10) || '**' || source || ':** conv:' || conv_id || chr(10) || chr(10)
  || CASE WHEN body = '' THEN '' ELSE '## ' || summary || chr(10) || chr(10) || body || chr(10) || chr(10) END
  || CASE WHEN users IS NULL THEN '' ELSE '## ' || points || chr(10) || chr(10) || users || chr(10) END
  || '## ' || times || chr(10) || chr(10) || '| Time | Description |' || chr(10) || '|------|-------------|' || chr(10) || moments || chr(10)
  || CASE WHEN roles IS NULL THEN '' ELSE '## ' || topics || chr(10) || chr(10) || roles || chr(10) || chr(10) END
  || '---' || chr(10) || chr(10) || see || ': [Strategy Report](strategy.md) | [' || map || '](concept-map.html)' || chr(10)"""
STRATEGY = "regexp_replace('# ' || title || chr(10) || chr(10) || sections || CASE WHEN users IS NULL THEN '' ELSE '## ' || notes || chr(10) || chr(10) || users || chr(10) END, '\\n$', '')"
ESCAPED = "replace(replace(replace(replace(replace(head, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
MAPS = f"""p AS (SELECT conv_id, word, 80 + (max(i) % max(cols)) * 160 AS x, 80 + (max(i) // max(cols)) * 120 AS y FROM t GROUP BY 1, 2),
b AS (SELECT conv_id, word AS target, coalesce(role, '') AS label, i - 1 AS i, lag(word) OVER (PARTITION BY conv_id ORDER BY i) AS origin FROM t),
drawn AS (SELECT b.conv_id, 0 AS part, i, '  <line x1="' || s.x || '" y1="' || s.y || '" x2="' || e.x || '" y2="' || e.y || '" stroke="#666" stroke-width="2" marker-end="url(#arrow)"/>'
  || CASE WHEN label = '' THEN '' ELSE chr(10) || '  <text x="' || ((s.x + e.x) // 2) || '.0" y="' || ((s.y + e.y) // 2 - 8) || '.0" text-anchor="middle" font-size="11" fill="#888">' || label || '</text>' END AS o
  FROM b JOIN p s ON b.conv_id = s.conv_id AND b.origin = s.word JOIN p e ON b.conv_id = e.conv_id AND b.target = e.word
  UNION ALL SELECT t.conv_id, 1, i, '  <circle cx="' || x || '" cy="' || y || '" r="30" fill="#4a90d9" stroke="#2c5f8a" stroke-width="2"/>' || chr(10)
  || '  <text x="' || x || '" y="' || (y + 4) || '" text-anchor="middle" font-size="12" fill="white" font-weight="bold">' || {ESCAPED} || '</text>' FROM t JOIN p ON t.conv_id = p.conv_id AND t.word = p.word),
m AS (SELECT conv_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>' || map || '</title>' || chr(10)
  || '<style>body {{ font-family: sans-serif; margin: 20px; background: #f5f5f5; }}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<h1>' || map || '</h1>' || chr(10)
  || '<svg width="' || (w + 100) || '" height="' || (tall + 100) || '" xmlns="http://www.w3.org/2000/svg">' || chr(10) || '  <defs>' || chr(10)
  || '    <marker id="arrow" markerWidth="10" markerHeight="7" refX="10" refY="3.5" orient="auto">' || chr(10) || '      <polygon points="0 0, 10 3.5, 0 7" fill="#666"/>' || chr(10) || '    </marker>' || chr(10) || '  </defs>' || chr(10)
  || g || chr(10) || '</svg>' || chr(10) || '</body>' || chr(10) || '</html>' AS page
  FROM (SELECT conv_id, max(x) AS w, max(y) AS tall FROM p GROUP BY 1) JOIN (SELECT conv_id, string_agg(o, chr(10) ORDER BY part, i) AS g FROM drawn GROUP BY 1) USING (conv_id) JOIN r USING (conv_id) JOIN h USING (lang))"""


def _analysis():
    c = F.col
    return render.analysis_markdown(c("lang"), c("title"), c("source"), c("summary"), c("points"), c("topics"), c("times"))


@query(f"WITH {REPORTS} SELECT conv_id, {ANALYSIS} AS page FROM r JOIN h USING (lang)")
def analysis_pages(spark, d):
    """Results as markdown with all headings of their language, English where that isn't known."""
    return _reports(spark, d).select("conv_id", _analysis().alias("page"))


@query(f"WITH {REPORTS}, {MAPS} SELECT conv_id, page FROM m")
def concept_pages(spark, d):
    """Graphs as pages with a drawing; turns with the same first word share a place."""
    return render.concept_maps(_reports(spark, d), "conv_id", "lang", "nodes", "edges")


@query(f"""WITH {REPORTS}, {MAPS} SELECT conv_id || '/analysis.md' AS path, {ANALYSIS} AS text FROM r JOIN h USING (lang)
UNION ALL SELECT conv_id || '/strategy.md', {STRATEGY} FROM r JOIN h USING (lang) UNION ALL SELECT conv_id || '/concept-map.html', page FROM m""")
def artifact_files(spark, d):
    """Three files for each result, committed together and read back."""
    scratch, c = Scratch(spark, "artifacts"), F.col
    results = scratch.keep(_reports(spark, d), "results")
    maps = render.concept_maps(results, "conv_id", "lang", "nodes", "edges")
    named = lambda rows, name, text: rows.select(F.concat(c("conv_id").cast("string"), F.lit(f"/{name}")).alias("path"), text.alias("text"))
    strategy = render.strategy_markdown(c("lang"), c("title"), c("sections"), c("points"))
    own = named(results, "analysis.md", _analysis()).unionByName(named(results, "strategy.md", strategy)).unionByName(named(maps, "concept-map.html", c("page")))
    filesink.write_files(own, scratch.path("files"))
    return filesink.read_files(spark, scratch.path("files"))


@query("SELECT conv_id, turn, role, text, place, (turn // 3)::INT AS page FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS place FROM conversations) WHERE place < 5")
def turns_paged(spark, d):
    """Turns served in pages of three numbers and read by their tokens, five of each conversation."""
    turns = table(spark, d, "conversations")
    served = paged.write_pages(turns, "conv_id", ["turn", "role", "text"], F.struct("turn", "role", "text"), 3, Scratch(spark, "pages").path("served"))
    own = paged.read_pages(spark, served, 5)
    item = F.from_json("item", "turn long, role string, text string").alias("x")
    return own.select(F.col("parent").cast("long").alias("conv_id"), "place", "page", item).select("conv_id", "x.*", "place", "page")


@query("""WITH d AS (SELECT *, split_part(text, chr(10), 1) AS head, string_split(text, chr(10)) AS lines FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
SELECT 'ResearchPlans' AS collection, 'research_plan' AS source_tool, head AS subject, CASE WHEN n_chars > 2000 THEN 'deep' ELSE 'moderate' END AS grade, lines AS parts, '[]' AS json, len(lines)::DOUBLE AS amount FROM d
UNION ALL SELECT 'ResearchFindings', 'research_assess_evidence', head, CASE WHEN toxic = 1 THEN 'SPECULATION' WHEN quality = 1 THEN 'CONFIRMED' WHEN quality = 0 THEN 'INFERENCE' ELSE '' END, [source], '[]', coalesce(quality, 0)::DOUBLE FROM d
UNION ALL SELECT 'WebSearchResults', 'web_search', head, '', []::VARCHAR[], '[{"title":"' || source || '","url":"doc:' || doc_id || '"}]', length(text)::DOUBLE FROM d""")
def research_stores(spark, d):
    """J (research_plan, research_assess_evidence, web_search): what these tools keep, appended to their collections and read back."""
    s, c = CollectionStore(spark, Scratch(spark, "research").root), F.col
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents")
    tier = F.when(c("toxic") == 1, "SPECULATION").when(c("quality") == 1, "CONFIRMED").when(c("quality") == 0, "INFERENCE").otherwise("")
    judged = docs.select("doc_id", "source", first_line().alias("claim")).join(labels, "doc_id", "left")
    sources = F.to_json(F.array(F.struct(c("source").alias("title"), F.concat(F.lit("doc:"), c("doc_id").cast("string")).alias("url"))))
    s.append("ResearchPlans", docs.select(F.lit("research_plan").alias("source_tool"), first_line().alias("topic"), F.when(c("n_chars") > 2000, "deep").otherwise("moderate").alias("scope"), F.split("text", "\n").alias("task_decomposition"), F.lit("[]").alias("phases_json")))
    s.append("ResearchFindings", judged.select(F.lit("research_assess_evidence").alias("source_tool"), "claim", tier.alias("evidence_tier"), F.array("source").alias("supporting"), F.coalesce(c("quality"), F.lit(0)).cast("double").alias("confidence")))
    s.append("WebSearchResults", docs.select(F.lit("web_search").alias("source_tool"), first_line().alias("query"), F.col("text").alias("response"), sources.alias("sources_json")))

    def told(name, subject, grade, parts, json, amount):
        return s.export(name).select(F.lit(name).alias("collection"), "source_tool", c(subject).alias("subject"), grade.alias("grade"), parts.alias("parts"), json.alias("json"), amount.cast("double").alias("amount"))

    out = told("ResearchPlans", "topic", c("scope"), c("task_decomposition"), c("phases_json"), F.size("task_decomposition"))
    out = out.unionByName(told("ResearchFindings", "claim", c("evidence_tier"), c("supporting"), F.lit("[]"), c("confidence")))
    return out.unionByName(told("WebSearchResults", "query", F.lit(""), F.array().cast("array<string>"), c("sources_json"), F.length("response")))
