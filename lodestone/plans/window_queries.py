"""Ordered rows and state machines in batch form: SURVEY A14, A19, A22-A24, B16, B20, C4, C5, E13, E22-E30, F12-F14, I1-I11."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import joins, render, state
from lodestone.operators import windows as w
from lodestone.plans.registry import query, sql_values, values
from lodestone.sources import files
from lodestone.sources.tables import table, trace


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def history_last_n(spark, d):
    """Twice the number of turns to keep."""
    return w.last_n(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 4)


@query("SELECT conv_id, count(*) AS turn_count FROM conversations GROUP BY 1")
def turn_counts(spark, d):
    """The count goes on growing."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turn_count"))


GAPS = """SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (
  SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {0} THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2"""


@query(f"SELECT user_id, session, epoch_us(start) // 1000000 AS start, n FROM ({GAPS.format('2 HOURS')})")
def session_ttl_gaps(spark, d):
    """A gap of more than the TTL begins a new session."""
    return w.sessions(trace(spark, d), "user_id", "ts", 7200).select("user_id", "session", F.unix_seconds("start").alias("start"), "n")


@query("SELECT event_id FROM events WHERE (SELECT max(ts) FROM events) - ts <= INTERVAL 2 HOURS ORDER BY ts DESC, event_id DESC LIMIT 100")
def launch_ttl(spark, d):
    """What is over its TTL goes, then the oldest beyond the cap."""
    return state.launch_window(trace(spark, d), "ts", "event_id", 7200, 100).select("event_id")


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) ORDER BY t DESC, user_id LIMIT 50")
def lru_keep(spark, d):
    """E23, I2."""
    last = trace(spark, d).groupBy("user_id").agg(F.max("ts").alias("t"))
    return w.newest(last, [F.desc("t"), F.asc("user_id")], 50).select("user_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200")
def fifo_cap(spark, d):
    """E24."""
    return w.newest(table(spark, d, "events"), [F.desc("event_id")], 200).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, us, i, us AS kept, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.i, CASE WHEN e.us - r.kept >= 1800000000 THEN e.us ELSE r.kept END, e.us - r.kept >= 1800000000 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, accepted FROM r""")
def single_active_guard(spark, d):
    """A launch within 1,800 s of the last accepted one is refused."""
    return state.single_active(trace(spark, d), "user_id", "ts", "event_id", 1800)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def job_latest_status(spark, d):
    """I8."""
    return w.latest(trace(spark, d), ["user_id"], "event_type", ["ts", "event_id"])


@query("""WITH l AS (SELECT user_id, min(ts) AS launched FROM events WHERE event_type = 'signup' GROUP BY 1), t AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS status, min(ts) AS ended FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT user_id, status, CASE WHEN launched IS NOT NULL THEN date_diff('second', launched, ended) END AS seconds FROM t LEFT JOIN l USING (user_id)""".replace("date_diff('second', launched, ended)", "(epoch_us(ended) // 1000000 - epoch_us(launched) // 1000000)"))
def interaction_lifecycle(spark, d):
    """The first terminal event; a duration only where the launch was seen."""
    return state.lifecycle(trace(spark, d), "user_id", "event_type", "ts", "event_id", "signup", ["purchase", "error"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def single_flight(spark, d):
    """One of equal requests is carried out."""
    return trace(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""SELECT user_id, event_type, CASE WHEN p IS NULL THEN 'create' WHEN us - p > 3600000000 THEN 'stale' ELSE 'hit' END AS action, count(*) AS n FROM (
SELECT user_id, event_type, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) GROUP BY 1, 2, 3""")
def cache_registry_actions(spark, d):
    """Hit, stale or create by the time since the last use of a (content, model)."""
    return state.registry_actions(trace(spark, d), ["user_id", "event_type"], "ts", "event_id", 3600)


#: Actions a of each request in SQL, with us and the time n of the key's next request.
REGISTRY_SQL = """g AS (SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lead(epoch_us(ts)) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
f AS (SELECT *, coalesce(bool_or((gap IS NULL OR gap > 7200000000) AND coalesce(value < 10, true)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS barred FROM g),
a AS (SELECT *, CASE WHEN barred THEN 'suppressed' WHEN gap <= 7200000000 THEN 'hit' WHEN coalesce(value < 10, true) THEN 'suppress' WHEN gap IS NULL THEN 'create' ELSE 'stale' END AS action FROM f)"""


@query(f"WITH {REGISTRY_SQL} SELECT user_id, event_type, event_id, action FROM a")
def cache_registry_events(spark, d):
    """What a registry does with each request; keys whose entry would be too small are suppressed."""
    return state.registry_events(trace(spark, d), ["user_id", "event_type"], "ts", "event_id", "value", 7200, 10)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' ORDER BY event_id LIMIT 50")
def trace_errors(spark, d):
    """A23."""
    return table(spark, d, "events").filter("event_type = 'error' AND ts >= timestamp_ntz '2024-01-05'").select("event_id", "user_id", "value").orderBy("event_id").limit(50)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def trace_slow(spark, d):
    """A23, F12."""
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


LINES = "SELECT doc_id, (unnest(range(len(l))))::INTEGER AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, n, hit FROM (SELECT doc_id, n, contains(line, 'idiot') AS hit, bool_or(contains(line, 'idiot')) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ({LINES})) WHERE near")
def grep_with_context(spark, d):
    """Two lines around each match."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return w.grep(lines, "doc_id", "n", "line", "idiot").select("doc_id", "n", "hit")


@query("SELECT doc_id, coalesce(nullif(string_agg(n || '. [' || lang || '] ' || line, chr(10) ORDER BY n), ''), '(none)') AS text FROM (SELECT doc_id, lang, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)) GROUP BY 1")
def findings_text(spark, d):
    """An ordered string aggregate, here of each document's lines."""
    lines = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return render.findings_text(lines, "doc_id", "n", "line", "lang")


WORDS = "SELECT conv_id, turn, unnest(range(len(l)))::INTEGER AS i, unnest(l) AS word FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '') AS l FROM conversations)"


def _words(spark, d):
    c = table(spark, d, "conversations")
    own = c.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", "[ \\n\\t]+"), lambda x: x != "")).alias("i", "word"))
    return own.withColumn("k", F.struct("conv_id", "turn"))


@query(f"SELECT conv_id, turn, i, string_agg(word, ' ') OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM ({WORDS})")
def word_context_window(spark, d):
    """E26."""
    return w.context(_words(spark, d), "k", "i", "word").select("conv_id", "turn", "i", "context")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM ({WORDS}))
SELECT conv_id, turn, i, word, 0::BIGINT AS elided FROM r WHERE n <= 35 OR r <= 20 OR r > n - 10
UNION ALL SELECT conv_id, turn, i, '... (' || (n - 30) || ' more words) ...', n - 30 FROM r WHERE n > 35 AND r = 20""")
def timeline_elide(spark, d):
    """E27."""
    return w.elide(_words(spark, d), "k", "i", "word").select("conv_id", "turn", "i", "word", "elided")


@query(f"""WITH c AS (SELECT conv_id, turn, i, word, rtrim(lower(word), ',.!?') AS p, string_agg(word, ' ') OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM ({WORDS}))
SELECT conv_id, turn, i, word, context, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i))::INTEGER AS place FROM c
WHERE len(p) > 6 OR p IN ('first', 'second', 'third', 'this', 'that', 'the', 'but', 'so', 'however', 'now', 'then', 'next', 'finally') QUALIFY place <= 15""")
def key_phrases(spark, d):
    """E28."""
    return w.key_phrases(_words(spark, d), "k", "i", "word").select("conv_id", "turn", "i", "word", "context", "place")


NODES = [("g1", f"n{i}") for i in range(10)] + [("g2", "a")]


@query(f"SELECT g, id, ((r - 1) % c)::INTEGER AS grid_x, ((r - 1) // c)::INTEGER AS grid_y FROM (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) AS r, greatest(floor(sqrt(count(*) OVER (PARTITION BY g)))::INTEGER, 1) AS c FROM ({sql_values(*NODES)}) x(g, id))")
def grid_layout(spark, d):
    """E29, E30."""
    return w.grid(values(spark, "g string, id string", *NODES), "id", "g")


PLACES, LINKS = [("a", 0, 0), ("b", 100, 50), ("c", 20, 80)], [("a", "b"), ("b", "c"), ("a", "x")]


@query(f"WITH n(id, x, y) AS ({sql_values(*PLACES)}), e(source, target) AS ({sql_values(*LINKS)}) SELECT source, target, ((a.x + b.x) / 2)::DOUBLE AS x, ((a.y + b.y) / 2)::DOUBLE AS y FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target")
def edge_midpoints(spark, d):
    """C4."""
    return joins.midpoints(values(spark, "source string, target string", *LINKS), values(spark, "id string, x double, y double", *((i, float(x), float(y)) for i, x, y in PLACES)))


@query(f"SELECT coalesce(max(x), 200) + 100 AS width, coalesce(max(y), 200) + 100 AS height FROM ({sql_values(*PLACES)}) t(id, x, y)")
def layout_extents(spark, d):
    """E19."""
    return values(spark, "id string, x int, y int", *PLACES).agg((F.coalesce(F.max("x"), F.lit(200)) + 100).alias("width"), (F.coalesce(F.max("y"), F.lit(200)) + 100).alias("height"))


SCENES, TIMELINE = [(1, "intro"), (2, None), (3, "end")], [("intro", "w1"), ("scene2", "w2"), ("other", "w3")]


@query(f"WITH s(n, scene_id) AS ({sql_values(*SCENES)}), t(scene_id, words) AS ({sql_values(*TIMELINE)}) SELECT n, coalesce(s.scene_id, 'scene' || n) AS scene_id, words FROM s LEFT JOIN t ON t.scene_id = coalesce(s.scene_id, 'scene' || n)")
def scene_timeline_join(spark, d):
    """C5, A19."""
    s = values(spark, "n int, scene_id string", *SCENES).withColumn("scene_id", F.coalesce("scene_id", F.concat(F.lit("scene"), F.col("n").cast("string"))))
    return s.join(values(spark, "scene_id string, words string", *TIMELINE), "scene_id", "left")


INDEX = [(2, "BigProblem"), (1, "Hook"), (3, "End")]


@query(f"SELECT string_agg('export {{ ' || name || ' }} from \"./' || name || '\";', chr(10) ORDER BY n) AS text FROM ({sql_values(*INDEX)}) x(n, name)")
def scene_index(spark, d):
    """A generated file as ordered text."""
    own = values(spark, "n int, name string", *INDEX).withColumn("k", F.lit(1))
    line = F.concat(F.lit("export { "), "name", F.lit(' } from "./'), "name", F.lit('";'))
    return render.ordered_text(own, "k", "n", line).select("text")


DOTENV = [(1, "# comment"), (2, "export API_KEY=abc123"), (3, 'NAME="quoted value"'), (4, "URL=https://host?a=1&b=2"), (5, "EMPTY="), (6, "no equals"), (7, "NAME='again'"), (8, "  SPACED = x y ")]
KV = "'^\\s*(?:export\\s+)?([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*?)\\s*$'"


@query(f"""SELECT k AS name, arg_max(CASE WHEN regexp_matches(v, '^".*"$') OR regexp_matches(v, '^''.*''$') THEN substr(v, 2, len(v) - 2) ELSE v END, n) AS value FROM (SELECT n, regexp_extract(line, {KV}, 1) AS k, regexp_extract(line, {KV}, 2) AS v FROM ({sql_values(*DOTENV)}) x(n, line)) WHERE k <> '' GROUP BY 1""")
def dotenv_parse(spark, d):
    """The last of equal keys wins."""
    return files.parse_dotenv(values(spark, "n int, line string", *DOTENV))


ENVELOPES = [("a.json", '{"cached_at":"2025-01-02T00:00:00","content_id":"v1","analysis":{"t":1}}'), ("b.json", "not json"), ("c.json", '{"content_id":"v2"}'), ("d.json", '{"cached_at":"2025-01-01T00:00:00","content_id":"v3","analysis":{"t":2}}')]


@query("SELECT * FROM (VALUES ('a.json', 'v1', '2025-01-02T00:00:00'), ('d.json', 'v3', '2025-01-01T00:00:00'), ('c.json', 'v2', NULL)) x(file, content_id, cached_at)")
def cache_catalog(spark, d):
    """What can't be read is skipped; the newest first, those without a time last."""
    return files.cache_entries(values(spark, "file string, body string", *ENVELOPES)).select("file", "content_id", "cached_at")


@query("SELECT 'v1' AS content_id, '{\"t\":1}' AS analysis")
def cache_lookup(spark, d):
    """Entries within the TTL."""
    return files.cache_lookup(files.cache_entries(values(spark, "file string, body string", *ENVELOPES)), "2025-01-02 12:00:00", 86400).select("content_id", "analysis")


REGISTRY = [('{"v1": {"m1": "c1", "m2": "c2"}, "v2": 5, "v3": {"m1": 7}, "v4": {"m1": "c4"}}',)]


@query("SELECT * FROM (VALUES ('v1', 'm1', 'c1'), ('v1', 'm2', 'c2'), ('v4', 'm1', 'c4')) x(content_id, model, name)")
def registry_read(spark, d):
    """Nodes of another type are ignored."""
    return files.registry_entries(values(spark, "body string", *REGISTRY))


VIDEO = ['{"items":[{"id":"v1","snippet":{"title":"T","channelTitle":"C","categoryId":"27","tags":["a","b"]},"contentDetails":{"duration":"PT1H2M3S","caption":"true"},"statistics":{"viewCount":"1500000000","likeCount":"7"}}]}', '{"items":[]}']


@query("SELECT 'v1' AS video_id, 'T' AS title, 'C' AS channel_title, 'Education' AS category, 1500000000::BIGINT AS view_count, 7::BIGINT AS like_count, 0::BIGINT AS comment_count, 3723::BIGINT AS duration_seconds, '1:02:03' AS duration_display, true AS has_captions")
def video_metadata(spark, d):
    """A nested response as a flat row."""
    return files.video_rows(values(spark, "body string", *((v,) for v in VIDEO))).drop("tags")


PLAYLIST = '{"pageInfo":{"totalResults":3},"items":[{"snippet":{"title":"A","position":0,"resourceId":{"videoId":"x"}}},{"snippet":{"title":"B","position":1,"resourceId":{"videoId":"y"}}},{"snippet":{"title":"C","position":2,"resourceId":{"videoId":"z"}}}]}'


@query("SELECT * FROM (VALUES (0::BIGINT, 'x', 'A'), (1, 'y', 'B')) t(position, video_id, title)")
def playlist_items(spark, d):
    """Capped paging."""
    return files.playlist_rows(values(spark, "body string", (PLAYLIST,)), 2)


TURNS = [("i1", '[{"text":"first"},{"content":[{"type":"text","text":"second"},{"type":"image"}]}]'), ("i2", "[]")]


@query("SELECT * FROM (VALUES ('i1', 'first' || chr(10) || chr(10) || 'second'), ('i2', '')) t(id, report)")
def report_extraction(spark, d):
    """Texts of nested outputs."""
    return files.report_texts(values(spark, "id string, outputs string", *TURNS))


COMMENTS = [("v", "good", 5), ("v", "bad", 9), ("v", "fine", 1), ("v", "ok", 7), ("w", "x", 0)]


@query(f"SELECT v, count(*) AS comments, list(c ORDER BY likes DESC, c)[1:3] AS top FROM ({sql_values(*COMMENTS)}) x(v, c, likes) GROUP BY 1")
def comment_fallback(spark, d):
    """Count and the three most liked."""
    own = values(spark, "v string, c string, likes int", *COMMENTS)
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("likes")).alias("n"), "c"))), 1, 3), lambda s: s["c"])
    return own.groupBy("v").agg(F.count("*").alias("comments"), top.alias("top"))
