"""Scalar functions and gates: SURVEY D8-D19, E6-E8, E20-E21, H1-H42, A13-A15, A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars as x
from lodestone.operators import quality
from lodestone.plans.registry import query, sql_values, values
from lodestone.sources.tables import table


def _strings(spark, rows):
    return values(spark, "s string", *((r,) for r in rows))


def _sql(rows):
    return f"({sql_values(*((r,) for r in rows))}) x(s)"


def _shaped(spark, d, name, key, forms):
    """n, s: a text for each row of a table, of one of the forms by turns, with the row's key where it has {n}."""
    form = F.element_at(F.array(*(F.lit(f).cast("string") for f in forms)), (F.pmod(key, F.lit(len(forms))) + 1).cast("int"))
    return table(spark, d, name).select(F.col(key).alias("n"), F.replace(form, F.lit("{n}"), F.col(key).cast("string")).alias("s"))


def _shaped_sql(name, key, forms):
    texts = ", ".join("NULL" if f is None else "'" + f.replace("'", "''") + "'" for f in forms)
    return f"(SELECT {key} AS n, replace([{texts}][{key} % {len(forms)} + 1], '{{n}}', {key}::VARCHAR) AS s FROM {name}) x"


DURATIONS = ["PT{n}M7S", "PT1H{n}M9S", "PT{n}H", "PT{n}S", "PT1H{n}S", "", None, "lasts {n}", "P{n}DT2H", "PT{n}.5S", "PT", "XPT{n}S"]
PART = "coalesce(try_cast(nullif(regexp_extract(s, '^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?', {}), '') AS BIGINT), 0)"
SECONDS = f"{PART.format(1)} * 3600 + {PART.format(2)} * 60 + {PART.format(3)}"
SHOW = "CASE WHEN n <= 0 THEN '0:00' WHEN n >= 3600 THEN (n // 3600) || ':' || lpad((n % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((n % 60)::VARCHAR, 2, '0') ELSE (n // 60) || ':' || lpad((n % 60)::VARCHAR, 2, '0') END"


@query(f"SELECT event_id, s, n AS seconds, {SHOW} AS shown, CASE WHEN n > 0 AND n < 300 THEN 2.0 WHEN n > 1800 THEN 1.0 END::DOUBLE AS rate FROM (SELECT n AS event_id, s, {SECONDS} AS n FROM {_shaped_sql('events', 'event_id', DURATIONS)})")
def duration_parse_format(spark, d):
    """H1, H2, H34."""
    own = _shaped(spark, d, "events", "event_id", DURATIONS).withColumnRenamed("n", "event_id").withColumn("seconds", x.duration_seconds(F.col("s")))
    return own.select("event_id", "s", "seconds", x.format_seconds(F.col("seconds")).alias("shown"), x.sampling_rate(F.col("seconds")).alias("rate"))


@query(f"SELECT event_id, {SHOW} AS shown FROM (SELECT event_id, event_id % 9000 AS n FROM events)")
def duration_format_events(spark, d):
    """H2 over a table."""
    return table(spark, d, "events").select("event_id", x.format_seconds(F.col("event_id") % 9000).alias("shown"))


TIMES = ["{n}:30", "7:{n}", "1:{n}:07", "at {n}", "{n}:{n}", "99:99", "4:03:02:01", None, "00:{n}"]


@query(f"""SELECT n AS event_id, s, coalesce(regexp_matches(s, '^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$'), false) AS ok,
CASE WHEN coalesce(regexp_matches(s, '^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$'), false) THEN list_reduce(list_prepend(0, list_transform(string_split(s, ':'), lambda p: p::INTEGER)), lambda a, b: a * 60 + b) END AS seconds FROM {_shaped_sql('events', 'event_id', TIMES)}""")
def timecode_seconds(spark, d):
    """H3, H4, H9."""
    own = _shaped(spark, d, "events", "event_id", TIMES).withColumnRenamed("n", "event_id").withColumn("ok", x.is_timecode(F.col("s")))
    return own.select("event_id", "s", "ok", F.when(F.col("ok"), x.timecode_seconds(F.col("s"))).alias("seconds"))


SLUG = "nullif(substr(trim(regexp_replace(regexp_replace(replace(lower({0}), ' ', '-'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-'), 1, 50), '')"


@query(f"SELECT doc_id, {SLUG.format('split_part(text, chr(10), 1)')} AS slug FROM documents")
def slugify_titles(spark, d):
    """H5."""
    return table(spark, d, "documents").select("doc_id", x.slug(F.substring_index("text", "\n", 1)).alias("slug"))


#: title, component, key.
NAMES = [
    ("Deep Water", "DeepWaterScene", "deep_water"),
    ("The Long Way Home", "TheLongWayHomeScene", "long_way_home"),
    ("It's Who's Left?", "ItsWhosLeftScene", "its_whos_left"),
    ("it’s late", "ItsLateScene", "its_late"),
    ("AI-driven design", "AIDrivenDesignScene", "aidriven_design"),
    ("v2.0 of Node.js", "V20OfNodeJsScene", "v20_of_nodejs"),
    ("7 Rules", "Scene7RulesScene", "7_rules"),
    ("a", "AScene", ""),
    ("The", "TheScene", ""),
    ("AN OPEN DOOR", "ANOPENDOORScene", "open_door"),
    ("the_end _ of", "TheEndOfScene", "the_end_of"),
    ("  spaced \t out ", "SpacedOutScene", "spaced_out"),
    ("?!", "GeneratedScene", ""),
    ("", "GeneratedScene", ""),
    ("x" * 1500, "X" + "x" * 1499 + "Scene", "x" * 1500),
    (" ".join(["ab"] * 1200), "Ab" * 1200 + "Scene", "_".join(["ab"] * 1200)),
]


@query(f"SELECT s, component FROM ({sql_values(*NAMES)}) x(s, component, key)")
def component_names(spark, d):
    """H6."""
    return _strings(spark, [n[0] for n in NAMES]).select("s", x.component_name(F.col("s")).alias("component"))


@query(f"SELECT s, key FROM ({sql_values(*NAMES)}) x(s, component, key)")
def scene_keys(spark, d):
    """H7."""
    return _strings(spark, [n[0] for n in NAMES]).select("s", x.scene_key(F.col("s")).alias("key"))


@query("SELECT doc_id, doc_id || '_analyze_' || CASE WHEN lang = 'en' THEN 'default' ELSE substr(md5(lang), 1, 8) END || '_' || substr(md5('model-1'), 1, 8) AS key FROM documents")
def cache_keys(spark, d):
    """H10."""
    own = table(spark, d, "documents")
    return own.select("doc_id", x.cache_key(F.col("doc_id").cast("string"), F.lit("analyze"), F.when(F.col("lang") != "en", F.col("lang")), F.lit("model-1")).alias("key"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS h16, substr(sha256(lang), 1, 12) AS h12 FROM documents")
def content_hash(spark, d):
    """H11."""
    return table(spark, d, "documents").select("doc_id", x.short_hash(F.col("text")).alias("h16"), x.short_hash(F.col("lang"), 12).alias("h12"))


URLS = ["https://www.youtube.com/watch?v=deep-{n}", "https://youtu.be/sq_{n}?t=9", "https://www.youtube.com/shorts/s{n}", "https://m.youtube.com/embed/{n}/", "https://youtube.com.mirror{n}.test/watch?v=q", "https://video{n}.test/watch?v=k{n}", "../{n}/out", "dir{n}/file", "v%00{n}", "back\\{n}", "https://music.youtube.com/watch?v={n}&list=LM_{n}", "https://www.youtube.com/playlist?list=OL{n}", "", None, "id_{n}"]
HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
VIDEO, SHORT = "('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com')", "('youtu.be', 'www.youtu.be')"


@query(f"""WITH u AS (SELECT s, replace(trim(s), '\\', '') AS u, n FROM {_shaped_sql('documents', 'doc_id', URLS)}), p AS (SELECT *, {HOST.format('u')} AS host, {PATH.format('u')} AS path FROM u),
f AS (SELECT n, s, coalesce(CASE WHEN host IN {SHORT} THEN regexp_extract(path, '^/([^/&]*)', 1) END, CASE WHEN host IN {VIDEO} THEN coalesce(nullif(regexp_extract(u, '[?&]v=([^&#]*)', 1), ''), nullif(regexp_extract(path, '^/(?:shorts|embed|live)/([^/&]*)', 1), '')) END, CASE WHEN NOT contains(u, '://') THEN u END) AS f FROM p)
SELECT n, s, CASE WHEN regexp_full_match(f, '[A-Za-z0-9_-]{{1,64}}') THEN f END AS video_id, CASE WHEN regexp_full_match(f, '[A-Za-z0-9_-]{{1,64}}') THEN 'https://www.youtube.com/watch?v=' || f END AS url FROM f""")
def video_id_extract(spark, d):
    """H13, H14, H15."""
    own = _shaped(spark, d, "documents", "doc_id", URLS).select("n", "s", x.video_id(F.col("s")).alias("video_id"))
    return own.withColumn("url", x.video_url(F.col("video_id")))


@query(f"SELECT n, s, coalesce(h IN {VIDEO} OR h IN {SHORT}, false) AS is_video, CASE WHEN (h IN {VIDEO} OR h IN {SHORT}) AND regexp_full_match(l, '[A-Za-z0-9_-]{{1,64}}') THEN l END AS playlist FROM (SELECT n, s, {HOST.format('s')} AS h, regexp_extract(s, '[?&]list=([^&#]*)', 1) AS l FROM {_shaped_sql('documents', 'doc_id', URLS)})")
def playlist_id(spark, d):
    """H16, H17."""
    return _shaped(spark, d, "documents", "doc_id", URLS).select("n", "s", x.is_video_url(F.col("s")).alias("is_video"), x.playlist_id(F.col("s")).alias("playlist"))


PAPERS = ["https://arxiv.org/abs/1905.{n}v3", "http://arxiv.org/pdf/1905.{n}.pdf", "https://www.arxiv.org/abs/1905.{n}/", "https://arxiv.org/abs/{n}.7?from=list", "https://papers.test/abs/{n}", "https://arxiv.org/list/math/{n}", None]


@query(f"SELECT n, s, CASE WHEN f <> '' THEN 'https://arxiv.org/pdf/' || f || '.pdf' ELSE s END AS pdf FROM (SELECT n, s, regexp_extract(s, '^https?://(?:www\\.)?arxiv\\.org/(?:abs|pdf)/([^?#]+?)(?:\\.pdf)?/?(?:[?#].*)?$', 1) AS f FROM {_shaped_sql('documents', 'doc_id', PAPERS)})")
def arxiv_normalise(spark, d):
    """H18."""
    return _shaped(spark, d, "documents", "doc_id", PAPERS).select("n", "s", x.paper_pdf(F.col("s")).alias("pdf"))


STORES = ["localhost:{n}", "172.40.3.9:{n}", "172.20.3.9:{n}", "${KEPT_IN_{n}:-}", "", None, "https://kept{n}.test", "10.9.8.7", "kept{n}.test", "192.168.7.7:{n}", " http://kept{n}.test ", "127.0.0.9:{n}"]
PRIVATE = "(h IN ('localhost', '0.0.0.0') OR regexp_matches(h, '^(127|10)\\.[0-9.]+$|^192\\.168\\.[0-9.]+$|^172\\.(1[6-9]|2[0-9]|3[01])\\.[0-9.]+$'))"


@query(f"SELECT n, s, CASE WHEN t = '' OR starts_with(t, '${{') THEN '' WHEN regexp_matches(t, '^https?://') THEN t WHEN {PRIVATE} THEN 'http://' || t ELSE 'https://' || t END AS url FROM (SELECT n, s, trim(coalesce(s, '')) AS t, lower(regexp_extract(trim(coalesce(s, '')), '^([^/:]*)', 1)) AS h FROM {_shaped_sql('documents', 'doc_id', STORES)})")
def store_url(spark, d):
    """H19."""
    return _shaped(spark, d, "documents", "doc_id", STORES).select("n", "s", x.store_url(F.col("s")).alias("url"))


@query(f"""SELECT page_id, CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) <> 'https' THEN 'not https' WHEN h = '' THEN 'no host' ELSE 'ok' END AS policy, h AS host FROM (SELECT page_id, url, {HOST.format('url')} AS h FROM pages)""")
def url_policy(spark, d):
    """H30-H32 over a table."""
    return table(spark, d, "pages").select("page_id", x.url_policy(F.col("url")).alias("policy"), x.url_host(F.col("url")).alias("host"))


GUARDED = [
    ("https://a.b/c", "ok"), ("http://a.b", "not https"), ("ftp://a", "not https"), ("https://u:p@a.b/", "user info"), ("https://u@a.b/", "user info"), ("https://@a.b/", "ok"), ("https:///x", "no host"), ("https://a.b/x@y", "ok"),
    ("https://0.1.2.3", "blocked address"), ("https://127.0.0.1/", "blocked address"), ("https://10.1.2.3", "blocked address"), ("https://172.20.0.1", "blocked address"), ("https://172.32.0.1", "ok"), ("https://192.168.0.1:8", "blocked address"), ("https://169.254.1.1", "blocked address"), ("https://224.0.0.1", "blocked address"), ("https://255.255.255.255", "blocked address"),
    ("https://100.64.0.1", "ok"), ("https://192.0.0.8", "blocked address"), ("https://192.0.0.9", "ok"), ("https://192.0.2.77", "blocked address"), ("https://192.0.3.1", "ok"), ("https://198.18.0.1", "blocked address"), ("https://198.19.255.1", "blocked address"), ("https://198.20.0.1", "ok"), ("https://198.51.100.7", "blocked address"), ("https://203.0.113.9", "blocked address"), ("https://8.8.8.8", "ok"), ("https://localhost/", "blocked address"),
    ("https://[::1]/", "blocked address"), ("https://[::]/", "blocked address"), ("https://[fe80::1%25eth0]:8/", "blocked address"), ("https://[fd12:3456::1]", "blocked address"), ("https://[ff02::1]", "blocked address"), ("https://[2001:db8::1]", "blocked address"), ("https://[2001:0:1::]", "blocked address"), ("https://[2001:3::5]", "ok"), ("https://[2001:21::5]", "ok"), ("https://[2001:4860:4860::8888]/x", "ok"), ("https://[2606:4700:4700:0:0:0:0:1111]", "ok"), ("https://[::ffff:10.0.0.1]", "blocked address"), ("https://[2002:a00:1::]", "blocked address"), ("https://[64:ff9b:1::1]", "blocked address"), ("https://[5f00::1]", "blocked address"),
]


@query(f"SELECT s, policy FROM ({sql_values(*GUARDED)}) x(s, policy)")
def url_policy_classes(spark, d):
    """Refused classes of addresses."""
    return _strings(spark, [g[0] for g in GUARDED]).select("s", x.url_policy(F.col("s")).alias("policy"))


@query("SELECT page_id, contains(lower(html), '<html') AND contains(lower(html), '</html>') AS ok FROM pages")
def html_gate(spark, d):
    """H28."""
    return table(spark, d, "pages").select("page_id", x.looks_like_html(F.col("html")).alias("ok"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, d):
    """H26."""
    return table(spark, d, "pages").select("page_id", x.html_escape(F.col("url")).alias("escaped"))


#: text, links.
LINKS = [
    ("see [a](x/y.md) and [b](https://w) [c](#f) [d](z.md#part?q)", ["x/y.md", "z.md#part?q"]),
    ("none", []),
    ("[e](../out.md) [f](mailto:a@b) [](g.md) [h](?q=1) [i](http.md)", ["../out.md", "mailto:a@b", "g.md", "http.md"]),
    ("[j [k](l.md) ](m.md)\n[n](\no.md)", ["l.md", "\no.md"]),
    (None, None),
]


@query(f"SELECT s, links FROM ({sql_values(*LINKS)}) x(s, links)")
def markdown_links(spark, d):
    """What is left to resolve."""
    return _strings(spark, [t for t, _ in LINKS]).select("s", x.markdown_links(F.col("s")).alias("links"))


LINKED = [("/w/out", "analysis.md", "[a](strategy.md) [b](./img/../strategy.md#top) [c](missing.md) [d](../out/strategy.md) [e](../other/x.md) [f](/etc/passwd) [g](mailto:a@b) [h](../../../../w/out/strategy.md)"), ("/w/out", "strategy.md", "[i](analysis.md?x) [j](sub/../../out2/y.md)")]
THERE = [("/w/out/analysis.md",), ("/w/out/strategy.md",), ("/w/other/x.md",), ("/w/out2/y.md",)]


@query("SELECT * FROM (VALUES ('/w/out', 'analysis.md', 'missing.md', 'broken'), ('/w/out', 'analysis.md', '../other/x.md', 'escapes'), ('/w/out', 'analysis.md', '/etc/passwd', 'escapes'), ('/w/out', 'analysis.md', 'mailto:a@b', 'broken'), ('/w/out', 'strategy.md', 'sub/../../out2/y.md', 'escapes')) t(root, name, link, issue)")
def link_issues(spark, d):
    """Links that leave their folder, and broken ones."""
    return quality.link_issues(values(spark, "root string, name string, content string", *LINKED), values(spark, "path string", *THERE))


SHOTS = ["a [SCREENSHOT:1:05:the chart] b [SCREENSHOT:12:30:end]", "none"]


@query(f"SELECT s, lpad(regexp_extract(m, ':([0-9]+):', 1), 2, '0') || ':' || regexp_extract(m, ':[0-9]+:([0-9]{{2}}):', 1) AS time, regexp_extract(m, ':[0-9]+:[0-9]{{2}}:([^\\]]*)', 1) AS label FROM (SELECT s, unnest(regexp_extract_all(s, '\\[SCREENSHOT:[0-9]+:[0-9]{{2}}:[^\\]]*\\]')) AS m FROM {_sql(SHOTS)})")
def screenshot_markers(spark, d):
    """H29."""
    return _strings(spark, SHOTS).select("s", F.explode(x.screenshots(F.col("s"))).alias("m")).select("s", F.col("m.time").alias("time"), F.col("m.text").alias("label"))


#: text, code.
CODE = [
    ("text ```tsx\nconst a = 1;\n``` end", "const a = 1;"),
    ("```ts\nb\n``` and ```\nc\n```", "b"),
    ("```typescript let d = 2```", "let d = 2"),
    ("```python\nx\n```", "python\nx"),
    ("``` ```", ""),
    ("  import x\nexport y \n", "import x\nexport y"),
    ("importance of exports", "importance of exports"),
    ("import alone", None),
    ("```ts\nnever closed; import, export", "```ts\nnever closed; import, export"),
    ("", None),
    (None, None),
]


@query(f"SELECT s, code FROM ({sql_values(*CODE)}) x(s, code)")
def code_extraction(spark, d):
    """H8."""
    return _strings(spark, [t for t, _ in CODE]).select("s", x.fenced_code(F.col("s")).alias("code"))


MESSAGES = ["HTTP 429 for request {n}", "daily QUOTA of {n} used up", "resource_exhausted ({n})", "Timeout: {n} ms", "status 503, try {n}", "Service Unavailable until {n}", "status 400 in {n}", "no row {n}", "denied to user {n}", "extension .{n}", None, "boom {n}"]


@query(f"""SELECT n, s, coalesce(regexp_matches(lower(s), '429|quota|resource_exhausted|timeout|503|service unavailable'), false) AS retryable FROM {_shaped_sql('events', 'event_id', MESSAGES)}""")
def retryable(spark, d):
    """D18, H23."""
    return _shaped(spark, d, "events", "event_id", MESSAGES).select("n", "s", x.retryable(F.col("s")).alias("retryable"))


#: message, kind, category, whether to try again, seconds to wait.
ERRORS = [
    ("answered 429", None, "API_QUOTA_EXCEEDED", True, 60),
    ("over the quota of today", None, "API_QUOTA_EXCEEDED", True, 60),
    ("code RESOURCE_EXHAUSTED", None, "API_QUOTA_EXCEEDED", True, 60),
    ("403 Permission denied", None, "API_PERMISSION_DENIED", False, None),
    ("403 Forbidden", None, "VIDEO_RESTRICTED", False, None),
    ("Permission denied", None, "UNKNOWN", False, None),
    ("Permission denied", "permission", "PERMISSION_DENIED", False, None),
    ("400 Bad Request", None, "API_INVALID_ARGUMENT", False, None),
    ("400 and 429", None, "API_QUOTA_EXCEEDED", True, 60),
    ("400 MIME type", None, "API_INVALID_ARGUMENT", False, None),
    ("Invalid thinking level 'x'", None, "API_INVALID_ARGUMENT", False, None),
    ("404 page", None, "VIDEO_UNAVAILABLE", False, None),
    ("This is private", None, "VIDEO_PRIVATE", False, None),
    ("503 Service Unavailable", None, "VIDEO_UNAVAILABLE", False, None),
    ("Request timeout after 5", None, "NETWORK_ERROR", True, None),
    ("it timed out", None, "NETWORK_ERROR", True, None),
    ("anything", "timeout", "NETWORK_ERROR", True, None),
    ("404", "network", "NETWORK_ERROR", True, None),
    ("403", "url policy", "URL_POLICY_BLOCKED", False, None),
    ("no such file", "file not found", "FILE_NOT_FOUND", False, None),
    ("404 no such file", "file not found", "VIDEO_UNAVAILABLE", False, None),
    ("Unsupported video extension .x", None, "FILE_UNSUPPORTED", False, None),
    ("unsupported extension", None, "UNKNOWN", False, None),
    ("Weaviate refused", None, "WEAVIATE_CONNECTION", True, None),
    ("weaviate: collection exists", None, "WEAVIATE_SCHEMA", False, None),
    ("weaviate batch lost", None, "WEAVIATE_IMPORT", False, None),
    ("weaviate?", None, "WEAVIATE_QUERY", False, None),
    ("Connection refused", None, "UNKNOWN", False, None),
    ("Not found", None, "UNKNOWN", False, None),
    (None, None, "UNKNOWN", False, None),
]


@query(f"SELECT s, kind, category, again, retry_after FROM ({sql_values(*ERRORS)}) x(s, kind, category, again, retry_after)")
def error_categories(spark, d):
    """The first category of the ladder that fits."""
    own = values(spark, "s string, kind string", *(e[:2] for e in ERRORS)).withColumn("category", x.error_category(F.col("s"), F.col("kind")))
    return own.withColumn("again", x.retry_category(F.col("category"))).withColumn("retry_after", x.retry_after(F.col("category")))


@query("SELECT n, least(1.0 * pow(2, n), 60.0)::DOUBLE AS seconds FROM range(10) t(n)")
def backoff(spark, d):
    """H24."""
    return spark.range(10).select(F.col("id").alias("n"), x.backoff(F.col("id")).alias("seconds"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    """A field of a JSON text."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


JSONS = ['{"a":{n}}', "[{n},2]", "no json {n}", '"s{n}"', "{n}", None, "[{n}"]


@query(f"SELECT n, s, coalesce(CASE WHEN json_valid(s) THEN s END, s) AS j FROM {_shaped_sql('events', 'event_id', JSONS)}")
def json_lenient(spark, d):
    """What isn't JSON stays as it is."""
    return _shaped(spark, d, "events", "event_id", JSONS).select("n", "s", x.lenient_json(F.col("s")).alias("j"))


PAIRS = [(1, None), (2, ""), (3, "v")]


@query(f"SELECT id, coalesce(nullif(s, ''), 'd') AS truthy, coalesce(s, 'd') AS present FROM ({sql_values(*PAIRS)}) x(id, s)")
def defaults(spark, d):
    """Two kinds of default."""
    return values(spark, "id int, s string", *PAIRS).select("id", x.truthy(F.col("s"), F.lit("d")).alias("truthy"), x.present(F.col("s"), F.lit("d")).alias("present"))


TAGS = [(1, [str(i) for i in range(12)]), (2, []), (3, None), (4, ["a"])]


@query(f"SELECT id, coalesce(nullif(array_to_string(t[1:10], ', '), ''), 'none') AS tags FROM ({sql_values(*TAGS)}) x(id, t)")
def tag_list(spark, d):
    """H42, F16."""
    return values(spark, "id int, t array<string>", *TAGS).select("id", x.tag_list(F.col("t")).alias("tags"))


PATHS = ["/in/{n}.PDF", "b/c{n}.html", "plain{n}", "x{n}.tar.gz", "/root/app/{n}.md", "/root/application/{n}.mp4", "/root/app"]
MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in x.MIME_TYPES.items())


@query(f"SELECT n, s, parse_filename(s) AS name, CASE lower(regexp_extract(parse_filename(s), '\\.([^.]+)$', 1)) {MIME} END AS mime, s = '/root/app' OR starts_with(s, '/root/app/') AS inside FROM {_shaped_sql('documents', 'doc_id', PATHS)}")
def file_paths(spark, d):
    """H20, H38, H33, D16."""
    s = F.col("s")
    return _shaped(spark, d, "documents", "doc_id", PATHS).select("n", "s", x.basename(s).alias("name"), x.mime_type(s).alias("mime"), x.within(s, "/root/app").alias("inside"))


STAMPS = [("ok", 0, "00:30"), ("ok", 1, "02:15"), ("ok", 2, "10:00"), ("bad", 0, "05:00"), ("bad", 1, "01:00"), ("bad", 2, "03:00"), ("mix", 0, "02:00"), ("mix", 1, "invalid"), ("mix", 2, "01:30"), ("h", 0, "1:00:00"), ("h", 1, "1:30:00")]
SEC = "list_reduce(list_prepend(0, list_transform(string_split(t, ':'), lambda p: p::INTEGER)), lambda a, b: a * 60 + b)"
OK_TIME = "regexp_matches(t, '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$')"


@query(f"""WITH s(doc, i, t) AS ({sql_values(*STAMPS)}), g AS (SELECT doc, i, {SEC} AS n FROM s WHERE {OK_TIME}),
l AS (SELECT doc, i, n, lag(n) OVER (PARTITION BY doc ORDER BY i) AS b FROM g)
SELECT doc, i, 'invalid format' AS issue FROM s WHERE NOT {OK_TIME} UNION ALL SELECT doc, i, 'out of order' FROM l WHERE n < b""")
def timestamps_order_check(spark, d):
    """Invalid rows are skipped; a late row becomes the new previous one."""
    return quality.timestamp_issues(values(spark, "doc string, i int, t string", *STAMPS), "doc", "i", "t")


COVER = [("a", "09:30", 600), ("a", "01:00", 600), ("b", "03:00", 600), ("c", "20:00", 600), ("d", "01:00", 0), ("e", "bad", 600), ("e", "1:xx", 600), ("e", "", 600), ("f", "120:30", 14460), ("g", "5", 10), ("h", "0:0:1:30", 180), ("i", "-5", 10), ("j", None, 10)]


@query("SELECT * FROM (VALUES ('a', 0.95::DOUBLE), ('b', 0.3), ('c', 1.0), ('d', 1.0), ('e', 0.0), ('f', 0.5), ('g', 0.5), ('h', 0.5), ('i', 0.0), ('j', 0.0)) t(doc, coverage)")
def coverage_ratio(spark, d):
    """E6."""
    return quality.coverage(values(spark, "doc string, t string, duration int", *COVER), "doc", "t", "duration")


LAST = [(1, 570, 600, 3), (2, 180, 600, 2), (3, 180, 0, 2), (4, None, 600, 0), (5, None, 600, 1)]


@query(f"SELECT id, duration > 0 AND n > 0 AND coalesce(last, 0) / duration < 0.9 AS issue FROM ({sql_values(*LAST)}) x(id, last, duration, n)")
def coverage_threshold(spark, d):
    """E7."""
    v = values(spark, "id int, last int, duration int, n int", *LAST)
    return v.select("id", quality.coverage_issue(F.col("last"), F.col("duration"), F.col("n")).alias("issue"))


POINTS = [("a", ["short", "  also short  ", "a point that is long enough to stay"]), ("b", [])]


@query(f"SELECT doc, n::INTEGER AS n, len(trim(item))::INTEGER AS length FROM (SELECT doc, unnest(p) AS item, generate_subscripts(p, 1) - 1 AS n FROM ({sql_values(*POINTS)}) x(doc, p)) WHERE len(trim(item)) < 20")
def key_point_length(spark, d):
    """E21."""
    return quality.short_items(values(spark, "doc string, p array<string>", *POINTS), "doc", "p")


ISSUES = [("a", "edges", "2 x"), ("a", "edges", "1 y"), ("b", "links", "z")]
CHECKS = ["edges", "links", "html"]
REPORT = f"""WITH i(doc, chk, issue) AS ({sql_values(*ISSUES)}), k(doc) AS (VALUES ('a'), ('b'), ('c')), c(chk) AS (VALUES ('edges'), ('links'), ('html')),
r AS (SELECT doc, chk, count(issue) = 0 AS passed, coalesce(string_agg(issue, '; ' ORDER BY issue), '') AS message FROM k CROSS JOIN c LEFT JOIN i USING (doc, chk) GROUP BY 1, 2)"""


@query(f"{REPORT} SELECT doc, chk, passed, message FROM r")
def quality_report(spark, d):
    """E14."""
    return quality.report(values(spark, "doc string, chk string, issue string", *ISSUES), "doc", "chk", "issue", CHECKS, values(spark, "doc string", ("a",), ("b",), ("c",)))


@query(f"{REPORT} SELECT doc, CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY 1")
def quality_verdict(spark, d):
    """E8."""
    return quality.verdict(quality_report(spark, d), "doc")


ARGS = [(1, "u", None, None), (2, "u", "f", None), (3, None, None, None), (4, None, None, "t")]


@query(f"SELECT id, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = 1 AS ok FROM ({sql_values(*ARGS)}) x(id, a, b, c)")
def exactly_one_of(spark, d):
    """D13."""
    own = values(spark, "id int, a string, b string, c string", *ARGS)
    return own.select("id", (F.size(F.filter(F.array("a", "b", "c"), lambda v: v.isNotNull())) == 1).alias("ok"))


@query("SELECT doc_id, len(text) >= 10 AND n_chars > 0 AND lang IN ('en', 'de', 'fr', 'es') AS valid FROM documents")
def model_constraints(spark, d):
    """D15, H36."""
    return table(spark, d, "documents").select("doc_id", ((F.length("text") >= 10) & (F.col("n_chars") > 0) & F.lower(F.trim("lang")).isin("en", "de", "fr", "es")).alias("valid"))
