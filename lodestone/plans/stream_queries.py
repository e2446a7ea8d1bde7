"""Streaming and provider queries: SURVEY I1-I13, A9, A20, A21, E5, E12, E18, J."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import annotate as a
from lodestone.plans.registry import query
from lodestone.plans.window_queries import REGISTRY_SQL
from lodestone.runtime import Scratch
from lodestone.sources.tables import table
from lodestone.streaming import machines as m
from lodestone.streaming.capacity import run_capped
from lodestone.streaming.registry import PROVIDER, registry_stream

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, d):
    """The events as files that arrive in time order, a slice of them with each micro-batch."""
    scratch = Scratch(spark, "stream")
    m.write_slices(table(spark, d, "events"), "ts", scratch.path("in"))
    return m.read_events(spark, scratch.path("in"), EVENTS), scratch


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_latest_status(spark, d):
    """I8."""
    s, scratch = _stream(spark, d)
    return m.run_updates(m.latest_status(s), scratch.path("out"), scratch.path("c"), ["user_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_type_counts(spark, d):
    """Counts in update mode."""
    s, scratch = _stream(spark, d)
    return m.run_updates(s.groupBy("event_type").agg(F.count("*").alias("n")), scratch.path("out"), scratch.path("c"), ["event_type"])


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(spark, d):
    """I10."""
    s, scratch = _stream(spark, d)
    return m.run_to_parquet(m.single_flight(s, ["user_id", "event_type"], "400 days").select("user_id", "event_type", F.lit(1).cast("long").alias("n")), scratch.path("out"), scratch.path("c"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, us, i, us AS kept, true AS accepted FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.i, CASE WHEN e.us - r.kept >= 1800000000 THEN e.us ELSE r.kept END, e.us - r.kept >= 1800000000 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, accepted FROM r""")
def stream_single_active(spark, d):
    """I5 with keyed state."""
    s, scratch = _stream(spark, d)
    return m.run_to_parquet(m.single_active(s), scratch.path("out"), scratch.path("c"))


@query("SELECT conv_id, count(*) AS turn_count, list(text ORDER BY turn)[-4:] AS history FROM conversations GROUP BY 1")
def stream_history(spark, d):
    """The last four texts of each session."""
    scratch = Scratch(spark, "stream")
    m.write_slices(table(spark, d, "conversations"), "turn", scratch.path("in"))
    s = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 4).parquet(scratch.path("in"))
    return m.run_updates(m.last_turns(s, 4, ttl=None), scratch.path("out"), scratch.path("c"), ["conv_id"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    """Sessions that the watermark has passed; one that is open at the end is not emitted."""
    s, scratch = _stream(spark, d)
    return m.run_to_parquet(m.session_counts(s), scratch.path("out"), scratch.path("c"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """Event-time windows: days that the watermark has passed."""
    s, scratch = _stream(spark, d)
    return m.run_to_parquet(m.daily_counts(s), scratch.path("out"), scratch.path("c"))


STATES = {"purchase": "completed", "error": "failed", "click": "cancelled"}


@query("""WITH l AS (SELECT user_id, event_id AS launch_id, ts AS launched FROM events WHERE event_type = 'signup'),
t AS (SELECT user_id, event_id AS terminal_id, ts AS ended, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events WHERE event_type IN ('purchase', 'error', 'click')),
m AS (SELECT l.user_id, launch_id, status, terminal_id, (epoch_us(ended) - epoch_us(launched)) // 1000000 AS seconds, launched FROM l LEFT JOIN t ON l.user_id = t.user_id AND ended >= launched AND ended <= launched + INTERVAL 6 HOUR)
SELECT user_id, launch_id, status, terminal_id, seconds FROM m WHERE status IS NOT NULL OR launched + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_lifecycle(spark, d):
    """I6, J research_web_cancel: launches met by how they ended; a launch that may still end when the events do is not handed out yet."""
    s, scratch = _stream(spark, d)
    return m.run_to_parquet(m.lifecycles(s, "signup", STATES), scratch.path("out"), scratch.path("c"))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY i), 0) AS before, coalesce(lead(i) OVER (PARTITION BY user_id ORDER BY i), 1000000000000) AS after FROM e),
m AS (SELECT x.user_id AS evicted, x.event_id AS last_event_id, r.user_id, r.event_id, row_number() OVER (PARTITION BY x.i ORDER BY r.i) AS nth FROM p x JOIN p r ON r.i > x.i AND r.i < x.after AND r.before < x.i)
SELECT user_id, event_id, evicted, last_event_id FROM m WHERE nth = 50""")
def stream_capacity(spark, d):
    """Fifty sessions are held; each new one beyond them ends the one that was used longest ago."""
    s, scratch = _stream(spark, d)
    uses = s.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("order_us"), F.col("event_id").alias("tie"))
    gone = run_capped(uses, 50, scratch.path("out"), scratch.path("c"))
    return gone.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "evicted", F.col("last_tie").alias("last_event_id"))


@query(f"""WITH {REGISTRY_SQL} SELECT user_id, event_type, event_id, action, us FROM a
UNION ALL SELECT user_id, event_type, NULL, 'expired', us + 7200000000 FROM a WHERE action IN ('create', 'hit', 'stale') AND (n - us > 7200000000 OR n IS NULL AND us + 7200000000 < (SELECT max(epoch_us(ts)) - 3600000000 FROM events))""")
def stream_registry(spark, d):
    """The registry over a stream; entries that nobody uses end by a timer, the last ones when the watermark has passed them."""
    s, scratch = _stream(spark, d)
    own = registry_stream(s, ["user_id", "event_type"], "event_id", "value", 7200, 10)
    return m.run_to_parquet(own, scratch.path("out"), scratch.path("c"), provider=PROVIDER)


def _inputs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("content_id"), "text")


@query("SELECT doc_id::VARCHAR AS key, split_part(text, chr(10), 1) AS title, substr(text, 1, 300) AS summary, '' AS error FROM documents")
def annotate_documents(spark, d):
    """I13, J: a batched provider."""
    return a.annotate(_inputs(spark, d).withColumnRenamed("content_id", "key")).drop("key_points")


@query("SELECT lang = 'en' AS cached, count(*) AS n FROM documents GROUP BY 1")
def annotate_with_cache(spark, d):
    """What the cache has isn't asked for again."""
    docs = _inputs(spark, d)
    empty = spark.createDataFrame([], a.RESULT)
    known = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("content_id"), "text")
    cache = Scratch(spark, "annotate").keep(a.annotate_with_cache(known, empty, "summarize", "m").drop("cached"), "cache")
    return a.annotate_with_cache(docs, cache, "summarize", "m").groupBy("cached").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (NOT contains(text, 'the')) AS succeeded, count(*) FILTER (contains(text, 'the')) AS failed FROM documents")
def batch_success_tally(spark, d):
    """Failures are rows."""

    def provider(rows):
        if rows["text"].str.contains("the", regex=False).any():
            raise ValueError("refused")
        return a.offline(rows)

    out = a.annotate(_inputs(spark, d).withColumnRenamed("content_id", "key"), provider)
    return out.agg(F.count_if(F.col("error") == "").alias("succeeded"), F.count_if(F.col("error") != "").alias("failed"))
