"""Literal expectations, the store, file sources, guards and plans."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import json_schema as js
from lodestone.functions import scalars as x
from lodestone.functions.text import bm25, bm25_from_postings, postings
from lodestone.operators import annotate, filters, search, store
from lodestone.sources import files
from lodestone.sources.tables import contents


def one(spark, f, *inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.select(f(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_durations(spark):
    texts = ["PT4M13S", "PT1H2M3S", "PT2H", "PT45S", "PT10M", "", None, "not-a-duration", "P1DT2H", "PT1.5S"]
    assert one(spark, x.duration_seconds, *texts) == [253, 3723, 7200, 45, 600, 0, 0, 0, 0, 0]
    assert one(spark, lambda c: x.format_seconds(c.cast("long")), "253", "3723", "0", "60", "9", None) == ["4:13", "1:02:03", "0:00", "1:00", "0:09", "0:00"]


def test_names(spark):
    assert one(spark, x.slug, "Rivers of Ice", "Über 9, really?", "--", "b" * 70, "a" * 49 + " b") == ["rivers-of-ice", "ber-9-really", None, "b" * 50, "a" * 49 + "-"]
    assert one(spark, x.component_name, "slow Light", "Don't Blink", "Part 2 Of 3", "99 Problems", "...") == ["SlowLightScene", "DontBlinkScene", "Part2Of3Scene", "Scene99ProblemsScene", "GeneratedScene"]
    assert one(spark, x.scene_key, "An Old Map", "Folding Paper", "Who's There?", "low-level I/O", "the") == ["old_map", "folding_paper", "whos_there", "lowlevel_io", ""]


def test_urls(spark):
    assert one(spark, x.video_id, "https://youtube.com/watch?list=P&v=Q_w-1", "https://youtu.be/zz9", "https://m.youtube.com/live/L1?si=2", "https://myyoutube.com/watch?v=Q", "https://youtube.com.example.net/watch?v=Q", "../up", "a/b", "q%41") == ["Q_w-1", "zz9", "L1", None, None, None, None, None]
    assert one(spark, x.paper_pdf, "https://arxiv.org/abs/1706.03762v5") == ["https://arxiv.org/pdf/1706.03762v5.pdf"]
    assert one(spark, x.store_url, "localhost:9", "172.48.1.2:80", "172.31.0.1:80", "${STORE:-}") == ["http://localhost:9", "https://172.48.1.2:80", "http://172.31.0.1:80", ""]
    assert one(spark, x.retryable, "HTTP 429", "over quota", "HTTP 400", "no such thing") == [True, True, False, False]
    assert one(spark, x.download_name, "https://a.b/c/d.pdf?x=1", "https://a.b/c/d", "https://a.b/c/", "https://a.b") == ["d.pdf", "document.pdf", "document.pdf", "a.b"]


def test_blocked_addresses_agree_with_the_standard_library(spark):
    import random
    from ipaddress import IPv4Address, IPv6Address

    r = random.Random(2)
    edges = [int(n.network_address) + d for n in map(x.ip_network, x.BLOCKED_V4 + x.OPEN_V4) for d in (-1, 0, 1, n.num_addresses - 1, n.num_addresses)]
    v4 = [IPv4Address(i) for i in {*(e for e in edges if 0 <= e < 1 << 32), *(r.getrandbits(32) for _ in range(300))}]
    edges = [int(n.network_address) + d for n in map(x.ip_network, x.BLOCKED_V6 + x.OPEN_V6) for d in (-1, 0, 1, n.num_addresses - 1, n.num_addresses)]
    v6 = [IPv6Address(i) for i in {*(e for e in edges if 0 <= e < 1 << 128), *(r.getrandbits(128) for _ in range(300))}]
    hosts = [str(a) for a in v4] + [f"[{a}]" for a in v6] + [f"[{a.exploded}]" for a in v6]
    blocked = lambda a: a.is_loopback or a.is_private or a.is_link_local or a.is_multicast or a.is_reserved
    assert one(spark, x.blocked_address, *hosts) == [blocked(a) for a in [*v4, *v6, *v6]]


def test_uuid5(spark):
    import uuid

    names = ["doc:1", "é漢", "", "a" * 300]
    assert one(spark, x.uuid5, *names) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_filters(spark):
    df = spark.createDataFrame([], schema.struct("ResearchFindings"))
    assert filters.build_filter(df) is None
    assert filters.build_filter(df, category="x") is None and filters.build_filter(df, date_from="bad") is None and filters.build_filter(df, evidence_tier="") is None
    assert filters.build_filter(df, evidence_tier="CONFIRMED") is not None
    assert filters.filters_applied(evidence_tier="", category=None) == {"evidence_tier": ""}
    assert filters.parse_date("20250101") == datetime(2025, 1, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        filters.build_filter(df, nope="x")


def test_schema():
    assert len(schema.COLLECTIONS) == 12 and len(schema.REFERENCES) == 5
    flags = {p.name: p for p in schema.properties("ResearchFindings")}
    assert flags["claim"].vectorized and not flags["scope"].searchable and flags["open_questions"].searchable and not flags["open_questions"].vectorized and flags["confidence"].ranged
    with pytest.raises(ValueError):
        schema.properties("Nope")


def test_store(spark, tmp_path):
    s = store.CollectionStore(spark, f"file://{tmp_path}/s")
    videos = spark.createDataFrame([("v1", "old"), ("v2", "b"), ("v1", "new")], "video_id string, title string").coalesce(1)
    s.upsert("VideoMetadata", videos, F.col("video_id"))
    s.upsert("VideoMetadata", spark.createDataFrame([("v2", "c")], "video_id string, title string"), F.col("video_id"))
    assert sorted((r.video_id, r.title) for r in s.read("VideoMetadata").collect()) == [("v1", "new"), ("v2", "c")]
    s.append("VideoAnalyses", spark.createDataFrame([("v1", "t")], "video_id string, title string"))
    a = s.read("VideoAnalyses").first()
    ids = {r.video_id: r.object_id for r in s.read("VideoMetadata").collect()}
    s.link(spark.createDataFrame([("VideoAnalyses", a.object_id, "has_metadata", "VideoMetadata", ids["v1"]), ("VideoAnalyses", a.object_id, "has_metadata", "VideoMetadata", "gone")], schema.EDGE_SCHEMA))
    assert s.export("VideoAnalyses").first().has_metadata == [ids["v1"]]
    assert s.delete("VideoMetadata", [ids["v2"], "nope"]) == 1 and s.read("VideoMetadata").count() == 1
    s.rebuild("VideoMetadata", lambda df: df.withColumn("title", F.upper("title")))
    assert s.read("VideoMetadata").first().title == "NEW"
    assert s.read("CallNotes").count() == 0
    with pytest.raises(ValueError, match="query:text"):
        store.validate([{"query": 1, "zz": 2}], "WebSearchResults")


def test_postings_give_the_same_scores(spark, sf_dir):
    docs = contents(spark, sf_dir)
    index = postings(docs, "object_id", "summary")
    corpus = index.select("object_id", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    a = {r.object_id: round(r.bm25, 9) for r in bm25_from_postings(index, corpus, "the idiot").collect()}
    assert a == {r.object_id: round(r.bm25, 9) for r in bm25(docs, "summary", "the idiot", ["object_id"]).collect()} and a


def test_search_arguments(spark, sf_dir):
    leg = search.Leg("c", contents(spark, sf_dir), F.col("summary"))
    for bad in ({"limit": 0}, {"limit": 101}, {"alpha": 2}, {"mode": "nope"}):
        with pytest.raises(ValueError):
            search.search([leg], "x", **({"mode": "keyword"} | bad))
    assert search.search([leg], "", "keyword").count() == 0


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    spark.read.parquet(f"{sf_dir}/documents.parquet").transform(lambda d: filters.apply_filter(d.withColumnRenamed("lang", "category"), category="en")).select("doc_id").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_files(spark, tmp_path):
    for n in ("b.md", "a.txt", "c.exe", "d.pdf"):
        (tmp_path / n).write_text(n)
    assert [(r.path.rsplit("/", 1)[1], r.mime) for r in files.scan_directory(spark, str(tmp_path), files.CONTENT, most=2).collect()] == [("a.txt", "text/plain"), ("b.md", "text/markdown")]
    listed = [str(tmp_path / n) for n in ("d.pdf", "c.exe", "a.txt")]
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_paths(spark, listed, files.CONTENT).collect()] == ["d.pdf", "a.txt"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_paths(spark, [str(tmp_path / "no.md")], files.CONTENT)
    (tmp_path / ".env").write_text("# c\nexport A=1\nB='x y'\nA=2\n")
    assert {r.name: r.value for r in files.parse_dotenv(files.dotenv_lines(spark, str(tmp_path / ".env"))).collect()} == {"A": "2", "B": "x y"}
    (tmp_path / "e.json").write_text('{"a": 1}\nbroken\n')
    assert [(r.a, r._corrupt_record) for r in files.read_entries(spark, str(tmp_path / "e.json"), "a int").collect()] == [(1, None), (None, "broken")]


def test_json_schema(spark):
    deep = {"type": "object", "properties": {"a": {"type": "string"}}}
    for _ in range(6):
        deep = {"type": "object", "properties": {"a": deep}}
    with pytest.raises(ValueError, match="depth"):
        js.guard(deep)
    with pytest.raises(ValueError, match="enum"):
        js.guard({"enum": list(range(21))})
    with pytest.raises(ValueError, match="properties"):
        js.guard({"type": "object", "properties": {str(i): {"type": "string"} for i in range(51)}})
    own = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}}
    rows = spark.createDataFrame([(1, '{"a": 3, "b": ["x"]}'), (2, "nope"), (3, None)], "i int, t string")
    got = {r.i: (r.data, r.error) for r in js.extract(rows, "t", own).collect()}
    assert got[1][0].a == 3 and got[1][0].b == ["x"] and got[1][1] == "" and got[2][0] is None and got[2][1] and got[3][1]


def test_annotation_failures(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "key string, text string")

    def bad(rows):
        if "b" in set(rows["key"]):
            raise ValueError("no")
        return annotate.offline(rows)

    got = {r.key: r.error for r in annotate.annotate(df, bad).collect()}
    assert got == {"a": "", "b": "ValueError: no"}
    with pytest.raises(Exception, match="no"):
        annotate.annotate(df, bad, fail_fast=True).collect()
