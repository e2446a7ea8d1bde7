"""Files seen together or not at all, pages read up to a cap, drawings against a plain version."""

import html
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import render
from lodestone.sources import filesink, paged


def rows(spark, folder):
    return {r.path: r.text for r in filesink.read_files(spark, folder).collect()}


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "f")
    files = spark.createDataFrame([("a/x.md", "é"), ("a/y.md", None), ("b.txt", "1"), ("b.txt", "2")], "path string, text string")
    filesink.write_files(files, folder)
    assert rows(spark, folder) == {"a/x.md": "é", "b.txt": "2"}
    assert Path(filesink.current(folder), "a/y.md").read_bytes() == b""
    filesink.write_files(files.filter("path = 'b.txt'"), folder)
    assert rows(spark, folder) == {"b.txt": "2"}
    filesink.write_files(files.filter("false"), folder)
    assert rows(spark, folder) == {}
    assert not list(Path(folder).rglob("*.tmp"))


@pytest.mark.parametrize("bad", [None, "", "/etc/x", "../x", "a/../../x", "a//b", "a\\b"])
def test_failed_write_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "f")
    good = spark.createDataFrame([(f"{i}/a.md", str(i)) for i in range(40)], "path string, text string")
    filesink.write_files(good, folder)
    before = sorted(map(str, Path(folder).rglob("*")))
    with pytest.raises(Exception):
        filesink.write_files(good.withColumn("text", F.lit("new")).unionByName(spark.createDataFrame([(bad, "x")], good.schema)), folder)
    assert sorted(map(str, Path(folder).rglob("*"))) == before
    assert rows(spark, folder) == {f"{i}/a.md": str(i) for i in range(40)}


def test_no_page_behind_the_cap(spark, tmp_path):
    folder = str(tmp_path / "p")
    items = spark.createDataFrame([(p, i, f"{p}-{i}") for p in range(7) for i in range(p * 3)] + [(None, 0, "x"), (3, None, "x")], "p long, i int, t string")
    served = paged.write_pages(items, "p", ["i", "t"], F.struct("t"), 4, folder)
    late = [f for f in Path(served).rglob("p*.json") if int(f.stem[1:]) >= 2]
    assert late
    for f in late:  # behind the cap: read by nobody
        f.write_text("{")
    got = sorted((r.parent, r.place, r.page, json.loads(r["item"])["t"]) for r in paged.read_pages(spark, served, 8).collect())
    assert got == sorted((str(p), i, i // 4, f"{p}-{i}") for p in range(7) for i in range(min(p * 3, 8)))
    assert paged.read_pages(spark, served, 0).count() == 0
    with pytest.raises(Exception):
        paged.read_pages(spark, served, 9).collect()


def test_odd_answers(spark, tmp_path):
    for parent, pages in {"none": {"first": {}}, "loop": {"first": {"items": [1], "nextPageToken": "x"}, "x": {"items": None, "nextPageToken": "first"}}}.items():
        own = tmp_path / "0" / parent
        own.mkdir(parents=True)
        for token, body in pages.items():
            (own / f"{token}.json").write_text(json.dumps(body))
    (tmp_path / "1").mkdir()
    assert [(r.parent, r.place, r["item"]) for r in paged.read_pages(spark, str(tmp_path)).collect()] == [("loop", 0, "1")]


def slow_map(nodes, edges):
    """(drawn, width, height)."""
    wide, at, out = max(int(len(nodes) ** 0.5), 1), {}, []
    for i, (k, _) in enumerate(nodes):
        at[f"node_{i}" if k is None else k] = (80 + i % wide * 160, 80 + i // wide * 120)
    for a, b, label in edges:
        if (a or "") in at and (b or "") in at:
            (x1, y1), (x2, y2) = at[a or ""], at[b or ""]
            out.append(render.LINE.format(x1=x1, y1=y1, x2=x2, y2=y2))
            if label:
                out[-1] += render.LINE_LABEL.format(x=(x1 + x2) / 2, y=(y1 + y2) / 2 - 8, label=html.escape(label))
    for k, label in nodes:
        if (k or "") in at:
            x, y = at[k or ""]
            out.append(render.NODE.format(x=x, y=y, below=y + 4, label=html.escape(label or "")))
    return out, max((p[0] for p in at.values()), default=200) + 100, max((p[1] for p in at.values()), default=200) + 100


GRAPHS = [
    ("none", "en", [], []),
    ("null", None, None, None),
    ("one", "nl", [("a", "<A> & 'b'")], [("a", "a", "self"), ("a", "z", "gone"), (None, "a", "x")]),
    ("odd", "es", [("a", "1"), (None, "2"), ("a", "3"), ("", None), ("b", "5")], [("a", "b", None), ("node_1", "b", "to"), (None, "b", ""), ("b", "a", '"q"')]),
    ("many", "xx", [(str(i % 29), f"n{i}") for i in range(40)], [(str(i), str(i * 7 % 31), "e") for i in range(50)]),
]


def test_concept_maps(spark):
    maps = spark.createDataFrame(GRAPHS, "k string, lang string, nodes array<struct<id:string,label:string>>, edges array<struct<source:string,target:string,label:string>>")
    got = {r.k: r.page for r in render.concept_maps(maps, "k", "lang", "nodes", "edges").collect()}
    assert set(got) == {g[0] for g in GRAPHS}
    for k, lang, nodes, edges in GRAPHS:
        drawn, width, height = slow_map(nodes or [], edges or [])
        heading = render.HEADINGS.get(lang, render.HEADINGS["en"])["concept_map"]
        assert got[k] == render.PAGE_HEAD.format(heading=heading, width=width, height=height) + "\n".join(drawn) + render.PAGE_END


def test_markdown_without_anything(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("t"), F.lit(None).cast("array<string>").alias("l"), F.lit(None).cast("array<struct<time:string,description:string>>").alias("m"), F.lit(None).cast("array<struct<heading:string,content:string>>").alias("s"))
    c = F.col
    got = row.select(render.analysis_markdown(c("t"), c("t"), c("t"), c("t"), c("l"), c("l"), c("m")), render.strategy_markdown(c("t"), c("t"), c("s"), c("l"))).first()
    assert got[0] == "# Video Analysis\n\n**Source:** \n\n---\n\nSee also: [Strategy Report](strategy.md) | [Concept Map](concept-map.html)\n"
    assert got[1] == "# Strategy Report\n"
