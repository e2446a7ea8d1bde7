"""Documents as text, built from ordered rows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import html_escape, truthy


def ordered_text(df: DataFrame, key: str, order: str, line: Column, separator: str = "\n") -> DataFrame:
    """key, text: the lines of each key in order."""
    own = df.select(key, F.struct(F.col(order), line.alias("l")).alias("x"))
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), separator).alias("text"))


def findings_text(df: DataFrame, key: str, order: str, claim: str, tier: str, empty: str = "(none)") -> DataFrame:
    """key, text: '1. [TIER] claim' for each finding."""
    line = F.concat(F.col(order).cast("string"), F.lit(". ["), F.coalesce(tier, F.lit("UNKNOWN")), F.lit("] "), F.coalesce(claim, F.lit("")))
    out = ordered_text(df, key, order, line)
    return out.select(key, F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(empty)).alias("text"))


#: Headings of a report by language.
HEADINGS = {
    "en": {"summary": "Summary", "key_points": "Key Points", "timestamps": "Timestamps", "topics": "Topics", "strategy_notes": "Strategic Notes", "concept_map": "Concept Map", "source": "Source", "see_also": "See also"},
    "nl": {"summary": "Samenvatting", "key_points": "Kernpunten", "timestamps": "Tijdstempels", "topics": "Onderwerpen", "strategy_notes": "Strategische Notities", "concept_map": "Conceptkaart", "source": "Bron", "see_also": "Zie ook"},
    "es": {"summary": "Resumen", "key_points": "Puntos Clave", "timestamps": "Marcas de Tiempo", "topics": "Temas", "strategy_notes": "Notas Estratégicas", "concept_map": "Mapa Conceptual", "source": "Fuente", "see_also": "Ver también"},
}


def heading(language: Column, name: str) -> Column:
    """A heading in a language; in English where that isn't known."""
    known = F.create_map(*(F.lit(x) for lang, h in HEADINGS.items() for x in (lang, h[name])))
    return F.coalesce(F.try_element_at(known, language), F.lit(HEADINGS["en"][name]))


def preamble(title: str, channel: str, category: str, duration: str, tags: Column) -> Column:
    """What a prompt says of a video first."""
    return F.format_string('Video context: "%s" by %s (%s, %s). Tags: %s', F.col(title), F.col(channel), truthy(F.col(category), F.lit("Unknown")), F.col(duration), tags)


def excerpt(c: Column, most: int = 200) -> Column:
    """The first characters, with dots where there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def _section(language: Column, name: str, there: Column, lines: Column) -> Column:
    """A headed section, or nothing."""
    own = F.concat(F.array(F.concat(F.lit("## "), heading(language, name)), F.lit("")), lines, F.array(F.lit("")))
    return F.when(F.coalesce(there, F.lit(False)), own).otherwise(F.array().cast("array<string>"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def analysis_markdown(language: Column, title: Column, source: Column, summary: Column, points: Column, topics: Column, times: Column) -> Column:
    """A report of a result: sections that have nothing are left out, links to the other artifacts end it.

    ``times`` is an array of structs (time, description).  A title that is null is a general one; nulls within lists are empty.
    """
    rows = F.transform(times, lambda t: F.concat(F.lit("| "), _text(t["time"]), F.lit(" | "), _text(t["description"]), F.lit(" |")))
    see = F.concat(heading(language, "see_also"), F.lit(": [Strategy Report](strategy.md) | ["), heading(language, "concept_map"), F.lit("](concept-map.html)"))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce(title, F.lit("Video Analysis"))), F.lit(""), F.concat(F.lit("**"), heading(language, "source"), F.lit(":** "), _text(source)), F.lit("")),
        _section(language, "summary", summary != "", F.array(summary)),
        _section(language, "key_points", F.size(points) > 0, F.transform(points, lambda p: F.concat(F.lit("- "), _text(p)))),
        _section(language, "timestamps", F.size(times) > 0, F.concat(F.array(F.lit("| Time | Description |"), F.lit("|------|-------------|")), rows)),
        _section(language, "topics", F.size(topics) > 0, F.array(F.array_join(topics, ", "))),
        F.array(F.lit("---"), F.lit(""), see, F.lit("")),
    )
    return F.array_join(lines, "\n")


def strategy_markdown(language: Column, title: Column, sections: Column, notes: Column) -> Column:
    """A strategy page: sections, an array of structs (heading, content), then notes."""
    empty = F.array().cast("array<string>")
    own = F.flatten(F.transform(sections, lambda s: F.array(F.concat(F.lit("## "), F.coalesce(s["heading"], F.lit("Section"))), F.lit(""), _text(s["content"]), F.lit(""))))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce(title, F.lit("Strategy Report"))), F.lit("")),
        F.coalesce(own, empty),
        _section(language, "strategy_notes", F.size(notes) > 0, F.transform(notes, lambda n: F.concat(F.lit("- "), _text(n)))),
    )
    return F.array_join(lines, "\n")


#: The grid that nodes are laid on.
MARGIN, STEP_X, STEP_Y, EMPTY = 80, 160, 120, 200

#: The page around a map.
PAGE_HEAD = """<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>{heading}</title>
<style>body {{ font-family: sans-serif; margin: 20px; background: #f5f5f5; }}</style>
</head>
<body>
<h1>{heading}</h1>
<svg width="{width}" height="{height}" xmlns="http://www.w3.org/2000/svg">
  <defs>
    <marker id="arrow" markerWidth="10" markerHeight="7" refX="10" refY="3.5" orient="auto">
      <polygon points="0 0, 10 3.5, 0 7" fill="#666"/>
    </marker>
  </defs>
"""
PAGE_END = "\n</svg>\n</body>\n</html>"
LINE = '  <line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="#666" stroke-width="2" marker-end="url(#arrow)"/>'
LINE_LABEL = '\n  <text x="{x}" y="{y}" text-anchor="middle" font-size="11" fill="#888">{label}</text>'
NODE = '  <circle cx="{x}" cy="{y}" r="30" fill="#4a90d9" stroke="#2c5f8a" stroke-width="2"/>\n  <text x="{x}" y="{below}" text-anchor="middle" font-size="12" fill="white" font-weight="bold">{label}</text>'


def filled(pattern: str, **columns: Column) -> Column:
    """A pattern's text with columns in its places."""
    parts = [(F.lit(text), columns[name] if name else None) for text, name, _, _ in string.Formatter().parse(pattern)]
    return F.concat(*(c for pair in parts for c in pair if c is not None))


def concept_maps(maps: DataFrame, key: str, language: str, nodes: str, edges: str) -> DataFrame:
    """key, page: the graph of each row as a page with a drawing.

    ``nodes`` is an array of structs (id, label), ``edges`` one of structs (source, target, label).  Nodes lie on a grid in their order; of nodes with
    the same id the last one's place counts for all.  A node without an id takes a place, as ``node_`` and its
    number, and is not drawn; an edge is drawn if both of its ends have a place.
    Ends meet places in joins on (key, id), so that a large graph costs what its nodes and edges do, not their product.
    """
    c = F.col
    columns = F.greatest(F.floor(F.sqrt(F.size(nodes).cast("double"))).cast("int"), F.lit(1))
    shown = maps.select(c(key).alias("k"), columns.alias("columns"), F.posexplode(nodes).alias("i", "n")).select("k", "i", "columns", c("n.id").alias("id"), html_escape(_text(c("n.label"))).alias("label"))
    placed = shown.withColumn("id", F.coalesce("id", F.concat(F.lit("node_"), c("i").cast("string"))))
    places = placed.groupBy("k", "id").agg(F.max("i").alias("i"), F.max("columns").alias("columns"))
    x = (F.lit(MARGIN) + F.pmod(c("i"), c("columns")) * STEP_X).cast("int")
    y = (F.lit(MARGIN) + F.floor(c("i") / c("columns")) * STEP_Y).cast("int")
    places = places.select("k", "id", x.alias("x"), y.alias("y"))
    s = lambda name: c(name).cast("string")
    circles = shown.select("k", "i", _text(c("id")).alias("id"), "label").join(places, ["k", "id"]).select("k", F.lit(1).alias("part"), "i", filled(NODE, x=s("x"), y=s("y"), below=(c("y") + 4).cast("string"), label=c("label")).alias("drawn"))
    lines = maps.select(c(key).alias("k"), F.posexplode(edges).alias("i", "e")).select("k", "i", _text(c("e.source")).alias("source"), _text(c("e.target")).alias("target"), html_escape(_text(c("e.label"))).alias("label"))
    ends = lines.join(places.select("k", c("id").alias("source"), c("x").alias("x1"), c("y").alias("y1")), ["k", "source"])
    ends = ends.join(places.select("k", c("id").alias("target"), c("x").alias("x2"), c("y").alias("y2")), ["k", "target"])
    half = lambda a, b, less: ((c(a) + c(b)) / 2 - less).cast("double").cast("string")
    named = F.when(c("label") != "", filled(LINE_LABEL, x=half("x1", "x2", 0), y=half("y1", "y2", 8), label=c("label"))).otherwise("")
    arrows = ends.select("k", F.lit(0).alias("part"), "i", F.concat(filled(LINE, x1=s("x1"), y1=s("y1"), x2=s("x2"), y2=s("y2")), named).alias("drawn"))
    drawn = arrows.unionByName(circles).select("k", F.struct("part", "i").alias("o"), "drawn")
    bodies = ordered_text(drawn, "k", "o", c("drawn")).withColumnRenamed("text", "body")
    extents = places.groupBy("k").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    side = lambda name: (F.coalesce(name, F.lit(EMPTY)) + 100).cast("string")
    heads = maps.select(c(key).alias("k"), c(language).alias("language")).join(extents, "k", "left")
    heads = heads.select("k", filled(PAGE_HEAD, heading=heading(c("language"), "concept_map"), width=side("w"), height=side("h")).alias("head"))
    return heads.join(bodies, "k", "left").select(c("k").alias(key), F.concat("head", F.coalesce("body", F.lit("")), F.lit(PAGE_END)).alias("page"))
