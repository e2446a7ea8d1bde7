"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is (host, path, verdict).  It fits its host and every subdomain of it, where the URL's path
starts with the rule's path.  Among the rules that fit, the one with most code points in host + path
wins; with equal length the longer host wins; of an allow and a block entry of the same host and path,
block wins.  A URL that no rule fits gets the default verdict (allow: a block list names what to block).

The trie is broadcast while the rule set stays below ``max_rules``; a larger one is joined by key
instead, with the same result.

Null or malformed URLs have an empty host and an empty path, which no rule with a host fits.  Rows are
judged one by one, so repeated rows, null ids, empty tables and any further columns need no care: only
``id_col`` and ``url_col`` are read, and the result has the columns documented at ``url_verdicts``.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.runtime import Scratch, ship

#: Rules that are broadcast at most; at 200 bytes a rule this is 40 MB.
MAX_BROADCAST_RULES = 200_000
RULE_SCHEMA = "host string, path string, verdict string"

#: The rules that op8_url_filters applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the module's docstring has them; only A-Z are lower-cased."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    at += 3
    end = len(url)
    for c in "?#":
        if (x := url.find(c, at, end)) >= 0:
            end = x
    slash = url.find("/", at, end)
    if slash < 0:
        return url[at:end].translate(_UPPER), ""
    return url[at:slash].translate(_UPPER), url[slash:end]


class RuleTrie:
    """Nodes are dicts.  Host labels are reached from the right; below a label, ``PATH`` leads to the path's nodes.

    A path's complete segments (those with a slash behind them) are edges; what follows the last slash of a
    rule is kept at the node as a remainder, which a URL's rest has to start with.
    """

    PATH, RULES = 0, 1  # edges that no label or segment can be, for those are strings

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a verdict is allow or block, not {verdict!r}")
            host, path = (host or "").translate(_UPPER), path or ""
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            entry = node.setdefault(self.RULES, {})
            if entry.get(rest, ("",))[0] != "block":
                entry[rest] = (verdict, host + path, len(host))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, key = None, (-1, -1)
        node = self.root
        labels = host.split(".") if host else []
        for depth in range(len(labels) + 1):
            if depth:
                node = node.get(labels[-depth])
                if node is None:
                    break
            below = node.get(self.PATH)
            at = 0
            while below is not None:
                for rest, (verdict, text, n) in below.get(self.RULES, {}).items():
                    if (len(text), n) > key and path.startswith(rest, at):
                        best, key = (verdict, text), (len(text), n)
                slash = path.find("/", at)
                if slash < 0:
                    break
                below, at = below.get(path[at:slash]), slash + 1
        return best


def url_verdicts(
    df: DataFrame,
    rules: DataFrame | list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """One row for each row of ``df``: id_col, host, path, rule (null if none fits), verdict.

    Without a shuffle while the rules are few enough to broadcast.
    """
    spark = df.sparkSession
    ship(spark)
    if isinstance(rules, list):
        if len(rules) > max_rules:
            rules = spark.createDataFrame(rules, RULE_SCHEMA)
        else:
            return _by_trie(spark, df, rules, id_col, url_col, default)
    few = [tuple(r) for r in rules.select("host", "path", "verdict").limit(max_rules + 1).collect()]
    if len(few) <= max_rules:
        return _by_trie(spark, df, few, id_col, url_col, default)
    return _by_join(spark, df, rules, id_col, url_col, default)


def _by_trie(spark: SparkSession, df: DataFrame, rules: list, id_col: str, url_col: str, default: str) -> DataFrame:
    own = df.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    text = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    def judge(batches):
        match = trie.value.match
        for b in batches:
            out = ([], [], [], [])
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                found = match(host, path)
                for column, x in zip(out, (host, path, found and found[1], found[0] if found else default)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in out)], [id_col, "host", "path", "rule", "verdict"])

    return own.mapInArrow(judge, T.StructType([T.StructField(id_col, own.schema[0].dataType), *text]))


def _by_join(spark: SparkSession, df: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    """For rule sets beyond the broadcast bound: URLs meet rules by (host suffix, whole leading segments)."""
    scratch = Scratch(spark, "urls")
    url = F.col("__url")
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.expr("substring(__url, length(__head) + 4)")
    small = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = df.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url")).withColumn("__head", rest)
    own = own.withColumn("__tail", F.when(F.col("__head").isNotNull(), tail)).select("__id", small(F.coalesce(F.regexp_extract("__tail", "^[^/?#]*", 0), F.lit(""))).alias("host"), F.coalesce(F.regexp_extract("__tail", "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    own = scratch.keep(own.withColumn("__row", F.monotonically_increasing_id()), "urls")
    ahead = "concat_ws('.', slice(split(host, '[.]'), i, 1 + size(split(host, '[.]')) - i))"
    own_keys = own.withColumn("__h", F.explode(F.expr(f"array_append(transform(sequence(1, size(split(host, '[.]'))), i -> {ahead}), '')")))
    own_keys = own_keys.dropDuplicates(["__row", "__h"]).withColumn("__d", F.explode(F.expr("array_distinct(transform(sequence(0, size(split(path, '/')) - 1), i -> array_join(transform(slice(split(path, '/'), 1, i), s -> concat(s, '/')), '')))")))
    r = rules.select(small(F.coalesce("host", F.lit(""))).alias("__h"), F.coalesce("path", F.lit("")).alias("__p"), F.col("verdict").alias("__v")).groupBy("__h", "__p").agg(F.max("__v").alias("__v"))
    r = r.withColumn("__d", F.regexp_extract("__p", "^(.*/)?", 0))
    rank = F.struct(F.length(F.concat("__h", "__p")).alias("n"), F.length("__h").alias("h"), F.concat("__h", "__p").alias("rule"), F.col("__v").alias("v"))
    fits = own_keys.join(r, ["__h", "__d"]).filter(F.col("path").startswith(F.col("__p"))).groupBy("__row").agg(F.max(rank).alias("__b"))
    out = own.join(fits, "__row", "left")
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("__b.rule").alias("rule"), F.coalesce("__b.v", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``: page_id, host, path, rule, verdict."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM q
), r(h, s, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM u LEFT JOIN (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
) b USING (page_id)
"""
