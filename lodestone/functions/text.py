"""Tokens and BM25 as column expressions.

Tokens: lower case, split at runs of characters outside [a-z0-9], empties dropped.  BM25 has k1 = 1.2, b = 0.75 and
idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  N, df and the mean length are those of all texts of a collection that have
a token, before any filter, so filters never change scores.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def terms_of(query: str) -> list[str]:
    """Distinct tokens of a query, in order."""
    import re

    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", query.lower()) if t))


def bm25(df: DataFrame, text: Column | str, query: str, keep: list[str], where: Column | None = None) -> DataFrame:
    """``keep`` columns and ``bm25`` of the rows that match, for a single query over a corpus without an index.

    Each text is tokenised once where statistics are made and once where hits are scored; statistics come from one
    aggregate over all rows, a single row that joins back; nothing else is shuffled.
    """
    terms = terms_of(query)
    if not terms:
        return df.select(*keep, F.lit(0.0).alias("bm25")).limit(0)
    # one pass over a text's tokens counts all terms: [length, tf of each term]
    step = lambda n, x: F.array(n[0] + 1, *(n[i + 1] + (x == t).cast("int") for i, t in enumerate(terms)))
    counts = F.aggregate(tokens(text), F.array(*(F.lit(0) for _ in range(len(terms) + 1))), step)
    stats = df.select(counts.alias("c")).agg(F.count_if(F.col("c")[0] > 0).alias("__n"), F.avg(F.when(F.col("c")[0] > 0, F.col("c")[0])).alias("__avg"), *(F.count_if(F.col("c")[i + 1] > 0).alias(f"__df{i}") for i in range(len(terms))))
    own = df if where is None else df.filter(where)
    own = own.select(*keep, F.explode(F.array(counts)).alias("__c"))  # a generator keeps the filter below from counting again
    own = own.filter(reduce(lambda a, b: a | b, (F.col("__c")[i + 1] > 0 for i in range(len(terms)))))
    tf = lambda i: F.col("__c")[i + 1]
    length = F.lit(1 - B) + F.lit(B) * F.col("__c")[0] / F.col("__avg")
    idf = lambda i: F.log(1 + (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
    parts = [idf(i) * tf(i) * (K1 + 1) / (tf(i) + K1 * length) for i in range(len(terms))]
    return own.crossJoin(F.broadcast(stats)).select(*keep, reduce(add, parts).alias("bm25"))  # stats is one row


def postings(df: DataFrame, keys: str | list[str], text: Column | str) -> DataFrame:
    """term, keys, tf, dl: the inverted index, to be written clustered by term for many queries over one corpus."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    own = df.select(*keys, F.explode(F.array(tokens(text))).alias("t"))  # tokens are made once for both columns below
    own = own.select(*keys, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return own.groupBy("term", *keys, "dl").agg(F.count("*").alias("tf")).select("term", *keys, "tf", "dl")


def impact() -> Column:
    """What a posting (tf, dl; avgdl beside it) scores but for its term's weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25_from_postings(index: DataFrame, corpus: DataFrame, query: str, keys: str | list[str] = "object_id") -> DataFrame:
    """keys, bm25 from ``postings`` pruned to the query's terms; ``corpus`` has one row of n and avgdl."""
    keys, terms = [keys] if isinstance(keys, str) else list(keys), terms_of(query)
    own = index.filter(F.col("term").isin(terms))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * impact()
    joined = own.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # as many rows as the query has terms; one row
    parts = [F.coalesce(F.sum(F.when(F.col("term") == t, score)), F.lit(0.0)) for t in terms] or [F.lit(0.0)]  # one posting each
    return joined.groupBy(*keys).agg(reduce(add, parts).alias("bm25"))
