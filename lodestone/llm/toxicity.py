"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models (logistic regressions).  Each model sees which features a
text has, and the log-odds of all categories before its own.  In training these come from models that have not seen the
row (out-of-fold predictions), as they do for new texts.  Features are words and beginnings of words, so that inflected
and compounded forms of a stem count for it, and runs of signs; those that tell a category's rows from others are kept.

Features are chosen anew for each fold, from the rows that the fold's model sees; so nothing that the out-of-fold
predictions rest on has seen the row's labels.

Training takes at most ``MAX_LABELLED`` labelled documents for each category and side, chosen by a hash of their id;
this bounds what comes to the driver.  Scoring covers every row and whole texts.  Labels are taken by id; where an id
has several, the largest counts.  The last category decides; its threshold is the best of the out-of-fold predictions.

A text in which none of the chain's features occurs, such as a null or an empty one, shows nothing of any category: its
probabilities are 0 and it is never rejected, whatever rows the chain was fitted on.  Null ids, repeated rows, an empty
table and further columns need no care, as rows are scored one by one; null ids and null labels take no part in training.
Without labelled rows of both sides a category's log-odds are constant: those of its share among the labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._workers import kept
from lodestone.runtime import Scratch, ship

#: Labelled documents of each category and side that are taken for training at most.
MAX_LABELLED = 1500
FOLDS, FEATURES, LEAST_DOCS = 5, 768, 4
PREFIXES = range(3, 9)
#: Words that a worker remembers at most.
REMEMBERED = 400_000
CHAIN = ("low_quality", "toxic")

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{3,}")


def word_features(run: str) -> list[str]:
    """Of the words in a run without white space: each word, its beginnings, and the start of a run of signs."""
    out = []
    for token in _TOKEN.findall(run.lower()):
        out += [f"={token}", *(f"^{token[:n]}" for n in PREFIXES if n <= len(token))] if token[0].isalnum() else [f"!{token[:3]}"]
    return out


def tokens(text: str | None) -> set[str]:
    return set((text or "").split())


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> Linear:
    """Logistic regression, both sides weighing the same, by accelerated gradient descent."""
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(x.shape[1]), float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7)))
    y = y.astype(x.dtype)
    weight = (np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)).astype(x.dtype)
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x1.shape[1], x1.dtype)  # power steps towards the largest curvature
    for _ in range(12):
        v = x1.T @ (weight * (x1 @ v))
        v /= np.linalg.norm(v) or 1
    rate = 0.9 / (0.25 * float(v @ (x1.T @ (weight * (x1 @ v)))) + penalty)
    w = z = np.zeros(x1.shape[1], x1.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ z, -30, 30)))
        grad = x1.T @ (weight * (p - y))
        grad[:-1] += penalty * z[:-1]
        new = z - x.dtype.type(rate) * grad
        z = new + x.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return Linear(w[:-1].astype(np.float64), float(w[-1]))


@dataclass
class Chain:
    """Fitted models in order, with the features that they read."""

    categories: tuple[str, ...]
    index: dict[str, int]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def __post_init__(self):
        self._words: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def features(self, text: str | None) -> set[int]:
        known, out = self._words, set()
        for w in tokens(text):
            own = known.get(w)
            if own is None:
                if len(known) > REMEMBERED:
                    known.clear()
                own = known[w] = tuple(i for f in word_features(w) if (i := self.index.get(f)) is not None)
            if own:
                out.update(own)
        return out

    def matrix(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)), np.float64)
        for row, t in zip(x, texts):
            row[list(self.features(t))] = 1
        return x

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """[rows, categories]; each column is an input of the columns after it."""
        for m in self.models:
            x = np.hstack([x, np.clip(m(x), -8, 8)[:, None]])
        return x[:, len(self.index) :]

    def probabilities(self, texts) -> np.ndarray:
        """[rows, categories]; 0 throughout for a text without features."""
        x = self.matrix(texts)
        return np.where(x.any(axis=1, keepdims=True), 1 / (1 + np.exp(-self.log_odds(x))), 0.0)


def encoded(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """(features by code, for each text the codes of its features)."""
    codes: dict[str, int] = {}
    known: dict[str, list[int]] = {}
    rows = []
    for t in texts:
        own: set[int] = set()
        for w in tokens(t):
            if w not in known:
                known[w] = [codes.setdefault(f, len(codes)) for f in word_features(w)]
            own.update(known[w])
        rows.append(np.fromiter(own, np.int32, len(own)))
    return list(codes), rows


def select_features(names: list[str], rows: list[np.ndarray], labels: np.ndarray, most: int = FEATURES) -> list[int]:
    """Codes of the features that differ most between a category's rows and others, as many for each category."""
    none = [np.zeros(0, np.int32)]
    count = lambda some: np.bincount(np.concatenate([*none, *some]), minlength=len(names)).astype(np.float64)
    total = count(rows)
    codes = np.array(sorted(np.flatnonzero(total >= LEAST_DOCS).tolist(), key=names.__getitem__), np.int64)
    chosen: dict[int, None] = {}
    for y in labels.T:
        n1, n0 = int(y.sum()), len(y) - int(y.sum())
        if not n1 or not n0:
            continue
        a = count(r for r, t in zip(rows, y) if t)[codes]
        b = total[codes] - a
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        best = np.argsort(-z * np.sqrt(np.abs(odds)), kind="stable")[: most // labels.shape[1]]
        chosen.update(dict.fromkeys(codes[best].tolist()))
    return list(chosen)


def occurrence(rows: list[np.ndarray], chosen: list[int], n: int) -> np.ndarray:
    """[rows, chosen]: 1 where a text has a feature; ``n`` is the number of all codes."""
    column = np.full(n, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for out, own in zip(x, rows):
        at = column[own]
        out[at[at >= 0]] = 1
    return x


def fit_chain(texts: list[str], labels: np.ndarray, categories: tuple[str, ...] = CHAIN, folds: int = FOLDS) -> Chain:
    """``labels``: [rows, categories] of 0 and 1, categories in the chain's order."""
    labels = labels.reshape(len(texts), len(categories)).astype(np.float64)
    names, rows = encoded(texts)
    fold = np.arange(len(texts)) % folds
    held_out = np.zeros(labels.shape, np.float32)
    split = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(min(folds, len(texts)))]
    picked = [select_features(names, [rows[i] for i in seen], labels[seen]) for seen, _ in split]
    for j in range(len(categories)):
        for (seen, own), some in zip(split, picked):
            x = np.hstack([occurrence(rows, some, len(names)), held_out[:, :j]])
            held_out[own, j] = np.clip(fit_linear(x[seen], labels[seen, j])(x[own]), -8, 8)
    chosen = select_features(names, rows, labels)
    chain = Chain(tuple(categories), {names[c]: i for i, c in enumerate(chosen)})
    x = occurrence(rows, chosen, len(names))
    for j in range(len(categories)):
        chain.models.append(fit_linear(np.hstack([x, held_out[:, :j]]), labels[:, j]))
    if len(texts):
        chain.threshold = best_threshold(held_out[:, -1], labels[:, -1])
    return chain


def best_threshold(log_odds: np.ndarray, y: np.ndarray) -> float:
    """A probability: the middle of the widest gap among the cuts of fewest errors, an error on a clean row weighing the same."""
    order = np.argsort(log_odds)
    s, t = log_odds[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + (len(t) - t.sum() - np.concatenate([[0], np.cumsum(1 - t)]))
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    gaps = np.where(errors == errors.min(), np.diff(edges), -1)
    at = int(np.argmax(gaps))
    return float(1 / (1 + np.exp(-(edges[at] + edges[at + 1]) / 2)))


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CHAIN, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """Distinct texts and labels of at most 2 * ``most`` documents for each category.  ``labels`` has a column of 0 and 1 for each.

    Of an id that repeats with different texts, the smallest text counts.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(c) for c in categories)).dropna().groupBy("id").agg(*(F.max(c).alias(c) for c in categories))
    own = Scratch(spark, "labels").keep(own.withColumn("h", F.xxhash64("id")), "labels")
    parts = [own.filter(F.col(c) == v).orderBy("h", "id").limit(most) for c in categories for v in (0, 1)]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.union(p)
    picked = F.broadcast(picked.dropDuplicates(["id"]))  # 2 * most * categories rows of a few numbers at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id").groupBy("id").agg(F.min("text").alias("text"), *(F.min(c).alias(c) for c in categories), F.min("h").alias("h"))
    rows = sorted(rows.toPandas().itertuples(index=False), key=lambda r: (r.h, str(r.id)))
    seen: dict[str, tuple] = {}
    for r in rows:
        seen.setdefault(r.text or "", tuple(getattr(r, c) for c in categories))
    return list(seen), np.array(list(seen.values()), np.float64).reshape(len(seen), len(categories))


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id_col, a probability p_<category> for each category, and the last category's verdict by its name."""
    ship(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["id"], *(T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories), T.StructField(chain.categories[-1], T.BooleanType())])
    sent = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        kept("toxicity")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                p = sent.value.probabilities(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in p.T.copy()), pa.array(p[:, -1] > sent.value.threshold)], schema.names)

    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that the last category's verdict rejects."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        kept("toxicity")
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array(sent.value.probabilities(part.column(at).to_pylist())[:, -1] <= sent.value.threshold))

    return df.mapInArrow(run, df.schema)


def labelled_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    """The chain of the ``labels`` table: low quality first, then toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return fit_chain(*labelled_sample(docs, labels))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, p_low_quality, p_toxic, toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, labelled_chain(spark, docs, sf_dir))
