"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

A text's features are its runs of 1 to ``max_run`` words, and a feature's bucket is its checksum modulo ``buckets``.  A bucket's
gain is the logarithm of how much more often the target has it than the corpus does; a document's weight is the sum of gains
over its features, and a seeded Gumbel number is added, so that the highest scores are a draw without replacement.

* Tasks that read documents write postings (bucket, document, count), packed by share: a share is some of the buckets,
  dealt by their number.  A document has one posting for each bucket, so repeats are counted before anything moves.
  Documents of a task go in chunks of about ``CHUNK`` postings, whose rows are numbered.
* Corpus and target are co-grouped by share: both sides' counts, summed up in the tasks, meet there, and gains are made of them.
* Postings are shuffled to their share.  One bucket may hold a posting of every document, so a share is split by chunk
  into as many parts as its bytes ask for (``PART``); each has the share's gains beside it, ``buckets`` / shares numbers.
* Contributions, one for each document and part, go back to their chunk and are added up there.

Ranks come from a range-partitioned sort of those that may be drawn, counted by partition.  Nothing is collected but one row
for each share and for each partition.

Words are lower-cased in A-Z only.  A null text has no words; documents without features have weight 0.  Null ids are hashed like empty
strings and are behind all others of their score.  Repeated rows are documents of their own.  An empty corpus gives an
empty result; with an empty target all gains follow from the corpus alone.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.wordcache import parts
from lodestone.runtime import Scratch, shuffle_partitions

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 2024, 10, 20
#: Postings in a chunk, about, and documents at most; bytes of postings in a part of a share, about.
CHUNK, CHUNK_ROWS, PART = 1_500_000, 50_000, 32 << 20
#: What a byte becomes: A-Z a letter in lower case, other signs below 0x80 a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Texts with words in lower case and all else as spaces; null is empty."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    new = pa.py_buffer(data.to_pybytes().translate(FOLD)) if data else data
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, new], offset=texts.offset)


def bucketed(texts: pa.Array, buckets: int, max_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count), ordered and each pair once; and the number of words of each document."""
    lists = pc.ascii_split_whitespace(folded(texts))
    words = lists.flatten()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # of an empty or blank text the split makes empty strings, which are no words
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), size)[real]
    words = words.filter(pa.array(real))
    size = np.bincount(doc, minlength=len(texts))
    keys = []
    for n in range(1, max_run + 1):
        if n == 1:
            runs, own = words, doc
        else:
            same = doc[n - 1 :] == doc[: len(doc) - n + 1]
            columns = [words.slice(k, max(0, len(words) - n + 1)).filter(pa.array(same)) for k in range(n)]
            runs, own = pc.binary_join_element_wise(*columns, " "), doc[: max(0, len(doc) - n + 1)][same]
        runs = runs.dictionary_encode()
        crc = np.fromiter((zlib.crc32(w.encode()) % buckets for w in runs.dictionary.to_pylist()), np.int64, len(runs.dictionary))
        keys.append(own * buckets + crc[runs.indices.to_numpy(zero_copy_only=False)] if len(runs) else np.zeros(0, np.int64))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // buckets, key % buckets, n, size


def postings(df: DataFrame, id_col: str, text_col: str, buckets: int, max_run: int, shares: int) -> DataFrame:
    """Packed postings: chunk, share, bucket, doc, n; and for each chunk a row with share -1 that has ids, words and features.

    bucket is the packed number of a bucket within its share (bucket // shares), doc the row within its chunk.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("share", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("bucket", "doc", "n")), T.StructField("ids", T.ArrayType(own.schema["id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("words", "features"))])
    id_type = pa.list_(_arrow(own))

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        count = rows = 0

        def send():
            nonlocal held, count, rows, number
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            ids = pa.concat_arrays([h[0] for h in held])
            doc = np.concatenate([h[1] + b for h, b in zip(held, base)]).astype("<i4")
            bucket, n = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            words = np.concatenate([h[4] for h in held]).astype("<i8").tobytes()
            features = np.bincount(doc, n, len(ids)).astype("<i8").tobytes()
            chunk = number << 32 | task
            share = bucket % shares
            order = np.argsort(share, kind="stable")
            share, bucket, doc, n = share[order], (bucket[order] // shares).astype("<i4"), doc[order], n[order].astype("<i4")
            at = np.flatnonzero(np.diff(share, prepend=-1))
            out = [(chunk, int(share[a]), bucket[a:z].tobytes(), doc[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(at, [*at[1:], len(share)])]
            k = len(out)
            columns = [pa.array([*(o[i] for o in out), last], t) for i, (t, last) in enumerate([(pa.int64(), chunk), (pa.int32(), -1), *[(pa.binary(), None)] * 3])]
            lists = pa.ListArray.from_arrays(pa.array([*[None] * k, 0, len(ids)], pa.int32()), ids)
            held, count, rows, number = [], 0, 0, number + 1
            return pa.RecordBatch.from_arrays([*columns, lists.cast(id_type), *(pa.array([None] * k + [x], pa.binary()) for x in (words, features))], schema.names)

        for b in batches:
            at = 0
            for part in parts(b.column(1)):
                doc, bucket, n, words = bucketed(part, buckets, max_run)
                held.append((b.column(0).slice(at, len(part)), doc, bucket, n, words))
                at, count, rows = at + len(part), count + len(doc), rows + len(part)
                if count >= CHUNK or rows >= CHUNK_ROWS:
                    yield send()
        if held:
            yield send()

    return own.mapInArrow(run, schema)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)


def share_counts(posted: DataFrame, side: str) -> DataFrame:
    """share, side, packed counts by bucket: one row for each share and task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for share, bucket, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = np.bincount(np.frombuffer(bucket, "<i4"), np.frombuffer(n, "<i4")).astype(np.int64)
                old = sums.get(share, own[:0])
                if len(old) < len(own):
                    old, own = own, old
                old[: len(own)] += own
                sums[share] = old
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([side] * len(sums), pa.string()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["share", "side", "counts"])

    return posted.filter("share >= 0").select("share", "bucket", "n").mapInArrow(run, "share int, side string, counts binary")


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))


def share_gains(counts: DataFrame, buckets: int, shares: int, all_s: int, all_t: int) -> DataFrame:
    """share, gains: packed gains of a share's buckets, made where the counts of both sides meet."""

    def run(key, table):
        share = key[0].as_py()
        own = {side: np.zeros(-(-(buckets - share) // shares), np.int64) for side in "st"}
        for side, x in zip(table.column("side").to_pylist(), table.column("counts").to_pylist()):
            x = np.frombuffer(x, "<i8")
            own[side][: len(x)] += x
        gains = np.array([gain(int(s), int(t), all_s, all_t, buckets) for s, t in zip(own["s"], own["t"])], "<i8")
        return pa.table({"share": pa.array([share], pa.int32()), "gains": pa.array([gains.tobytes()], pa.binary())})

    return counts.groupBy("share").applyInArrow(run, "share int, gains binary")


def contributions(posted: DataFrame, gains: DataFrame, n_part: int, spread: int) -> DataFrame:
    """chunk, doc, weight: packed sums of gains by document, from each part of a share."""
    part = F.pmod(F.xxhash64("chunk"), F.lit(spread)).cast("int")
    own = posted.filter("share >= 0").select("share", part.alias("part"), "chunk", "bucket", "doc", "n", F.lit(None).cast("binary").alias("gains"))
    rest = [F.lit(None).cast(t).alias(c) for c, t in (("chunk", "long"), ("bucket", "binary"), ("doc", "binary"), ("n", "binary"))]
    sent = gains.select("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), *rest, "gains")
    both = own.unionByName(sent).repartitionById(n_part, F.pmod(F.col("share") * spread + F.col("part"), F.lit(n_part)).cast("int"))

    def run(batches):
        now = gained = None
        for b in batches:
            out: list[tuple[int, bytes, bytes]] = []
            for share, part, chunk, bucket, doc, n, gains in zip(*(b.column(i).to_pylist() for i in range(7))):
                if gains is not None:
                    now, gained = (share, part), np.frombuffer(gains, "<i8")
                    continue
                assert now == (share, part)  # gains come first
                doc = np.frombuffer(doc, "<i4")
                own, at = np.unique(doc, return_inverse=True)
                weight = np.zeros(len(own), np.int64)
                np.add.at(weight, at, gained[np.frombuffer(bucket, "<i4")] * np.frombuffer(n, "<i4"))
                out.append((chunk, own.tobytes(), weight.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "doc", "weight"])

    return both.sortWithinPartitions("share", "part", F.col("gains").isNull()).mapInArrow(run, "chunk long, doc binary, weight binary")


def weights(posted: DataFrame, contributed: DataFrame, n_part: int) -> DataFrame:
    """id, n_words, n_features, weight: contributions added up in each chunk."""
    none = F.lit(None).cast("binary")
    heads = posted.filter("share = -1").select("chunk", "ids", "words", "features", none.alias("doc"), none.alias("weight"))
    ids = posted.schema["ids"].dataType
    both = heads.unionByName(contributed.select("chunk", F.lit(None).cast(ids).alias("ids"), none.alias("words"), none.alias("features"), "doc", "weight"))
    to = F.pmod(F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(0xFFFFFFFF), F.lit(n_part)).cast("int")
    schema = T.StructType([T.StructField("id", ids.elementType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches):
        head = total = None

        def done():
            return pa.RecordBatch.from_arrays([head[0], *(pa.array(np.frombuffer(x, "<i8")) for x in head[1:]), pa.array(total)], schema.names)

        for b in batches:
            for i, (doc, weight) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                if doc is None:
                    if head:
                        yield done()
                    ids = b.column(1).slice(i, 1).flatten()
                    head, total = (ids, b.column(2)[i].as_py(), b.column(3)[i].as_py()), np.zeros(len(ids), np.int64)
                else:
                    total[np.frombuffer(doc, "<i4")] += np.frombuffer(weight, "<i8")
        if head:
            yield done()

    return both.repartitionById(n_part, to).sortWithinPartitions("chunk", F.col("doc").isNotNull()).mapInArrow(run, schema)


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int, max_run: int, scratch: Scratch) -> DataFrame:
    """id, n_words, n_features, weight of every row of ``docs``."""
    n_part = shuffle_partitions(docs.sparkSession)
    shares = min(buckets, max(n_part, 16))
    posted = scratch.keep(postings(docs, id_col, text_col, buckets, max_run, shares), "postings")
    wanted = postings(target.select(F.lit(0).alias("__id"), target_col), "__id", target_col, buckets, max_run, shares)
    counts = scratch.keep(share_counts(posted, "s").unionByName(share_counts(wanted, "t")), "counts")

    def total(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(np.frombuffer(x, "<i8").sum()) for x in b.column(1).to_pylist()], pa.int64())], ["side", "n"])

    sums = {r.side: r.n for r in counts.select("side", "counts").mapInArrow(total, "side string, n long").groupBy("side").agg(F.sum("n").alias("n")).collect()}  # two rows
    gains = scratch.keep(share_gains(counts, buckets, shares, sums.get("s", 0), sums.get("t", 0)), "gains")
    largest = posted.filter("share >= 0").groupBy("share").agg(F.sum(3 * F.length("doc")).alias("n")).agg(F.max("n")).first()[0] or 0
    spread = max(1, -(-largest // PART))
    return weights(posted, contributions(posted, gains, n_part, spread), n_part)


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, max_run: int = 1, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """id_col, n_features, weight, score and rank of every row of ``docs``; rank is null for rows that aren't drawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    n_part = shuffle_partitions(spark)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.keep(importance_weights(docs, target, id_col, text_col, target_col, buckets, max_run, scratch).withColumn("score", F.col("weight") + noise), "scored")
    scratch.drop("postings", "counts", "gains")
    may = scored.filter(F.col("n_words") >= min_words)
    ranged = may.repartitionByRange(n_part, F.desc("score"), F.asc_nulls_last("id")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id"))
    ranged = scratch.keep(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")  # partition number << 33 | row number
    part = F.shiftright("at", 33)
    counts = scratch.keep(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "parts")
    drawn = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_sample(docs, target)


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w
), bw AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w
), vocabulary AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
    lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, crc
), s AS (
  SELECT bucket, sum(n) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000) / ((s.n + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
