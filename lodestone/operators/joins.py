"""Join shapes: summaries on hits, manifests, labels, zips, closures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.runtime import Scratch, shuffle_partitions

#: Keys of a block at most, keys for which a block of its own is worth while, and shared items that a task counts at once.
BLOCK, LEAST, STEP = 65_536, 1_024, 1 << 18


def with_summaries(hits: DataFrame, summaries: DataFrame, key: str = "object_id") -> DataFrame:
    """Hits left-joined to the last summary of each id; only useful properties stay, all of them if that leaves none.

    ``hits``: key, properties map<string, string>.  ``summaries``: key, n, relevance, summary, useful_properties.
    """
    last = summaries.groupBy(key).agg(F.max_by(F.struct("relevance", "summary", "useful_properties"), "n").alias("s"))
    useful = F.coalesce(F.col("s.useful_properties"), F.array().cast("array<string>"))
    trimmed = F.map_filter("properties", lambda k, _: F.array_contains(useful, k))
    return hits.join(last, key, "left").select(*(c for c in hits.columns if c != "properties"), F.col("s.relevance").alias("relevance"), F.col("s.summary").alias("summary"), F.when(F.size(trimmed) > 0, trimmed).otherwise(F.col("properties")).alias("properties"))


def three_way(source: DataFrame, installed: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, action of files (path, hash) shipped, present, and recorded when they were installed."""
    s, d, m = (df.select("path", F.col("hash").alias(n)) for df, n in ((source, "s"), (installed, "d"), (manifest, "m")))
    action = (
        F.when(F.col("s").isNull() & F.col("m").isNotNull(), F.when(F.col("d").isNull(), "gone").when(F.col("d") == F.col("m"), "obsolete").otherwise("user modified"))
        .when(F.col("s").isNull(), "foreign")
        .when(F.col("d").isNull(), "new")
        .when(F.col("d") == F.col("s"), "up to date")
        .when(F.col("m").isNull() | (F.col("d") != F.col("m")), "user modified")
        .otherwise("updated")
    )
    return s.join(d, "path", "full").join(m, "path", "full").select("path", action.alias("action"))


def label(df: DataFrame, code: str, labels: dict[str, str]) -> Column:
    """The code's label, or the code itself."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col(code)), F.col(code))


def zip_shortest(*arrays: str) -> Column:
    """Structs of the arrays' items, as many as the shortest has."""
    least = F.least(*(F.size(a) for a in arrays))
    return F.slice(F.arrays_zip(*arrays), 1, least)


def first_match(df: DataFrame, presets: DataFrame, on: list[str], name: str = "name", order: str = "n") -> DataFrame:
    """``df`` with the name of the first preset that agrees in all of ``on``."""
    best = presets.groupBy(*on).agg(F.min_by(name, order).alias(name))
    return df.join(F.broadcast(best), on, "left")  # presets are a fixed, short list


def midpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, x, y of edges whose ends both exist."""
    a, b = (nodes.select(F.col("id").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y")) for n in ("source", "target"))
    both = edges.join(a, "source").join(b, "target")
    return both.select("source", "target", ((F.col("source_x") + F.col("target_x")) / 2).alias("x"), ((F.col("source_y") + F.col("target_y")) / 2).alias("y"))


def shared_items(df: DataFrame, key: str, items: str) -> DataFrame:
    """item, a, b: for each item, its smallest key a beside every other key b that has it.

    A star for each item, which grows with the rows.  No link is lost: two keys share an item if each is its a or one of
    its b, and as many items as that holds for; ``shared_pairs`` spells the pairs out.
    """
    own = shared_members(df, key, items)
    return own.filter(F.col("representative") < F.col(key)).select("item", F.col("representative").alias("a"), F.col(key).alias("b"))


def shared_members(df: DataFrame, key: str, items: str) -> DataFrame:
    """item, representative, key: every key of every item beside the item's smallest key.

    It grows with the rows and loses nothing: two keys share as many items as they have in common here.
    """
    own = held_items(df, key, items)
    return own.join(own.groupBy("item").agg(F.min(key).alias("representative")), "item").select("item", "representative", key)


def held_items(df: DataFrame, key: str, items: str) -> DataFrame:
    """item, key: every key of every item, once."""
    return df.select(F.explode(F.array_distinct(items)).alias("item"), key).distinct()


def shared_pairs(members: DataFrame, key: str) -> DataFrame:
    """a, b, n: all pairs a < b of keys that share items, with the number of items they share.

    ``members``: item, key, each once.  The result grows with the square of an item's keys, but nothing else does: keys are dealt into
    blocks by their order, each with the numbers of its items in one row, and every cell of two blocks is a task's work.  All items
    of a pair meet in its one cell, so counts are whole there, and pairs are made by some ``STEP`` shared items at a time and
    handed out; they are neither shuffled nor kept.  What is shuffled is a row for each key and block.
    """
    spark = members.sparkSession
    scratch, n_part = Scratch(spark, "shared_pairs"), shuffle_partitions(spark)
    held = scratch.keep(members.select("item", F.col(key).alias("key")).filter("item IS NOT NULL AND key IS NOT NULL"), "held")
    numbers = held.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select("item", F.monotonically_increasing_id().alias("number"))
    numbers = scratch.keep(numbers, "numbers")
    keys = scratch.keep(held.join(numbers, "item").groupBy("key").agg(F.collect_list("number").alias("items")), "keys")
    n = keys.count()
    blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST), round((4 * n_part) ** 0.5)))  # twice as many cells as tasks, if there are keys for it
    dealt = keys.repartitionByRange(blocks, "key").select(F.spark_partition_id().alias("block"), "key", "items")
    dealt = scratch.keep(dealt, "blocks")  # written, as ranges are drawn from samples
    scratch.drop("held", "numbers", "keys")
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    rows = every.select((F.shiftright(high * (high + 1), 1) + low).alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "items")
    dealt_out = rows.repartitionById(blocks * (blocks + 1) // 2, F.col("cell").cast("int"))  # a cell each, so a file repeats few keys many times
    cells = dealt_out.sortWithinPartitions("cell", "side", "key")
    kind = members.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType(), False)])
    return cells.mapInArrow(_pairs(STEP, schema.names), schema)


def _pairs(step: int, names: list[str]):
    """A mapInArrow function over rows (cell, side, key, items) sorted by cell, side and key: a, b, n of each cell's pairs.

    A cell of two blocks has the keys of the lower one on side 0, those of the other on side 1; a block's cell with itself has side 0 only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done():
            if sides[0]:
                yield from _counted(*([pa.concat_arrays([b.column(i) for b in own]) for i in (2, 3)] if own else None for own in sides), step, names)

        for b in batches:
            cell, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0))
            for x, y in zip(cuts, [*cuts[1:], b.num_rows]):
                if cell[x] != now:
                    yield from done()
                    now, sides = cell[x], ([], [])
                sides[side[x]].append(b.slice(x, y - x))
        yield from done()

    return run


def _counted(left: list[pa.Array], right: list[pa.Array] | None, step: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of left and right keys (keys, their items), or of left keys if there is no right, with counts: as many left keys at a time as share ``step`` items."""
    left_keys, left_items = left
    right_keys, right_items = right or (left_keys, left_items)
    (own, sizes), (other, widths) = ((i.flatten().to_numpy(), i.value_lengths().to_numpy()) for i in (left_items, right_items))
    m, by = len(widths), np.argsort(other, kind="stable")
    holders, other = np.repeat(np.arange(m), widths)[by], other[by]  # the right rows of an item are a range of holders
    first = np.searchsorted(other, own, "left")
    many = np.searchsorted(other, own, "right") - first
    ends, shares = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, many))
    reach = shares[ends]

    def met(x: int, y: int) -> np.ndarray:
        """The right rows that the left entries from x to y meet, one behind the other."""
        return holders[np.repeat(first[x:y] - shares[x:y], many[x:y]) + np.arange(shares[x], shares[y])]

    def upto(sums: np.ndarray, x: int) -> int:
        """One step from x, or as many as share ``step`` items at most."""
        return max(x + 1, int(np.searchsorted(sums, sums[x] + step, "right")) - 1)

    row = 0
    while row < len(sizes):
        past = upto(reach, row)
        x, y = int(ends[row]), int(ends[past])
        if reach[past] - reach[row] > step:  # one key that shares more: its counts are summed up item by item
            count = np.zeros(m, np.int64)
            while x < y:
                to = min(y, upto(shares, x))
                count += np.bincount(met(x, to), minlength=m)
                x = to
            b = np.flatnonzero(count)
            a, n = np.full(len(b), row), count[b]
        else:
            at = np.repeat(np.repeat(np.arange(past - row), sizes[row:past]), many[x:y]) * m + met(x, y)
            at.sort()
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            n = np.diff(cuts, append=len(at))
            a, b = np.divmod(at[cuts], m)
            a += row
        if right is None:
            a, b, n = (v[a < b] for v in (a, b, n))
        if len(n):
            yield pa.RecordBatch.from_arrays([left_keys.take(pa.array(a)), right_keys.take(pa.array(b)), pa.array(n)], names)
        row = past


def closure(start: DataFrame, step: DataFrame, most: int = 5) -> DataFrame:
    """key, target, hops: where a chain of single steps (src, dst) ends, after at most ``most`` of them."""
    now = start.select("key", F.col("at").alias("target"), F.lit(0).alias("hops"))
    for _ in range(most):
        now = now.join(step.select(F.col("src").alias("target"), "dst"), "target", "left").select("key", F.coalesce("dst", "target").alias("target"), (F.col("hops") + F.col("dst").isNotNull().cast("int")).alias("hops"))
    return now


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def chain_ends(links: DataFrame, id_col: str = "id", next_col: str = "next") -> DataFrame:
    """id, end, hops, cycle: where the chain of links that begins at each id ends, after how many links.

    ``links`` has one row for each id; a null next ends a chain, as does one that is no id itself (it is the end then).  Chains
    are followed by pointer doubling: each round joins what is still under way with where its pointer leads, so a chain of n
    links takes log2 n rounds.  As long as some chain has an end, a round brings some row to it; so once a round brings
    none, what is left runs into a cycle: end and hops are null, cycle is true.  Each round's rows are a written table.
    """
    scratch = Scratch(links.sparkSession, "chain_ends")
    own = links.select(F.col(id_col).alias("id"), F.col(next_col).alias("to"))
    ids = own.select(F.col("id").alias("to"), F.lit(True).alias("known"))
    rows = own.join(ids, "to", "left")
    start = rows.select("id", F.when(F.col("to").isNull(), F.col("id")).otherwise(F.col("to")).alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops"), (F.col("to").isNotNull() & F.col("known").isNotNull()).alias("open"))
    now = scratch.keep(start, "round0")
    left, n = now.filter("open").count(), 0
    while left:
        n += 1
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("open").alias("still"))
        moved = now.filter("open").join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("still").alias("open"))
        now = scratch.keep(now.filter("NOT open").unionByName(moved), f"round{n}")
        scratch.drop(f"round{n - 1}")
        before, left = left, now.filter("open").count()
        if left == before:
            break
    return now.select("id", F.when(~F.col("open"), F.col("to")).alias("end"), F.when(~F.col("open"), F.col("hops")).alias("hops"), F.col("open").alias("cycle"))
