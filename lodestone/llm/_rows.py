"""Helpers shared by the operators on documents.

A row's place is the file that holds it and its index in that file.  Verdicts travel to rows by place: what was found out
about rows is written as a table sorted by place, and the tasks that read the rows look up the few parts of it that
their own file sections meet.  Whole texts are therefore never shuffled to meet a verdict, however many rows have one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import _files
from lodestone.runtime import Scratch, shuffle_partitions

#: ASCII white space, as in the pattern [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of a place that name the file; eight more are the row's index, big-endian, so the places of a file sort as its rows do.
FILE = 16


def place(df: DataFrame) -> Column:
    """The place of a row of ``placed(df)``: 24 bytes."""
    own = df.metadataColumn("_metadata")
    return F.concat(F.unhex(F.md5(own["file_path"].cast("binary"))), F.unhex(F.lpad(F.hex(own["row_index"]), 16, "0")))


def _reads_files(df: DataFrame) -> bool:
    """Whether ``df`` does no more than read files, each once, and filter and select; no row of a file is then there twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select(place(df))
        return len(plan.relation().location().inputFiles()) == len(df._jdf.inputFiles())
    except (AnalysisException, AttributeError):
        return False


def placed(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` if it only reads files that tell row indexes, else as written to the shared folder and read back."""
    return df if _reads_files(df) else scratch.keep(df, "placed")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class _Parts:
    """The table of a lookup as a task reads it: parts in the order of their places, two of them held at once."""

    def __init__(self, edges: list[tuple[bytes, bytes, str]]):
        self.first, self.last, self.uri = ([e[k] for e in edges] for k in range(3))
        self.held: dict[int, tuple[dict[bytes, list[int]], pa.Table]] = {}

    def _part(self, k: int) -> tuple[dict[bytes, list[int]], pa.Table]:
        if k not in self.held:
            if len(self.held) > 1:
                del self.held[next(iter(self.held))]
            table = _files.read_parquet(self.uri[k])
            known: dict[bytes, list[int]] = {}
            for i, x in enumerate(table.column(0).to_pylist()):
                known.setdefault(x, []).append(i)
            self.held[k] = known, table.remove_column(0)
        return self.held[k]

    def find(self, places: list[bytes]):
        """(part, numbers in ``places``, numbers in the part) for every part that has some of ``places``."""
        files: dict[bytes, list[int]] = {}
        for i, x in enumerate(places):
            files.setdefault(x[:FILE], []).append(i)
        for rows in files.values():
            own = [places[i] for i in rows]
            for k in range(bisect_left(self.last, min(own)), bisect_right(self.first, max(own))):
                known, table = self._part(k)
                if hit := [(i, j) for i, x in zip(rows, own) for j in known.get(x, ())]:
                    yield table, *(np.array(x) for x in zip(*hit))


def look_up(df: DataFrame, table: DataFrame, scratch: Scratch, name: str, run, schema: T.StructType | str, *columns: Column | str, key: Column | None = None) -> DataFrame:
    """What ``run`` makes of the rows of ``df`` and what ``table`` says of them.

    ``df`` is from ``placed``; ``table`` has a column place and others.  ``run`` is given, for each partition of ``df``,
    pairs of an Arrow batch of ``columns`` (all of ``df``) with the place as the last one, and for each part of the table
    that has some of its rows (part, rows of the batch, rows of the part); it yields batches of ``schema``.
    """
    spark = df.sparkSession
    table = scratch.keep(table, f"{name}_rows")
    table = scratch.keep(table.repartitionByRange(shuffle_partitions(spark), "place").sortWithinPartitions("place").select("place", *(c for c in table.columns if c != "place")), name)
    scratch.drop(f"{name}_rows")
    part = table.metadataColumn("_metadata")["file_path"]
    edges = table.select(part.alias("part"), "place").groupBy("part").agg(F.min("place").alias("a"), F.max("place").alias("z")).orderBy("a").collect()  # a row for each part
    sent = spark.sparkContext.broadcast([(bytes(e.a), bytes(e.z), e.part) for e in edges])

    def each(batches):
        parts = _Parts(sent.value)
        yield from run((b, list(parts.find(b.column(b.num_columns - 1).to_pylist()))) for b in batches)

    return df.select(*(columns or ["*"]), (place(df) if key is None else key).alias(fresh(df, "place"))).mapInArrow(each, schema)


def keep_rows(df: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` (from ``placed``) without the rows at the places ``gone``."""

    def run(pairs):
        for b, found in pairs:
            stays = np.ones(b.num_rows, bool)
            for _, rows, _ in found:
                stays[rows] = False
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(stays))

    return look_up(df, gone.select("place"), scratch, "gone", run, df.schema)
