"""Paged answers as a data source: pages of a parent are read one after another by their tokens, up to a cap.

A folder holds ``<share>/<parent>/<token>.json``, an answer each: ``{"items": [...], "nextPageToken": "..."}``.  A share is a
partition, and its task lists the parents in it, so the driver lists shares only.  No page is opened once a parent has given as many items
as the cap allows, whatever comes behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from lodestone.runtime import ship
from lodestone.sources.filesink import opened, write_files

FIRST = "first"
FIELDS = ["parent", "place", "page", "item"]


@dataclass
class Share(InputPartition):
    path: str


class PagesReader(DataSourceReader):
    def __init__(self, folder: str, cap: int):
        if cap < 0:
            raise ValueError("the cap is 0 at least")
        self.folder, self.cap = folder, cap

    def _folders(self, fs: pafs.FileSystem, path: str) -> list[str]:
        return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.Directory)

    def partitions(self) -> list[Share]:
        fs, root = opened(self.folder)
        return [Share(p) for p in self._folders(fs, root)] or [Share("")]

    def _items(self, fs: pafs.FileSystem, parent: str) -> Iterator[tuple]:
        token, place, page, seen = FIRST, 0, 0, set()
        while token and place < self.cap and token not in seen:
            seen.add(token)
            with fs.open_input_stream(f"{parent}/{token}.json") as f:
                answer = json.loads(f.read())
            for item in (answer.get("items") or [])[: self.cap - place]:
                yield parent.rsplit("/", 1)[1], place, page, json.dumps(item, ensure_ascii=False)
                place += 1
            token, page = answer.get("nextPageToken"), page + 1

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.folder)
        rows, kinds = [], [pa.string(), pa.int32(), pa.int32(), pa.string()]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], FIELDS)

        for parent in self._folders(fs, share.path) if share.path else []:
            for row in self._items(fs, parent):
                rows.append(row)
                if len(rows) == 1000:
                    yield told()
                    rows.clear()
        yield told()


class PagesSource(DataSource):
    """``spark.read.format("lodestone_pages").option("cap", 200).load(folder)``: parent, place, page, item (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"

    def schema(self) -> str:
        return "parent string, place int, page int, item string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"], int(self.options.get("cap", "200")))


def write_pages(items: DataFrame, parent: str, order: list[str], item: F.Column, size: int, folder: str, shares: int = 64) -> str:
    """Answers of ``size`` items for each parent, in the order of ``order``, the first of which is its items' number from 0.

    A page holds the items whose numbers share a multiple of ``size``; a token names the next page that there is.  Only page numbers
    are ordered along a parent, so a parent with a third of all items is no one task's.
    """
    page = F.floor(F.col(order[0]) / size).cast("long")
    own = items.filter(F.col(parent).isNotNull() & F.col(order[0]).isNotNull()).select(F.col(parent).cast("string").alias("parent"), page.alias("page"), F.struct(*order, item.alias("item")).alias("x"))
    numbers = own.select("parent", "page").distinct()
    w = Window.partitionBy("parent").orderBy("page")
    told = numbers.select("parent", "page", F.lag("page").over(w).alias("before"), F.lead("page").over(w).alias("after"))
    answers = own.groupBy("parent", "page").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items")).join(told, ["parent", "page"])
    token = F.when(F.col("before").isNull(), F.lit(FIRST)).otherwise(F.concat(F.lit("p"), F.col("page").cast("string")))
    following = F.when(F.col("after").isNotNull(), F.concat(F.lit("p"), F.col("after").cast("string")))
    body = F.to_json(F.struct("items", following.alias("nextPageToken")))
    share = F.pmod(F.xxhash64("parent"), F.lit(shares)).cast("string")
    return write_files(answers.select(F.concat_ws("/", share, "parent", F.concat(token, F.lit(".json"))).alias("path"), body.alias("text")), folder)


def read_pages(spark: SparkSession, folder: str, cap: int = 200) -> DataFrame:
    """parent, place, page, item: the first ``cap`` items of each parent."""
    ship(spark)
    spark.dataSource.register(PagesSource)
    return spark.read.format(PagesSource.name()).option("cap", cap).load(folder)
