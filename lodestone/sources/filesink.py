"""A sink of whole files: one for each row (path, text), seen together or not at all.

A write goes to a folder of its own, a version.  Its tasks write each file under another name first and then move it, so that
a task that is tried again, or runs twice, puts the same whole files in place.  When all tasks have ended the driver lets one small
file, ``_current``, name the version; readers follow it.  A write that fails removes its version and leaves the one before.
The driver's work is the same for ten files and for ten million: it lists none of them.

Files are opened through pyarrow, so the folder must be on a file system that pyarrow opens, as the shared folder is.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestone.runtime import ship

CURRENT = "_current"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """A whole file, or none: written under another name and moved."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        out.write(data)
    try:
        fs.move(own, path)
    except OSError:  # some file systems don't move onto a file
        fs.delete_file(path)
        fs.move(own, path)


def safe(path: str | None) -> str:
    """The path, if it stays below the folder it is put in."""
    if not path or path.startswith("/") or "\\" in path or "\0" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"not a path below the folder of a sink: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.version = folder, f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.folder)
        n, made = 0, set()
        for b in iterator:
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                own = f"{root}/{self.version}/{safe(path)}"
                parent = posixpath.dirname(own)
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made = made if len(made) < 10_000 else set()  # a memo only
                    made.add(parent)
                put(fs, own, (text or "").encode())
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        fs.create_dir(f"{root}/{self.version}", recursive=True)  # where there was no row
        put(fs, f"{root}/{CURRENT}", self.version.encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        if fs.get_file_info(f"{root}/{self.version}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.version}")


class FilesSource(DataSource):
    """``df.write.format("lodestone_files").mode("overwrite").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if not overwrite:
            raise ValueError("a write is a new version: use mode('overwrite')")
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> str:
    """Write (path, text) rows as files below ``folder``; the folder of the version that is now current.

    A null text is an empty file.  Paths must differ: of equal ones that with the largest text is written.
    A path that is null, or leads out of the folder, fails the write as a whole.
    """
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(FilesSource)
    own = files.groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    own.write.format(FilesSource.name()).mode("overwrite").save(folder)
    return current(folder)


def current(folder: str) -> str:
    """The folder of the version that readers see."""
    fs, root = opened(folder)
    with fs.open_input_stream(f"{root}/{CURRENT}") as f:
        return f"{folder}/{f.read().decode()}"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the current version's files; Spark's readers pass over files without bytes."""
    own = current(folder)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(own)
    return rows.select(below(F.col("path"), own).alias("path"), F.decode("content", "UTF-8").alias("text"))


def below(path: Column, folder: str) -> Column:
    """What of a file's path lies below a version's folder."""
    name = posixpath.basename(folder)
    return F.substring_index(path, f"/{name}/", -1)
