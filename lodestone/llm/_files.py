"""Files in the shared folder as executors' Python sees them: a mounted path, or a store that pyarrow opens."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(urlparse(uri).path)
    return pafs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream to a new file; folders above it are made."""
    fs, path = _at(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path, compression=None)  # else a name in .gz would be compressed once more


def read_ranges(uri: str):
    """A function (offset, length) -> bytes on one open file."""
    fs, path = _at(uri)
    file = fs.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        data = file.read(length)
        if len(data) != length:
            raise EOFError(f"{uri} ends within a record at {offset}")
        return data

    read.close = file.close
    return read


def read_parquet(uri: str) -> pa.Table:
    """One Parquet file."""
    fs, path = _at(uri)
    with fs.open_input_file(path) as f:
        return pq.read_table(f)
