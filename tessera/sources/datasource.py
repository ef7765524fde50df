"""The indented table text as a Spark data source, for batch and streaming reads.

``spark.dataSource.register(TreeTextSource)`` and then ``spark.read.format("treetext").option("table", "nodes").load(path)``. Each file
is a partition, in batches and in streams. A stream takes each file once, when its time of change is later than that of all files taken before, whatever its name.

Paths may be local or of any store that pyarrow opens by its address (``s3://``, ``hdfs://``, ``gs://``); ``tables.files`` reads from every store that Spark reads.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .document import DocumentError
from .tables import SCHEMAS, rows_of
from .treetext import parse


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of an address, the path in it, and what stands before paths in addresses."""
    scheme = path.partition("://")[0] if "://" in path else path.partition(":")[0] if path.startswith("file:/") else ""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.partition(":")[2].lstrip("/") if scheme else path, ""
    store, inner = pafs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def _found(options: dict[str, str]) -> list[tuple[int, str]]:
    """Times of change and addresses of the files below a path, or of those that match its pattern."""
    if not options.get("path"):
        return []
    store, path, before = _store(options["path"])
    info = store.get_file_info(path)
    name = options.get("pathglobfilter", "*")
    if info.type == pafs.FileType.File:
        files = [info]
    elif info.type == pafs.FileType.Directory:
        files = store.get_file_info(pafs.FileSelector(path, recursive=True))
    else:  # a pattern: everything below the last folder without one
        base = path
        while any(c in base for c in "*?["):
            base = posixpath.dirname(base)
        files = [f for f in store.get_file_info(pafs.FileSelector(base or ".", recursive=True, allow_not_found=True)) if fnmatch(f.path, path)]
    return sorted((f.mtime_ns or 0, before + f.path) for f in files if f.type == pafs.FileType.File and fnmatch(f.base_name, name) and f.base_name[:1] not in "._")


def _rows(path: str, table: str, strict: bool, permissive: bool) -> Iterator[tuple]:
    store, inner, _ = _store(path)
    with store.open_input_stream(inner, compression=None) as f:
        data = f.read()
    try:
        doc = parse(data, strict)
    except DocumentError as e:
        if table == "diagnostics":
            yield path, e.kind, e.message, e.line
        elif not permissive:
            raise
        return
    yield from rows_of(path, doc, table, data.decode("utf-8", "replace") if table == "aliases" else "")


def _plain(row: tuple) -> tuple:
    """Cells as a map; the source takes dicts for maps and tuples for structs."""
    out = []
    for x in row:
        if isinstance(x, list) and x and isinstance(x[0], tuple):
            out.append({k: tuple(v.values()) for k, v in x})
        elif isinstance(x, dict):
            out.append(tuple(x.values()))
        else:
            out.append({} if isinstance(x, list) else x)
    return tuple(out)


class TreeTextSource(DataSource):
    """Options: path, table (nodes), strict (true), mode (FAILFAST or PERMISSIVE), pathGlobFilter."""

    @classmethod
    def name(cls) -> str:
        return "treetext"

    def schema(self) -> StructType | str:
        return SCHEMAS[self.options.get("table", "nodes")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def _partition_rows(options: dict[str, str], partition: _File) -> Iterator[tuple]:
    if partition.path:
        for row in _rows(partition.path, options.get("table", "nodes"), options.get("strict", "true") == "true", options.get("mode", "FAILFAST").upper() == "PERMISSIVE"):
            yield _plain(row)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for _, p in _found(self.options)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _partition_rows(self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is the latest time of change of the files taken, and the files of that time."""

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def initialOffset(self) -> dict:
        return {"time": -1, "files": []}

    def latestOffset(self) -> dict:
        found = _found(self.options)
        last = found[-1][0] if found else -1
        return {"time": last, "files": [p for t, p in found if t == last]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [p for t, p in _found(self.options) if (t > start["time"] or t == start["time"] and p not in start["files"]) and (t < end["time"] or t == end["time"] and p in end["files"])]
        return [_File(p) for p in new] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _partition_rows(self.options, partition)
