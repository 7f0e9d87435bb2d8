"""Paths and sizes as a data source: ``spark.read.format("quire_listing").load(path)``.

The planner expands a pattern's folders; each folder is a partition, and the task that reads it lists it. Nothing is opened, and no listing
gathers on the driver. Empty files are listed, which Spark's own file scan leaves out. As there, a folder stands for
the files in it (not for those in folders below), and names that begin with ``.`` or ``_`` are hidden.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

#: Files of a batch.
ROWS = 8192
_stores: dict[str, tuple] = {}


def parted(path: str) -> tuple[str, str]:
    """``(prefix, name)`` of a path: ``file:`` or a store's URI, and the absolute name in it."""
    m = re.match(r"([a-zA-Z][\w+.-]+):(//[^/]*)?(.*)", path, re.S)
    if not m or m[1] == "file":
        return "file:", os.path.abspath(re.sub(r"^file:(//)?", "", path) or "/")
    return f"{m[1]}:{m[2] or '//'}", m[3] or "/"


def store_of(path: str) -> tuple:
    """The file system of a path and the path's name in it, as a worker sees them; an error where it knows no such store."""
    from pyarrow import fs

    prefix, name = parted(path)
    if prefix == "file:":
        return fs.LocalFileSystem(), name
    if prefix not in _stores:
        _stores[prefix] = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", prefix) + "/")
    store, base = _stores[prefix]
    return store, f"{base.rstrip('/')}{name}"


def reachable(path: str) -> bool:
    """Whether workers can open a path by themselves. Other stores are left to Spark's own reader."""
    try:
        return store_of(path) is not None
    except Exception:
        return False


def pattern(part: str) -> re.Pattern:
    """A glob of one level as a regular expression: ``*``, ``?``, ``[ab]``, ``[!ab]``, ``{a,b}`` and escapes."""
    out, depth, at = [], 0, 0
    while at < len(part):
        c = part[at]
        if c == "\\" and at + 1 < len(part):
            at += 1
            out.append(re.escape(part[at]))
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := part.find("]", at + 2)) > 0:
            inner = part[at + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            at = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append("|" if c == "," and depth else re.escape(c))
        at += 1
    return re.compile("".join(out) + r"\Z", re.S)


def is_glob(part: str) -> bool:
    return bool(re.search(r"[*?\[{\\]", part))


def shown(name: str) -> bool:
    return not name.startswith((".", "_"))


@dataclass
class Folder(InputPartition):
    prefix: str
    folder: str
    part: str


class Listing(DataSource):
    """``path`` is a file, a folder or a glob."""

    @classmethod
    def name(cls) -> str:
        return "quire_listing"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])


class ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.prefix, self.path = parted(path)

    def entries(self, folder: str):
        """``(name, info)`` of a folder, in order of names; none if it isn't there."""
        from pyarrow import fs

        store, at = store_of(f"{self.prefix}{folder}")
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(((f.base_name, f) for f in found), key=lambda x: x[0])

    def partitions(self):
        *above, last = self.path.strip("/").split("/")
        folders = ["/"]
        for part in above:
            if not is_glob(part):
                folders = [f"{f.rstrip('/')}/{part}" for f in folders]
            else:
                fits = pattern(part)
                folders = [f"{f.rstrip('/')}/{name}" for f in folders for name, info in self.entries(f) if fits.match(name) and not info.is_file and shown(name)]
        return [Folder(self.prefix, f, last) for f in folders] or [Folder(self.prefix, "", "")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[str, int]] = []

        def batch():
            columns = [pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "length"])

        for found in self.matches(partition):
            kept.append(found)
            if len(kept) >= ROWS:
                yield batch()
                kept = []
        if kept:
            yield batch()

    def matches(self, partition: Folder) -> Iterator[tuple[str, int]]:
        if not partition.folder:
            return
        fits = pattern(partition.part)
        base = partition.folder.rstrip("/")
        if is_glob(partition.part):
            entries = [(name, info) for name, info in self.entries(partition.folder) if fits.match(name) and shown(name)]
        else:
            store, at = store_of(f"{self.prefix}{base}/{partition.part}")
            entries = [(partition.part, store.get_file_info(at))]
        for name, info in entries:
            if info.is_file:
                yield f"{self.prefix}{base}/{name}", info.size
            elif info.type.name == "Directory":
                for inner, below in self.entries(f"{base}/{name}"):
                    if below.is_file and shown(inner):
                        yield f"{self.prefix}{base}/{name}/{inner}", below.size


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files of a path or glob."""
    ship(spark)
    spark.dataSource.register(Listing)
    return spark.read.format(Listing.name()).load(path)
