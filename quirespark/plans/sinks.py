"""Markdown out: tables, and a file for each document."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_layout
from ..scratch import deleted, scratch, stored
from ..sources.listing import store_of

#: Bytes that are copied at a time.
BLOCK = 8 << 20


def placed(markdown: DataFrame, source: str = "doc_id", target: str | None = None, suffix: str | None = None) -> DataFrame:
    """Adds ``output, output_dir, stem, assets_dir`` to each document."""
    place = output_layout(F.col(source), F.lit(target).cast("string"), F.lit(suffix) if suffix else None)
    return markdown.withColumn("__place", place).select("*", "__place.output", "__place.output_dir", "__place.stem", "__place.assets_dir").drop("__place")


def write_files(files: DataFrame, root: str, replaced: DataFrame | None = None) -> int:
    """Writes a file for each row ``(path, content binary)``, or ``(path, content, source)`` whose source is copied where there is no content, below ``root``: all or none.

    Every task writes below a staging folder, under names of its own, and lists what it wrote. The list is a stored table:
    Spark commits it, with the rows of attempts that succeeded alone. Only then, the folders of the one-column table ``replaced`` are emptied, and a second job moves the
    listed files to their places; a repeated move finds its file there already. An error before that leaves no file behind, and nothing but paths is shuffled or comes
    near the driver. Returns the number of files.
    """
    spark = files.sparkSession
    base = root if "://" in root else f"file://{root}"
    staging = f"{base.rstrip('/')}/.quire-{uuid4().hex}"
    given = files if "source" in files.columns else files.withColumn("source", F.lit(None).cast("string"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, source in zip(*batch.columns, strict=True):
                store, folder = store_of(staging)
                store.create_dir(folder)
                part = f"{folder}/{uuid4().hex}"
                with store.open_output_stream(part) as sink:
                    if content.is_valid or not source.is_valid:
                        sink.write(content.as_buffer() if content.is_valid else b"")
                    else:
                        origin, name = store_of(source.as_py())
                        with origin.open_input_stream(name) as stream:
                            while block := stream.read(BLOCK):
                                sink.write(block)
                out.append((path.as_py(), part.rpartition("/")[2]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["path", "part"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for path, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, folder = store_of(staging)
                full = path if path.startswith("/") else f"{store_of(base)[1].rstrip('/')}/{path}"
                if store.get_file_info(f"{folder}/{part}").is_file:
                    store.create_dir(full.rpartition("/")[0])
                    store.move(f"{folder}/{part}", full)
                elif not store.get_file_info(full).is_file:
                    raise FileNotFoundError(full)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    with scratch(spark):
        try:
            rows = given.select("path", F.col("content").cast("binary").alias("content"), "source").mapInArrow(stage, "path string, part string")
            listed = stored(rows).groupBy("path").agg(F.max("part").alias("part"))  # of rows with one path, one file
            if replaced is not None:
                reset_folders(replaced, root)
            return listed.mapInArrow(settle, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        finally:
            deleted(spark, [staging])


def reset_folders(folders: DataFrame, root: str) -> int:
    """Deletes the folders below ``root`` of a one-column table, with what an earlier run left there; returns how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = store_of(root if "://" in root else f"file://{root}")
        gone = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                full = path if path.startswith("/") else f"{base}/{path}"
                if store.get_file_info(full).type == fs.FileType.Directory:
                    store.delete_dir(full)
                    gone += 1
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["n"])

    return folders.distinct().mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def markdown_files(placed_docs: DataFrame) -> DataFrame:
    return placed_docs.select(F.col("output").alias("path"), F.encode(F.coalesce("markdown", F.lit("")), "UTF-8").alias("content"))


def source_copies(placed_docs: DataFrame) -> DataFrame:
    """``(path, source)``: each source beside its Markdown, under the output's stem. Sources are copied by path, so that no content is in a table."""
    ending = F.lower(F.regexp_extract(F.regexp_extract("doc_id", r"([^/]*)\z", 1), r"(\.[^.]+)\z", 1))
    return placed_docs.select(F.concat("output_dir", F.lit("/"), "stem", ending).alias("path"), F.lit(None).cast("binary").alias("content"), F.col("doc_id").alias("source"))


def write_table(markdown: DataFrame, path: str) -> None:
    """A table of documents; written anew, in place only once it is whole."""
    markdown.write.mode("overwrite").parquet(path)
