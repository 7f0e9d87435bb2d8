"""Media columns: archives of images, read by a data source that plans byte ranges.

Each text's bytes, padded with zeros to a multiple of 64, become an 8-bit grey PNG
of width 64 (deflate is lossless). Tasks write them as stored members of ZIP
archives of bounded size in the shared folder; an archive counts only once its task
has returned its name, so that repeated or lost attempts leave no rows.

The data source ``quire_archive`` plans ranges of bytes over the archives from
their sizes alone. A task reads its archive's directory, takes the members whose
header lies in its range, and streams them as Arrow batches of bounded size. Each
member is read by its own offset and checked against its CRC; one that fails is
read again by itself, on a newly opened file.

Edge cases. A null text is an empty one: 64 zero bytes. Equal texts give equal
members and features; repeated rows are members of their own. A null id stays
null. An empty table gives no archives and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import emit, records, shared_folder, tidy

WIDTH = 64
#: Bytes after which a task begins another archive, and of a planned range.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
ATTEMPTS = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(data: bytes) -> bytes:
    """``data``, padded, as the samples of a PNG; its length before padding is a text chunk."""
    payload = data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The samples, and the length before padding, of what :func:`encode_image` made."""
    at, size, packed = len(SIGNATURE), 0, []
    while at < len(media):
        (length,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + length]
        if kind == b"tEXt":
            size = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), size


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy and a 64-bit difference hash of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = int(samples.sum(dtype=np.int64)) / len(samples)
    square = int((counts * np.arange(256) ** 2).sum()) / len(samples)
    cuts = np.linspace(0, len(samples), 66).astype(int)
    sums = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    cells = (sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(cuts[1:] - cuts[:-1], 1)
    bits = np.packbits(cells[1:] > cells[:-1]).tobytes().hex()
    return f"mean={mean:.4f};dev={max(square - mean * mean, 0) ** 0.5:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};dhash={bits}"


def _files(uri: str):
    """The file system of a folder's URI, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_archives(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Archives of the images of ``text_col``, and ``manifest.json`` with their names and sizes."""
    schema = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            files, at = _files(folder)
            archive = stream = name = None
            count = 0
            for key, text in records(batches):
                if archive is None:
                    name, count = f"{uuid.uuid4().hex}.zip", 0
                    stream = files.open_output_stream(f"{at}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{count:08d}-{'null' if key is None else key}.png")
                archive.writestr(member, encode_image((text or "").encode("utf-8", "replace")))
                count += 1
                if stream.tell() >= ARCHIVE_BYTES:
                    archive.close()
                    yield name, stream.tell(), count
                    stream.close()
                    archive = None
            if archive is not None:
                archive.close()
                yield name, stream.tell(), count
                stream.close()

        yield from emit(rows(), schema)

    files, at = _files(folder)
    files.create_dir(at)
    manifest = df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), "name string, bytes long, members long")
    found = sorted((r.name, r.bytes) for r in manifest.collect())  # a row for each archive
    with files.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(found).encode())


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveSource(DataSource):
    """``spark.read.format("quire_archive").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "quire_archive"

    def schema(self) -> str:
        return "doc_id long, member string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        files, at = _files(self.folder)
        with files.open_input_stream(f"{at}/manifest.json") as f:
            found = json.loads(f.read())
        return [ByteRange(name, start, min(start + RANGE_BYTES, size)) for name, size in found for start in range(0, size, RANGE_BYTES)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "member", "offset", "media"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        if not partition.path:
            return
        files, at = _files(self.folder)
        path = f"{at}/{partition.path}"
        with files.open_input_file(path) as f:
            with zipfile.ZipFile(f) as archive:
                members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
            kept, held = [], 0
            for m in members:
                media = read_member(files, path, f, m)
                key = m.filename[9:-4]
                kept.append((None if key == "null" else int(key), m.filename, m.header_offset, media))
                held += len(media) + 64
                if held >= 4 << 20:
                    yield batch(kept)
                    kept, held = [], 0
        if kept:
            yield batch(kept)


def read_member(files, path: str, file, member: zipfile.ZipInfo) -> bytes:
    """One member's bytes by its offset; again by itself, on a new file, if that fails."""
    for attempt in range(ATTEMPTS):
        own = None
        try:
            if attempt:
                file = own = files.open_input_file(path)
            file.seek(member.header_offset)
            head = file.read(30)
            if len(head) != 30 or head[:4] != b"PK\x03\x04":
                raise OSError(f"{path}: the member at {member.header_offset} has no header")
            names, extra = struct.unpack("<HH", head[26:30])
            file.seek(member.header_offset + 30 + names + extra)
            data = file.read(member.compress_size)
            if len(data) != member.compress_size or zlib.crc32(data) != member.CRC:
                raise OSError(f"{path}: the member at {member.header_offset} is damaged")
            return data
        except OSError:
            if attempt + 1 == ATTEMPTS:
                raise
        finally:
            if own is not None:
                own.close()
    raise AssertionError


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["x"]))  # the planning process may lack this package
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("quire_archive").load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of each member's samples."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, data in records(batches):
                payload, size = decode_image(data)
                yield key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)

        yield from emit(rows(), schema, lambda row: 400)

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(df: DataFrame) -> DataFrame:
    """Writes the archives below the shared folder, reads them back and computes features."""
    folder = shared_folder(df.sparkSession)
    write_archives(df, folder)
    return media_features(read_archives(df.sparkSession, folder))
