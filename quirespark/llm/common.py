"""What the operators share: scratch tables, bounded Arrow batches, global order."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import deleted, scratch, shared_folder, stored  # noqa: F401
from ..shipping import ship as python_path  # noqa: F401

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of output that a Python worker gathers before it hands a batch on.
BATCH_BYTES = 8 << 20


#: What a worker drops at the end of a task: memos and tables that its modules keep.
RELEASED: list[Callable] = []


def tidy(run: Callable, keep: Callable | None = None) -> Callable:
    """``run`` for ``mapInArrow``, after which the worker gives its memory back: it is used again for tasks of other operators.

    ``keep`` is the one of ``RELEASED`` that stays, for the next task of the same operator; the first task of another one drops it.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return wrapped


def give_back(keep: Callable | None = None) -> None:
    for release in RELEASED:
        if release is not keep:
            release()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing is given back then
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def emit(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``BATCH_BYTES`` each, by ``size`` of a row in bytes."""
    kept, total = [], 0
    for row in rows:
        kept.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield _batch(kept, schema)
            kept, total = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of record batches as tuples, a slice of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)


def int_lists(values: list[bytes]) -> pa.Array:
    """A column of integer lists from little-endian 32-bit integers."""
    ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), dtype="<i4")))


def cut_points(df: DataFrame, key: str, parts: int) -> list[float]:
    """At most ``parts - 1`` ascending values that part ``key`` into ranges of about as many rows each.

    Their number is bounded by ``parts``; only ``key`` is read.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", shares, 1 / (4 * parts))))


def range_of(key: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts that are at most ``key`` (null: 0), by binary search."""
    if not cuts:
        return F.lit(0)
    bits = len(cuts).bit_length()
    padded = [*cuts, *[float("inf")] * ((1 << bits) - 1 - len(cuts))]
    table, value = F.lit(padded), key.cast("double")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.element_at(table, low + step) <= value, low + step).otherwise(low))
    return F.least(F.coalesce(found, F.lit(0)), F.lit(len(cuts)))


def offsets(df: DataFrame, part: str, total: Column, parts: int) -> list:
    """What lies before each part: running sums over at most ``parts`` rows, one for each part."""
    sums = {r[0]: r[1] for r in df.groupBy(part).agg(total).collect()}
    out, at = [], 0
    for i in range(parts):
        out.append(at)
        at += sums.get(i) or 0
    return out


def pick(values: Sequence, index: Column) -> Column:
    """``values[index]`` for a list that is bounded by the number of parts."""
    return F.element_at(F.lit(list(values)), index + 1)
