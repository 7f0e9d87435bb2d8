"""Removal of benchmark passages: windows of a benchmark's words, looked up in every document.

Words are runs of letters and digits, lower-cased in A-Z; anything outside ASCII belongs to
words. The windows of the items (``WINDOW`` words; a shorter item is one window) become a hash set of a
checked size, which is broadcast with the windows' own words. A task hashes all word windows
of its texts from prefix sums, one gather for each window length that the items have, looks them
up in a bit map of the set, and holds what it finds against the window's words, byte by byte. Spans or whole
documents are then taken out (:func:`without_spans`, :func:`without_documents`). Nothing is shuffled.

A benchmark whose windows exceed ``BROADCAST_BYTES`` takes another way: only a bit map of fixed
size is broadcast, windows that it lets through are joined with the items' windows on their words, which
verifies them too, and a document's hits are gathered by its id and text. Such a join is split where it is skewed
by adaptive execution; both sides are distinct within a document and within the benchmark.

Edge cases. A null text has no words, in either table; an item without words has no window. Rows of the
benchmark with equal ids are one item; a null id is an item of its own, listed as the empty string. Rows of documents
stand for themselves, also when they repeat another or have no id. Texts are taken whole, however long. An
empty benchmark leaves all documents clean; an empty table gives no rows. Other columns of the benchmark
are not read; those of documents are kept by the two removals, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RELEASED, emit, records, stored, tidy
from .wordhash import _bytes, _odd, buffers, run, runs, slabs

WINDOW = 10
# Fixed value: what separates words, after A-Z became a-z.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Bytes of windows (words, hash and item ids) up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of the map that a larger benchmark is looked up in first: 2**MAP_BITS.
MAP_BITS = 27
_base = 0x9FB21C651E98DF25 | 1
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_part = np.zeros(256, bool)
_part[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_known: dict[int, "Windows"] = {}


def forget() -> None:
    _known.clear()


RELEASED.append(forget)


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of lower-cased ``data``, and the words before each of ``borders``."""
    part = _part[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[borders] = True
    first, last = part.copy(), part.copy()
    first[1:] &= ~part[:-1] | edge[1:-1]
    last[:-1] &= ~part[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return run(runs(_bytes[data], _odd), _odd, start, end, 31), start, end, np.searchsorted(start, borders)


def window_hashes(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of ``size`` words that lie within one document."""
    at = np.arange(max(0, len(hashes) - size + 1))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    number = np.diff(before)
    at = at[at + size <= np.repeat(before[1:], number)[at]]
    return at, run(runs(hashes, _base), _base, at, at + size, 32)


def slab_words(column: pa.Array):
    data, borders = buffers(column)
    low = int(borders[0])
    data = _lower[data[low : int(borders[-1])]]
    return data, *words(data, borders - low)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, size: int) -> bytes:
    return b" ".join([data[a:b].tobytes() for a, b in zip(start[at : at + size].tolist(), end[at : at + size].tolist(), strict=True)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, n, hash, words binary)``, distinct: every window of every item, its words joined by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for slab in slabs(batch, 1):
                    data, hashes, start, end, before = slab_words(slab.column(1))
                    for i, item in enumerate(slab.column(0).to_pylist()):
                        number = int(before[i + 1] - before[i])
                        if not number:
                            continue
                        size = min(window, number)
                        at = np.arange(before[i], before[i + 1] - size + 1)
                        for k, h in zip(at.tolist(), run(runs(hashes, _base), _base, at, at + size, 32).view(np.int64).tolist(), strict=True):
                            yield item, size, h, joined(data, start, end, k, size)

        schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])
        yield from emit(rows(), schema, lambda row: len(row[3]) + 64)

    read = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(tidy(cut), "item string, n int, hash long, words binary").distinct()


class Windows:
    """A worker's hash set of windows: bits by hash, then words and items by hash and words."""

    def __init__(self, table: bytes):
        rows = pa.ipc.open_stream(table).read_all()
        self.items: dict[tuple[int, bytes], list[str]] = {}
        by_size: dict[int, list[int]] = {}
        for h, n, key, item in zip(*(rows[c].to_pylist() for c in ("hash", "n", "words", "item")), strict=True):
            self.items.setdefault((h, key), []).append(item)
            by_size.setdefault(n, []).append(h)
        self.maps = {n: bit_map(np.array(hashes, np.int64).view(np.uint64)) for n, hashes in by_size.items()}


def bit_map(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A map with some 64 places for each hash, and how far to shift a hash for its place."""
    bits = max(10, (64 * len(hashes)).bit_length())
    held, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    held[hashes >> shift] = True
    return held, shift


def merged(at: np.ndarray, size: np.ndarray) -> list[dict[str, int]]:
    """Runs of words as maximal spans; runs that touch become one."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + size)[order])
    opens = np.flatnonzero(np.concatenate([[True], at[1:] > end[:-1]]))
    closes = np.append(opens[1:], len(at)) - 1
    return [{"start": a, "end": b} for a, b in zip(at[opens].tolist(), end[closes].tolist(), strict=True)]


SCANNED = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def scanned(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a column ``__quire_hits``: ``(n_words, spans, items)`` of each row.

    Spans are word numbers, ends exclusive, in order and apart; items are the ids, as strings in order, whose windows occur.
    """
    windows = stored(benchmark_windows(benchmark, window, item_col, item_text_col))
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 16)).first()[0] or 0
    return _by_set(df, windows, text_col) if size <= broadcast_bytes else _by_join(df, windows, text_col)


def _by_set(df: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    import io

    out, found = io.BytesIO(), windows.toArrow()
    with pa.ipc.new_stream(out, found.schema) as stream:
        stream.write_table(found)
    shared = df.sparkSession.sparkContext.broadcast(out.getvalue())
    kept = [c for c in df.columns if c != text_col]
    schema = pa.schema([("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.get(hash(shared.value))
        if known is None:
            _known.clear()
            known = _known[hash(shared.value)] = Windows(shared.value)
        for batch in batches:
            for slab in slabs(batch, 0):
                data, hashes, start, end, before = slab_words(slab.column(0))
                hits: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for size, (held, shift) in known.maps.items():
                    at, h = window_hashes(hashes, before, size)
                    likely = np.flatnonzero(held[h >> shift])
                    at, h = at[likely], h[likely].view(np.int64)
                    for k, value, doc in zip(at.tolist(), h.tolist(), (np.searchsorted(before, at, "right") - 1).tolist(), strict=True):
                        found = known.items.get((value, joined(data, start, end, k, size)))
                        if found:  # the same words, not the same hash alone
                            hits.setdefault(doc, []).append((k - int(before[doc]), size))
                            items.setdefault(doc, set()).update(found)
                spans = [merged(*np.array(hits[i]).T) if i in hits else [] for i in range(slab.num_rows)]
                columns = [pa.array(np.diff(before)), pa.array(spans, schema.field("spans").type), pa.array([sorted(items.get(i, ())) for i in range(slab.num_rows)], schema.field("items").type)]
                yield pa.RecordBatch.from_arrays([*slab.columns[1:], slab.column(0), *columns], names=names)

    names = [f"c{i}" for i in range(len(kept))] + ["text", "n_words", "spans", "items"]
    given = df.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    kinds = ", ".join([*[f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)], "text string", SCANNED])
    made = given.mapInArrow(tidy(scan, forget), kinds)
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(kept)} | {text_col: F.col("text").alias(text_col)}
    return made.select(*[back[c] for c in df.columns], F.struct("n_words", "spans", "items").alias("__quire_hits"))


def _by_join(df: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """For benchmarks of any size: a bit map of fixed size, a join on the words, and one exchange of the rows with hits."""
    spark = df.sparkSession
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bits = windows.groupBy("n", F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    maps = {}
    for n in set(bits["n"].to_pylist()):
        own = bits.filter(pc.equal(bits["n"], n))
        maps[n] = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        maps[n][own["word"].to_numpy()] = own["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(maps)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for slab in slabs(batch, 1):
                    data, hashes, start, end, before = slab_words(slab.column(1))
                    keys = slab.column(0).to_pylist()
                    for size, held in shared.value.items():
                        at, h = window_hashes(hashes, before, size)
                        spot = h >> np.uint64(64 - MAP_BITS)
                        some = np.flatnonzero(held[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1))
                        for k in at[some].tolist():
                            doc = int(np.searchsorted(before, k, "right")) - 1
                            yield keys[doc], k - int(before[doc]), size, joined(data, start, end, k, size)

        schema = pa.schema([("key", pa.string()), ("at", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])
        yield from emit(rows(), schema, lambda row: len(row[3]) + 96)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, 0):
                yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(np.diff(slab_words(slab.column(0))[-1]))], names=["text", "n_words"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, at, sizes, items in records(batches):
                yield key, merged(np.array(at), np.array(sizes)), sorted(items)

        schema = pa.schema([("key", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
        yield from emit(rows(), schema, lambda row: 64 * len(row[1]) + 64)

    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(body, 256)  # what is found depends on the text alone, so that equal texts are looked up once
    texts = df.select(digest.alias("key"), body.alias("text"))
    candidates = texts.mapInArrow(tidy(likely), "key string, at long, n int, words binary").distinct()
    hits = candidates.join(windows.select("words", "n", "item"), ["words", "n"])
    by_text = hits.groupBy("key", "at", "n").agg(F.collect_set("item").alias("items")).groupBy("key").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    spans = by_text.mapInArrow(tidy(gathered), "key string, spans array<struct<start:long,end:long>>, items array<string>")
    word = rf"[^{BETWEEN}]+"
    lowered = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = spans.select(F.col("key").alias("__quire_key"), F.col("spans").alias("__quire_spans"), F.col("items").alias("__quire_items"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    out = df.withColumn("__quire_digest", digest).join(found, F.col("__quire_digest") == F.col("__quire_key"), "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    hit = F.struct(F.regexp_count(lowered, F.lit(word)).cast("long").alias("n_words"), F.coalesce("__quire_spans", none).alias("spans"), F.coalesce("__quire_items", F.array().cast("array<string>")).alias("items"))
    return out.select(*kept, hit.alias("__quire_hits"))


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])


def without_documents(df: DataFrame, benchmark: DataFrame, most: float = 0.0, text_col: str = "text", **options) -> DataFrame:
    """The rows of which no more than the share ``most`` of the words is hit, with their own columns."""
    hits = F.col("__quire_hits")
    found = scanned(df, benchmark, text_col=text_col, **options)
    return found.where(n_hit(hits["spans"]) <= F.lit(most) * hits["n_words"]).select(*[F.col(f"`{c}`") for c in df.columns])


def without_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows with their own columns; hit words, and what stands between them in a span, are cut out of the text."""
    columns = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if spans:
                    data = _lower[np.frombuffer(text.encode(), np.uint8)]
                    _, start, end, _ = words(data, np.array([0, len(data)]))
                    raw, kept, at = text.encode(), [], 0
                    for span in spans:
                        kept.append(raw[at : start[span["start"]]])
                        at = int(end[span["end"] - 1])
                    text = (b"".join(kept) + raw[at:]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *names])

    rest = [c for c in columns if c != text_col]
    names = [f"c{i}" for i in range(len(rest))]
    given = scanned(df, benchmark, text_col=text_col, **options).select(F.col(f"`{text_col}`").alias("text"), F.col("__quire_hits.spans").alias("spans"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)])
    kinds = ", ".join(["text string", *[f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(rest, names, strict=True)]])
    made = given.mapInArrow(tidy(cut), kinds)
    back = {c: F.col(n).alias(c) for c, n in zip(rest, names, strict=True)} | {text_col: F.col("text").alias(text_col)}
    return made.select(*[back[c] for c in columns])


def hit_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items, from what :func:`scanned` adds."""
    hits = F.col("__quire_hits")
    number = n_hit(hits["spans"])
    return found.select(
        F.col(f"`{id_col}`").alias(id_col),
        hits["n_words"].alias("n_words"),
        number.alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hits["items"]), 256).alias("items_sha256"),
        (number > 0).alias("contaminated"),
    )


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract, window by window: for tests."""
    import hashlib

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda text: re.findall(rf"[^{BETWEEN}]+", (text or "").translate(lower))
    known: dict[tuple, set[str]] = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        w = split(text)
        hit, names = set(), set()
        for size in range(1, window + 1):
            for i in range(len(w) - size + 1):
                if found := known.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= found
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
