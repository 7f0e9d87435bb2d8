"""Removal of long passages that occurred before, by compaction of a sparse De Bruijn graph of words.

Nodes are word k-mers. Of the k-mers in a window of ``WINDOW`` words, the one with the
least hash (the leftmost, on a tie) is the window's anchor, so that equal windows
have equal anchors at equal places, and one k-mer in seven or so is a node. The edge
of an anchor is the run of words that all windows with that anchor cover: it reaches
from words before the node to words behind it. Edges of neighbouring anchors overlap by a window less a word,
and are linked.

1. Anchors are counted over all documents, by hash alone, with partial counts before
   the shuffle. Those that occur twice go into a bit map of fixed size.
2. Edges whose anchor is in the bit map are the candidates. Equal edges meet in one row (partial
   aggregates, so that thousands of copies cost one row for each task): their number, their first source
   coordinate, and the least and greatest of the edges that stand before and after them. These give the
   in-degree and the out-degree as far as it matters, one or more.
3. Two repeated edges lie on a nonbranching path if the one has no other edge after it, and the other none
   before it, in any document. Paths are compacted by pointer doubling: each join doubles the
   stretch that an edge looks back, so that a path of n edges takes log n joins. No path is a cycle:
   a document's first edge of it would have no edge of it before.
4. A path is found in a document by its two ends, whose source coordinates have to lie apart by the path's
   length; all but the first such place are copies of the whole path, whatever its length.
5. Where edges branch at a node, the windows of each distinct edge are compared by themselves, and those whose
   first source coordinate lies elsewhere occurred before.
6. The covered runs of a document are compacted into maximal spans and taken out.

Candidates are hashed anew from the text in each step rather than kept: that costs some
seconds and saves the disk that the hashes of every window would take. The bit maps only
spare work: as they fill up (from some 10^8 repeated anchors on), more candidates come through, and the result stays the
same. Edges and windows are told apart by 128 bits, from two polynomials; nodes by 64, since a node only gathers candidates.

Edge cases. A null text has no words. Documents of less than ``WINDOW`` words are kept
whole. A repeated row (equal id and text) is the same document; rows with equal ids and
other texts stand in order of a hash of the text; a null id comes first. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, emit, records, stored, tidy
from .wordhash import buffers, run, runs, signed, slabs, words

WINDOW, NODE = 20, 8
#: The bit map has 2**BITS bits.
BITS = 27
_base = 0xA0761D6478BD642F | 1
_other = 0xE7037ED1A0B428DB | 1
#: Rows of a checked size up to which a table is broadcast (50 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 500_000
#: Doublings: paths are shorter than 2**DOUBLINGS edges.
DOUBLINGS = 48
LOWEST = -(1 << 63)


def edges(hashes: np.ndarray, before: np.ndarray, window: int = WINDOW, node: int = NODE):
    """Anchors of documents of words: document, first and last window, hash of the node and of the edge; and all windows' hashes."""
    sums = runs(hashes, _base)
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), sums
    at = np.arange(n - node + 1)
    nodes = run(sums, _base, at, at + node, 21)
    places = np.arange(n - window + 1)
    last = np.repeat(before[1:], np.diff(before))  # the end of each word's document
    places = places[places + window <= last[places]]
    if not len(places):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), sums
    reach = window - node + 1
    view = np.lib.stride_tricks.sliding_window_view(nodes, reach)
    anchor = places + np.concatenate([view[places[i : i + (1 << 17)]].argmin(1) for i in range(0, len(places), 1 << 17)])
    document = np.searchsorted(before, places, "right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(places)) - 1
    low, high = places[first], places[final]
    return document[first], low, high, nodes[anchor[first]], run(sums, _base, low, high + window, 22), sums


def bit_map(repeated: DataFrame, hash_col: str) -> np.ndarray:
    """The repeated hashes as 2**BITS bits; what comes to the driver is bounded by the map's size."""
    word = F.shiftrightunsigned(F.col(hash_col), 64 - BITS + 6)
    bit = F.shiftrightunsigned(F.col(hash_col), 64 - BITS).bitwiseAND(F.lit(63)).cast("int")
    found = repeated.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def share_map(spark: SparkSession, repeated: DataFrame, hash_col: str):
    return spark.sparkContext.broadcast(bit_map(repeated, hash_col))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, hash, text)``: an id that is never null, a hash of the text, and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def place_hash(doc, text_hash, low):
    """Spreads coordinates over a bit map; the same on numpy arrays and in :func:`place_column`."""
    return (low.astype(np.uint64) << np.uint64(44)) ^ text_hash.astype(np.int64).view(np.uint64) ^ doc.astype(np.int64).view(np.uint64)


def place_column() -> Column:
    return F.shiftleft(F.col("low").cast("long"), 44).bitwiseXOR(F.col("text_hash")).bitwiseXOR(F.col("doc"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, node: int = NODE) -> DataFrame:
    """``(doc, text_hash, spans array<struct<start, end>>)``: maximal runs of words that windows which occurred before cover."""
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, 0):
                h, before = words(*buffers(slab.column(0)))
                found, number = np.unique(edges(h, before, window, node)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.minimum(number, 2).astype(np.int64))], names=["anchor", "n"])

    counted = docs.select("text").mapInArrow(tidy(anchors), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    shared = share_map(spark, counted, "anchor")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for slab in slabs(batch, 2):
                h, before = words(*buffers(slab.column(2)))
                document, low, high, anchor, edge, _ = edges(h, before, window, node)
                number = np.flatnonzero(in_map(bits, anchor))
                document, low, high, anchor, edge = document[number], low[number], high[number], anchor[number], edge[number]
                prior, after = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
                beside = np.flatnonzero((np.diff(number) == 1) & (np.diff(document) == 0))
                after[beside], prior[beside + 1] = edge[beside + 1], edge[beside]
                other = run(runs(h, _other), _other, low, high + window, 24)
                at, own = pa.array(document), before[document]
                columns = [slab.column(0).take(at), slab.column(1).take(at), pa.array((low - own).astype(np.int32)), pa.array((high - own).astype(np.int32)), *(pa.array(signed(x)) for x in (anchor, edge, other, prior, after))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "low", "high", "anchor", "edge", "other", "prior", "after"])

    found = docs.select("doc", "text_hash", "text").mapInArrow(tidy(candidates), "doc long, text_hash long, low int, high int, anchor long, edge long, other long, prior long, after long")
    degrees = [f("prior").alias(n) for f, n in ((F.min, "prior"), (F.max, "priors"))] + [f("after").alias(n) for f, n in ((F.min, "after"), (F.max, "afters"))]
    distinct = stored(found.groupBy("edge", "other").agg(F.min(F.struct("doc", "text_hash", "low", "high", "anchor")).alias("first"), F.count("*").alias("n"), *degrees).select("edge", "other", "first.*", "n", "prior", "priors", "after", "afters"))
    ends = paths(distinct.where("n > 1"), window)
    if ends.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    placed = found.select("edge", "other", "doc", "text_hash", "low").join(ends, ["edge", "other"]).withColumn("low", F.col("low") - F.col("shift"))
    whole = placed.groupBy("doc", "text_hash", "low", "path", "words", "first").agg(F.bit_or("end").alias("end")).where("end = 3")
    copies = whole.where(F.struct("doc", "text_hash", "low") != F.col("first")).select("doc", "text_hash", F.col("low").alias("start"), (F.col("low") + F.col("words")).alias("end"))
    branching = distinct.groupBy("anchor").agg(F.count("*").alias("edges")).where("edges > 1").select("anchor")
    branches = share_map(spark, distinct.join(branching, "anchor", "left_semi").select(place_column().alias("place")), "place")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bits = shared.value, branches.value
        for batch in batches:
            for slab in slabs(batch, 2):
                h, before = words(*buffers(slab.column(2)))
                document, low, high, anchor, _, sums = edges(h, before, window, node)
                doc, text_hash = slab.column(0).to_numpy(), slab.column(1).to_numpy()
                kept = in_map(first, anchor) & in_map(bits, place_hash(doc[document], text_hash[document], low - before[document]))
                document, low, high = document[kept], low[kept], high[kept]
                size = high - low + 1
                start = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                document = np.repeat(document, size)
                names = [pa.array(signed(run(x, base, start, start + window, seed))) for x, base, seed in ((sums, _base, 23), (runs(h, _other), _other, 25))]
                yield pa.RecordBatch.from_arrays([pa.array(doc[document]), pa.array(text_hash[document]), pa.array((start - before[document]).astype(np.int32)), *names], names=["doc", "text_hash", "start", "window", "other"])

    each = docs.select("doc", "text_hash", "text").mapInArrow(tidy(windows), "doc long, text_hash long, start int, window long, other long")
    here = F.struct("doc", "text_hash", "start")
    # copies of an edge are out by now: a window's group has a row for each distinct edge around it, counted in parts
    earliest = stored(each.groupBy("window", "other").agg(F.min(here).alias("at"), F.count("*").alias("n")).where("n > 1").select("window", "other", "at"))
    if earliest.count() <= BROADCAST_ROWS:
        earliest = F.broadcast(earliest)
    shown = each.join(earliest, ["window", "other"]).where(here != F.col("at")).select("doc", "text_hash", "start", (F.col("start") + window).alias("end"))
    return spans(copies.unionByName(shown))


def paths(repeated: DataFrame, window: int = WINDOW) -> DataFrame:
    """The two ends of each nonbranching path: ``(edge, other, path, shift, words, end, first)``.

    ``shift`` is how many words after the path's beginning the end's own first word stands, ``words`` the path's
    length, ``first`` its first source coordinate; ``end`` is 1 for the edge that begins it, 2 for the last one, 3 for both in one.
    """
    size = (F.col("high") - F.col("low") + 1).alias("size")
    nodes = stored(repeated.select("edge", "other", "doc", "text_hash", "low", size, "prior", "priors", "after", "afters"))
    left = nodes.where("after = afters and after != 0").select(F.col("edge").alias("l_edge"), F.col("after").alias("l_after"), F.col("size").alias("l_size"))
    linked = nodes.where("prior = priors and prior != 0").join(left, (F.col("prior") == F.col("l_edge")) & (F.col("edge") == F.col("l_after"))).select("edge", F.col("l_edge").alias("to"), F.col("l_size").alias("shift"))
    back = stored(nodes.select("edge", "size").join(linked, "edge", "left").select("edge", "size", F.coalesce("to", "edge").alias("to"), F.coalesce("shift", F.lit(0)).cast("long").alias("shift")))
    for _ in range(DOUBLINGS):
        further = back.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("shift").alias("more"))
        moved = stored(back.join(further, "to").select("edge", "size", F.col("next").alias("to"), (F.col("shift") + F.col("more")).alias("shift"), (F.col("more") > 0).alias("moved")))
        back = moved.drop("moved")
        if not moved.where("moved").take(1):
            break
    lengths = back.groupBy("to").agg(F.max(F.struct("shift", "size", "edge")).alias("last")).select(F.col("to").alias("path"), "last.*")
    known = nodes.select("edge", "other", F.struct("doc", "text_hash", "low").alias("first"))
    whole = lengths.select("path", F.col("edge").alias("last"), "shift", (F.col("shift") + F.col("size") - 1 + window).cast("int").alias("words"))
    begun = whole.join(known.withColumnRenamed("edge", "path"), "path")
    first = begun.select(F.col("path").alias("edge"), "other", "path", F.lit(0).alias("shift"), "words", F.when(F.col("last") == F.col("path"), 3).otherwise(1).alias("end"), "first")
    final = begun.where("last != path").select("path", "last", F.col("shift").cast("int").alias("shift"), "words", "first").join(known.select(F.col("edge").alias("last"), "other"), "last")
    return stored(first.unionByName(final.select(F.col("last").alias("edge"), "other", "path", "shift", "words", F.lit(2).alias("end"), "first")))


def spans(covered: DataFrame) -> DataFrame:
    """Overlapping and adjoining runs of a document as maximal spans; a document's runs are bounded by its words."""
    own = Window.partitionBy("doc", "text_hash").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = covered.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("span", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy("doc", "text_hash", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, node: int = NODE) -> DataFrame:
    """``(id, n_words, n_removed, kept)``: every row's words that no window which occurred before covers, joined by blanks."""
    found = repeated_spans(df, id_col, text_col, window, node)
    docs = keyed(df, id_col, text_col)
    split = re.compile(WORD).findall
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, text, cut in records(batches):
                found = split(text)
                kept, at, gone = [], 0, 0
                for span in cut or ():
                    kept += found[at : span["start"]]
                    at = span["end"]
                    gone += span["end"] - span["start"]
                kept += found[at:]
                yield None if doc == LOWEST else doc, len(found), gone, " ".join(kept)

        yield from emit(rows(), schema, lambda row: len(row[3]) + 64)

    joined = docs.join(found, ["doc", "text_hash"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(tidy(remove), "doc long, n_words long, n_removed long, kept string").withColumnRenamed("doc", id_col)


def removal_digests(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The contract, window by window: for tests, with distinct ids."""
    split, seen, out = re.compile(WORD).findall, set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        found = split(text or "")
        gone = [False] * len(found)
        for i in range(len(found) - window + 1):
            w = tuple(found[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(found, gone, strict=True) if not g)
        out.append((key, len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out

