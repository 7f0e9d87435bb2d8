"""Fill-in-middle: texts cut at two token borders and written with the middle last.

A token is a run of blanks with the word behind it, so that a border lies wherever a word's last
character stands before a blank: a predicate on two adjacent characters. All texts of a batch are cut into
chunks of ``CHUNK`` bytes that overlap by one, so that every pair of neighbours lies in one chunk, and no
chunk reaches into another document. Borders are counted in all chunks side by side; prefix sums over
the chunks of a document give its number of tokens, and route the two cut ranks to the chunks that
hold them. Only those chunks are scanned again, for the place of the border. Nothing is shuffled.

Blanks are ASCII, and no byte of a longer UTF-8 sequence is, so that bytes serve as characters;
code points are the bytes that continue no sequence.

Edge cases. A null text is an empty one: no token, form ``plain``, an empty output. A text without a word is one
token. Texts that hold a sentinel are ``plain``, since they could not be rebuilt. A null id has no digits
(``42:``). Equal ids have equal draws, and repeated rows equal outputs. Texts are taken whole, however long. An empty
table gives no rows. Columns besides the id and the text are not read, so that their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .wordhash import buffers, slabs

#: Bytes of a chunk.
CHUNK = 4096
#: What marks prefix, suffix and middle, and the draws: share of texts that are transformed, share of these with the suffix first, in percent.
SENTINELS = ("<P>", "<S>", "<M>")
RATE, SUFFIX_FIRST, SEED = 50, 80, "42"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def chunked(borders: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of documents begin, whose bytes begin and end at ``borders``; and chunks before each document."""
    number = -(-np.diff(borders) // chunk)
    before = np.concatenate([[0], np.cumsum(number)])
    own = np.arange(before[-1]) - np.repeat(before[:-1], number)
    return np.repeat(borders[:-1], number) + own * chunk, before


def counted(data: np.ndarray, borders: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token borders and code points up to each chunk. A border belongs to the chunk of the word's last byte.

    The predicate looks at a chunk and the first byte of the next; a document's last byte has no neighbour.
    """
    pair = np.zeros(len(data), bool)
    if len(data) > 1:
        np.logical_and(~_blank[data[:-1]], _blank[data[1:]], out=pair[:-1])
    ends = borders[1:]
    pair[ends[ends > borders[:-1]] - 1] = False
    lead = (data & 0xC0) != 0x80
    zero = np.zeros(1, np.int64)
    if not len(starts):
        return zero, zero
    return tuple(np.concatenate([zero, np.cumsum(np.add.reduceat(x, starts, dtype=np.int64))]) for x in (pair, lead))


def located(data: np.ndarray, end: int, start: int, rank: int) -> int:
    """The byte behind the chunk's border number ``rank`` (from 0), by a scan of this chunk and one byte more."""
    part = data[start : min(start + CHUNK + 1, end)]
    return start + 1 + int(np.flatnonzero(~_blank[part[:-1]] & _blank[part[1:]])[rank])


def draws(key: int | None, n: int, seed: str = SEED) -> tuple[int, int, int, int]:
    """The two cut ranks, in order, and two numbers from 0 to 99, from a digest of the id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b), h[2] % 100, h[3] % 100


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row."""
    marks = [m.encode() for m in SENTINELS]
    held = re.compile(b"|".join(map(re.escape, marks))).search
    names = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]

    def rewritten(slab: pa.RecordBatch) -> Iterator[tuple]:
        data, borders = buffers(slab.column(1))
        low = int(borders[0])
        data, borders = data[low : int(borders[-1])], borders - low
        starts, before = chunked(borders)
        pairs, points = counted(data, borders, starts)
        for i, key in enumerate(slab.column(0).to_pylist()):
            at, end, first, last = int(borders[i]), int(borders[i + 1]), int(before[i]), int(before[i + 1])
            text = data[at:end].tobytes()
            n = int(pairs[last] - pairs[first]) + (end > at)
            p, m, drawn, order = draws(key, n, seed)
            if not text or drawn >= rate or held(text):
                yield key, n, PLAIN, None, None, text
                continue

            def cut(rank: int) -> tuple[int, int]:
                """Bytes and code points before the rank's border."""
                if rank == 0 or rank == n:
                    return (at, 0) if rank == 0 else (end, int(points[last] - points[first]))
                own = first + int(np.searchsorted(pairs[first + 1 : last + 1] - pairs[first], rank))
                place = located(data, end, int(starts[own]), rank - int(pairs[own] - pairs[first]) - 1)
                inside = data[starts[own] : place]
                return place, int(points[own] - points[first] + np.count_nonzero((inside & 0xC0) != 0x80))

            (b, b_chars), (c, c_chars) = cut(p), cut(m)
            prefix, middle, suffix = text[: b - at], text[b - at : c - at], text[c - at :]
            if order < suffix_first:
                form, out = SPM, (marks[1], suffix, marks[0], prefix, marks[2], middle)
            else:
                form, out = PSM, (marks[0], prefix, marks[1], suffix, marks[2], middle)
            yield key, n, form, b_chars, c_chars - b_chars, b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, 1):
                keys, n, form, prefix, middle, out = zip(*rewritten(slab), strict=True)
                texts = pa.array(out, pa.binary() if sum(map(len, out)) < 1 << 31 else pa.large_binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), texts], names=names)

    kind = df.schema[id_col].dataType
    read = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = read.mapInArrow(tidy(run), "key long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.select(F.col("key").cast(kind).alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its sentinels alone."""
    p, s, m = SENTINELS
    middle = F.substring_index(output, m, -1)
    rest = F.substring_index(output, m, 1)
    psm = F.concat(F.substr(F.substring_index(rest, s, 1), F.lit(len(p) + 1)), middle, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), middle, F.substr(F.substring_index(rest, p, 1), F.lit(len(s) + 1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def form_digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, and SHA-256 digests of each output and of the text rebuilt from it."""
    rebuilt = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), rebuilt.alias("restored_sha256"))


def brute(key: int | None, text: str | None) -> tuple:
    """The contract by lists of tokens: for tests."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    p, m, drawn, order = draws(key, len(tokens))
    if not text or any(s in text for s in SENTINELS) or drawn >= RATE:
        return len(tokens), PLAIN, None, None, text
    prefix, middle, suffix = "".join(tokens[:p]), "".join(tokens[p:m]), "".join(tokens[m:])
    if order < SUFFIX_FIRST:
        return len(tokens), SPM, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), PSM, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"
