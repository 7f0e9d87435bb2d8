"""Token ids as ordered Parquet files: list columns, dictionary pages, page indexes.

Documents are dealt into ranges of ascending id, one file for each range, and a
file's rows are sorted by id. The ids are a ``list<int32>`` column with dictionary
encoding; small integers beside it (id, row, number of ids, ids before it in the
file) can be read without touching the ids. Row groups and pages have set sizes,
and the format's column and offset indexes let a reader skip to the pages it needs.

White space separates tokens in the vocabulary that is used here, so that a text's
ids are those of its chunks between blanks, one after the other; a chunk is encoded
by the tokenizers library once and then remembered, up to a bounded number of bytes. A
vocabulary that normalises or splits in any other way gets whole texts, through the library alone.

The strings of special tokens in a text are ordinary text, as the vocabularies' own
description sets them (``encode_special_tokens``); with ``literals`` they become the special ids,
which is the library's setting where none is made.

Edge cases. A null text is an empty one: its only id is the end id. Rows with equal
ids stand in order of their texts; a null id comes first. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RELEASED, cut_points, int_lists, offsets, pick, range_of, records, shared_folder, shuffle_partitions, tidy

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Characters of texts that are encoded together.
TOGETHER = 1 << 18
#: Bytes, about, of the chunks and ids that a worker remembers while tasks of this operator follow one another; at that many it starts anew. This bounds memory only.
MEMO = 160 << 20
#: Marks that no contraction begins with, and no special token.
MARKS = ",.!?;:*#&%$"
# How the vocabulary normalises and splits where chunks between blanks may be taken by themselves.
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTED = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_coders: dict[tuple, "Chunks"] = {}


class Chunks(dict):
    """Chunk of text without blanks -> its ids as little-endian 32-bit integers.

    A chunk that the normaliser leaves as it is, of letters alone, is one word to the vocabulary: the library's
    model takes it at once, its bytes written in the vocabulary's alphabet. Any other chunk goes through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, literals: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not literals
        self.model = self.tokenizer.model
        described = json.loads(vocabulary)
        steps = [(described.get(name) or {}).get(parts) for name, parts in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        added = [token["content"] for token in described.get("added_tokens", [])]
        plain_tokens = all(token["special"] and not token["lstrip"] and not token["rstrip"] and not token["single_word"] for token in described.get("added_tokens", []))
        self.parts = steps == [NORMALISED, PARTED] and plain_tokens and not any(x[-1:].isalpha() or " " in x or x.isalpha() or x[0] in MARKS for x in added)
        self.literal = "<" if literals else None
        self.held = 0

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if len(word) < len(chunk) and settled(word):  # marks behind letters are a token sequence of their own
            ids = self[word] + self[chunk[len(word) :]]
            return self.keep(chunk, ids)
        if settled(chunk):
            word = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(ALPHABET)
            ids = array("i", [token.id for token in self.model.tokenize(word)]).tobytes()
        else:
            ids = array("i", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return self.keep(chunk, ids)

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if self.held > MEMO:
            self.forget()
        if len(chunk) <= 64:
            self[chunk] = ids
            self.held += 240 + len(chunk) + len(ids)  # two objects and their place in the table
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.parts:
            return [array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() for text in texts]
        ids = self.__getitem__
        return [b"".join(map(ids, (text if self.literal and self.literal in text else plain(text)).replace("\n", " ").split(" "))) for text in texts]


def forget() -> None:
    for own in _coders.values():
        own.forget()


RELEASED.append(forget)


def settled(word: str) -> bool:
    """Whether a word is letters alone, of alphabets that every version of the library knows, which it leaves as they are."""
    return word.isalpha() and max(word) < "\u0530" and word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word))


def in_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def plain(text: str) -> str:
    """Latin-1 texts in lower case, as the vocabulary has them; others are left to the library."""
    return text.lower() if in_latin_1(text) else text


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


ALPHABET = byte_alphabet()


def coder(vocabulary: str, literals: bool = False) -> Chunks:
    key = hash(vocabulary), literals
    if key not in _coders:
        _coders[key] = Chunks(vocabulary, literals)
    return _coders[key]


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, literals: bool = False) -> int:
    """Writes ``(doc_id, part, row, before, n_tokens, ids)`` files to ``path``; returns the number of ranges."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = cut_points(docs, "doc_id", parts or shuffle_partitions(spark))
    shared, end = spark.sparkContext.broadcast(vocabulary), array("i", [end_id]).tobytes()
    names = ["doc_id", "part", "row", "before", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, before, kept, held = coder(shared.value, literals), 0, 0, [], 0

        def batch():
            nonlocal row, before
            ids = [x + end for x in own.texts([text for _, _, text in kept])]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            columns = [pa.array([k for k, _, _ in kept], pa.int64()), pa.array([p for _, p, _ in kept], pa.int32()), pa.array(np.arange(row, row + len(kept))), pa.array(starts), pa.array(counts), int_lists(ids)]
            row, before = row + len(kept), before + int(counts.sum())
            return pa.RecordBatch.from_arrays(columns, names=names)

        for found in records(batches):
            kept.append(found)
            held += len(found[2]) + 64
            if held >= TOGETHER:
                yield batch()
                kept, held = [], 0
        if kept:
            yield batch()

    dealt = docs.select("doc_id", range_of(F.col("doc_id"), cuts).alias("part"), "text").repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("doc_id", "text")
    tokens = dealt.mapInArrow(tidy(run, forget), "doc_id long, part int, row long, before long, n_tokens long, ids array<int>")
    tokens.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(path)
    return len(cuts) + 1


def read_tokens(spark, path: str) -> DataFrame:
    schema = "doc_id long, part int, row long, before long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).parquet(path)


def checksums(tokens: DataFrame, parts: int) -> DataFrame:
    """Start, number and CRC-32 of each document's ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *plain, ids = batch.columns
            ends = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
            counts = [int(b - a) for a, b in zip(ends, ends[1:], strict=False)]
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(counts, type=pa.int64()), pa.array(crc, type=pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    starts = offsets(tokens, "part", F.sum("n_tokens"), parts)  # reads one small column
    read = tokens.select("doc_id", "part", "before", "ids").mapInArrow(tidy(run), "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return read.select("doc_id", (pick(starts, F.col("part")) + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_digests(df: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the token files below the shared folder and reads them back."""
    path = shared_folder(df.sparkSession)
    parts = write_tokens(df, path, vocabulary, end_id)
    return checksums(read_tokens(df.sparkSession, path), parts)
