"""Alignment of two tokenizers' ids over whole texts, by segments that are tokenised once.

A text (behind the blank that one vocabulary adds) is split before runs of white space, where neither vocabulary can
merge across: a run that begins with ``c`` may be split off only if no token of either vocabulary holds ``c`` behind
anything but white space (:func:`split_bytes`). A text's ids are then those of its segments, one after the other, and
since both tokenizers' tokens end there, groups and links stay within segments as well.

1. Segments are counted, in each task before the shuffle. Every distinct one is tokenised by both libraries and
   aligned, once, into a short record: both id lists, and how many tokens of each lie in every group.
2. The most frequent segments (``FREQUENT`` at most, of ``SHORT`` bytes at most: a bound that doesn't depend on the data) are
   broadcast with their records. All others are joined back by a shuffle, a row for each document that
   holds them; a hot segment is never among these, since as many others occur at least as often.
3. Documents meet their own rows in one exchange by a hash of id and text, and are composed from records alone. Two
   tokens of a group are linked if their byte ranges overlap, which follows from the token lengths of the vocabularies.
4. The documents that hold an id pair are counted in partial sums by task. The most frequent pairs (``PAIRS`` at most)
   are broadcast with their counts; others, if there are any, are joined by a shuffle.

Byte positions are never needed beyond a segment; all steps over tokens are array operations over a slab of texts.

Edge cases. A null or empty text has no tokens, nor has one that a vocabulary doesn't give back byte by byte (U+2581 is read
as a blank): zeros, and an empty string of groups. Rows stand for themselves, also when they
repeat another (each counts as a document that holds its pairs) or have no id. Texts and segments are taken whole, however long.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RELEASED, stored, tidy
from .tokenfiles import byte_alphabet
from .wordhash import buffers

#: Segments that are broadcast, and bytes of one at most; id pairs that are broadcast.
FREQUENT, SHORT, PAIRS = 1 << 18, 32, 1 << 21
#: Bytes of text that segments are counted over in a worker, and that documents are composed over.
COUNTED, COMPOSED = 16 << 20, 1 << 20
#: Records that are unpacked at a time.
PART = 1 << 14
#: Steps of a doubling by which counts are binned to find the least one that is broadcast.
STEPS = 8
BLANKS = b" \t\n\v\f\r"
# The UTF-8 forms of white space outside ASCII, and of others that some libraries take for it.
WIDE_BLANKS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", *(bytes([0xE2, 0x80, x]) for x in (*range(0x80, 0x8E), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe2\x81\xa0", b"\xe3\x80\x80", b"\xef\xbb\xbf"]
_blank = np.zeros(256, bool)
_blank[list(BLANKS) + [28, 29, 30, 31]] = True
_models: dict[int, "Pair"] = {}
_tables: dict[int, "Records"] = {}
_counts: dict[int, tuple] = {}


class Pair:
    """The two vocabularies: ids of segments, token bytes and their lengths."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = {chr(code): byte for byte, code in byte_alphabet().items()}
        special = {t["id"] for t in json.loads(a).get("added_tokens", [])}
        size = self.a.get_vocab_size()
        names = {i: self.a.id_to_token(i) or "" for i in range(size)}
        self.a_bytes = [b"" if i in special else bytes(letters[c] for c in names[i]) for i in range(size)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.blank_id = self.b.piece_to_id("▁")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.starts = split_bytes(self.a_bytes, self.b_bytes)
        self.start = np.zeros(256, bool)
        self.start[list(self.starts)] = True

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(name[3:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else name.replace("▁", " ").encode()

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids without the blank that the model puts in front: a segment's own first blank goes instead, or the added one's id."""
        out = self.b.encode([s[1:] if s[:1] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s[:1] != " ":
                out[i] = out[i][1:] if out[i][:1] == [self.blank_id] else []
            elif len(s) == 1:
                out[i] = [self.blank_id]
        return out

    def records(self, segments: list[str]) -> pa.Array:
        """Each segment's record (:class:`Records`), or nothing where a vocabulary doesn't give its bytes back."""
        ids_a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        ids_b = self.encode_b(segments)
        data = [s.encode() for s in segments]
        ok = np.ones(len(segments), bool)
        size = np.array(list(map(len, data)), np.int64)
        if not (self.covers(ids_a, self.a_bytes, self.a_size, data, size) and self.covers(ids_b, self.b_bytes, self.b_size, data, size)):
            for i, (text, a, b) in enumerate(zip(data, ids_a, ids_b, strict=True)):
                if not b"".join(map(self.a_bytes.__getitem__, a)) == text == b"".join(map(self.b_bytes.__getitem__, b)):
                    ok[i] = False
                    ids_a[i], ids_b[i] = [], []
        at_a, at_b, flat_a, flat_b = flat(ids_a), flat(ids_b), chained(ids_a), chained(ids_b)
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        cut_a = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True))  # tokens that end where one of the others ends
        cut_b = np.flatnonzero(np.isin(end_b, end_a, assume_unique=True))
        n_g = np.bincount(np.searchsorted(at_a[1:], cut_a, "right"), minlength=len(segments))
        return packed(ok, np.diff(at_a), np.diff(at_b), n_g, flat_a, flat_b, np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1))

    @staticmethod
    def covers(ids: list[list[int]], tokens: list[bytes], sizes: np.ndarray, data: list[bytes], size: np.ndarray) -> bool:
        """Whether every segment's tokens are its bytes."""
        every = chained(ids)
        ends = np.concatenate([[0], np.cumsum(sizes[every])])[flat(ids)]
        return bool((np.diff(ends) == size).all()) and b"".join(map(tokens.__getitem__, every.tolist())) == b"".join(data)


def flat(lists: list[list]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)


def chained(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64)


def packed(ok: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n_g: np.ndarray, a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray) -> pa.Array:
    """Records: three lengths, both id lists, and the tokens of each group, as 16-bit numbers (32-bit ones behind an odd byte where one is larger)."""
    size = 3 + n_a + n_b + 2 * n_g
    at = np.cumsum(size) - size
    numbers = np.empty(int(size.sum()), np.int64)
    numbers[at], numbers[at + 1], numbers[at + 2] = n_a, n_b, n_g
    below = at + 3
    for values, count in ((a, n_a), (b, n_b), (g_a, n_g), (g_b, n_g)):
        numbers[spread(below, count)] = values
        below = below + count
    if len(numbers) and numbers.max() < 1 << 16:
        borders = (2 * np.append(at, len(numbers))).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(ok), [None, pa.py_buffer(borders), pa.py_buffer(numbers.astype("<u2"))])
        return made if ok.all() else pc.if_else(pa.array(ok), made, pa.scalar(None, pa.binary()))
    each = [numbers[x : x + n] for x, n in zip(at.tolist(), size.tolist(), strict=True)]
    return pa.array([None if not fine else x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\0" + x.astype("<u4").tobytes() for x, fine in zip(each, ok.tolist(), strict=True)], pa.binary())


def split_bytes(a: list[bytes], b: list[bytes]) -> bytes:
    """The ASCII blanks that no token of either vocabulary holds behind anything but white space: neither can merge across such a place.

    But for the space itself, the second one holds none of them behind a space either, so that the blank it adds can be taken off again.
    """
    inner = set()
    for tokens, added in ((a, ()), (b, (32,))):
        for token in tokens:
            for i in range(1, len(token)):
                if (c := token[i]) in BLANKS and c not in inner:
                    x, blank = token[i - 1], token[i - 1] in BLANKS or token[:i].endswith(tuple(WIDE_BLANKS))
                    if not blank or x in added and c != 32:
                        inner.add(c)
    return bytes(c for c in BLANKS if c not in inner)


def pair(a: str, b: bytes) -> Pair:
    key = hash((a, b))
    if key not in _models:
        _models.clear()
        _models[key] = Pair(a, b)
    return _models[key]


class Segments:
    """The segments of a column of texts: distinct ones, and by document the places of its own among these."""

    def __init__(self, column: pa.Array, start: np.ndarray):
        data, borders = buffers(column)
        low = int(borders[0]) if len(borders) else 0
        data, borders = data[low : int(borders[-1])], borders - low
        edge = np.zeros(len(data) + 1, bool)
        edge[borders] = True
        opens = np.zeros(len(data), bool)
        opens[1:] = start[data[1:]] & ~_blank[data[:-1]]
        opens &= ~edge[:-1]
        at = np.flatnonzero(opens)
        wide = at[data[at - 1] >= 0x80]
        for blank in WIDE_BLANKS:  # white space outside ASCII in front belongs to the run
            some = wide[wide >= len(blank)]
            same = np.all([data[some - len(blank) + k] == x for k, x in enumerate(blank)], axis=0)
            opens[some[same]] = False
        filled = borders[:-1][np.diff(borders) > 0]
        opens[filled] = True
        starts = np.flatnonzero(opens)
        self.before = np.searchsorted(starts, borders)
        ends = np.append(starts, len(data)).astype(np.int32)
        array = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        self.coded = array.dictionary_encode()

    @property
    def distinct(self) -> pa.Array:
        return self.coded.dictionary

    @property
    def places(self) -> np.ndarray:
        return self.coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))


def own_places(document: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct segments of each document, in order of their first place: document and segment."""
    _, first = np.unique(document * size + places, return_index=True)
    first.sort()
    return document[first], places[first]


class Records:
    """Records of segments as flat arrays: numbers of ids and groups, links, and the groups' text."""

    def __init__(self, packed_records: pa.Array, model: Pair):
        parts = [self.part(packed_records.slice(at, PART).to_pylist(), model) for at in range(0, len(packed_records), PART)] or [self.part([], model)]
        self.ok, self.n_a, self.n_b, self.n_g, self.n_l, self.pairs = (np.concatenate([p[i] for p in parts]) for i in range(6))
        self.names = pa.concat_arrays([p[6] for p in parts])
        self.at_l = np.cumsum(self.n_l) - self.n_l

    @staticmethod
    def part(records: list[bytes | None], model: Pair) -> tuple:
        ok = np.array([r is not None for r in records], bool)
        numbers = [np.zeros(3, np.int64) if r is None else np.frombuffer(r[1:], "<u4") if len(r) % 2 else None for r in records]
        if any(x is not None for x in numbers):
            numbers = [np.frombuffer(r, "<u2") if x is None else x for x, r in zip(numbers, records, strict=True)]
            size, data = np.array([len(x) for x in numbers], np.int64), np.concatenate(numbers).astype(np.int64)
        else:
            size, data = np.array([len(r) // 2 for r in records], np.int64), np.frombuffer(b"".join(records), "<u2").astype(np.int64)
        at = np.cumsum(size) - size
        n_a, n_b, n_g = (data[at + k] for k in range(3))
        a, b = data[spread(at + 3, n_a)], data[spread(at + 3 + n_a, n_b)]
        groups = at + 3 + n_a + n_b
        names = named(a, b, data[spread(groups, n_g)], data[spread(groups + n_g, n_g)], n_g)
        return ok, n_a, n_b, n_g, n_a + n_b - n_g, linked(a, b, model), pa.array(names, pa.string())


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``at`` to ``at + size`` for all pairs of ``at`` and ``size``, one after the other."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def linked(a: np.ndarray, b: np.ndarray, model: Pair) -> np.ndarray:
    """Id pairs of tokens whose byte ranges overlap.

    Both sides cover the same bytes, so that each stretch between neighbouring borders of either side lies in one token of each:
    a segment has as many links as tokens on both sides, less its groups.
    """
    end_a, end_b = np.cumsum(model.a_size[a]), np.cumsum(model.b_size[b])
    ends = np.union1d(end_a, end_b)
    return a[np.searchsorted(end_a, ends)] * len(model.b_size) + b[np.searchsorted(end_b, ends)]


def named(a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, n_g: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for every segment."""
    texts = []
    text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    i = j = 0
    for x, y in zip(g_a.tolist(), g_b.tolist(), strict=True):
        texts.append(f"{','.join(text_a[i : i + x])}|{','.join(text_b[j : j + y])}")
        i += x
        j += y
    ends = np.cumsum(n_g).tolist()
    return [";".join(texts[p:q]) for p, q in zip([0, *ends], ends, strict=False)]


def forget() -> None:
    _models.clear()
    _tables.clear()
    _counts.clear()


RELEASED.append(forget)
MADE = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def aligned(df: DataFrame, a: str, b: bytes, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``(id, key, n_a, n_b, n_groups, n_links, groups, pairs, times)`` of every row.

    ``groups`` is the alignment as ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct linked id pairs in ascending order, as the first id times the second
    vocabulary's size plus the second id, ``times`` how often each is linked.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((a, b))
    text = F.col(text_col)
    body = F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))
    docs = df.select(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).alias("key"), F.col(id_col).cast("long").alias("id"), body.alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = pair(*shared.value).start
        for column in gathered(batches, 0, COUNTED):
            found = Segments(column[0], start)
            yield from small(pa.RecordBatch.from_arrays([found.distinct, pa.array(np.bincount(found.places, minlength=len(found.distinct)))], names=["segment", "n"]))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pair(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, model.records(part.column(0).to_pylist())], names=["segment", "n", "record"])

    distinct = docs.select("body").mapInArrow(tidy(count, forget), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    segments = stored(distinct.mapInArrow(tidy(align, forget), "segment string, n long, record binary"))
    least = threshold(segments.where(F.octet_length("segment") <= SHORT), frequent)
    common = (F.col("n") >= least) & (F.octet_length("segment") <= SHORT)
    known = spark.sparkContext.broadcast(as_bytes(segments.where(common).select("segment", "record").toArrow()))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held = pair(*shared.value).start, table(known.value)[0]
        for key, column in gathered(batches, 1, COMPOSED):
            found = Segments(column, start)
            out = np.array(pc.is_null(pc.index_in(found.distinct, held)), bool)
            places, document = found.places, found.document
            some = out[places]
            document, places = own_places(document[some], places[some], len(out))
            place = np.arange(len(document)) - np.searchsorted(document, document)
            yield from small(pa.RecordBatch.from_arrays([key.take(pa.array(document)), found.distinct.take(pa.array(places)), pa.array(place.astype(np.int32))], names=["key", "segment", "place"]))

    wanted = docs.select("key", "body").mapInArrow(tidy(rare, forget), "key long, segment string, place int")
    placed = stored(wanted.join(segments.where(~common).select("segment", "record"), "segment").select("key", "place", "record"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pair(*shared.value)
        held, frequent_records = table(known.value, model)
        for rows in with_own_rows(batches):
            yield composed(*rows, model, held, frequent_records)

    none = F.lit(None)
    both = docs.select("key", F.lit(-1).alias("place"), "id", "body", none.cast("binary").alias("record")).unionByName(placed.select("key", "place", none.cast("long").alias("id"), none.cast("string").alias("body"), "record"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = both.repartition(parts, "key").sortWithinPartitions("key", "place")
    kind = df.schema[id_col].dataType
    made = met.mapInArrow(tidy(compose, forget), f"key long, id long, {MADE}")
    return made.select(F.col("id").cast(kind).alias(id_col), "key", *[name.split()[0] for name in MADE.split(", ")])


def gathered(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[list[pa.Array]]:
    """Columns over about ``size`` bytes of text, across and within batches."""
    kept, held = [], 0

    def out():
        return [pa.concat_arrays([b.column(i) for b in kept]) for i in range(kept[0].num_columns)]

    for batch in batches:
        _, borders = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + size - held, "right")) - 1)
            kept.append(batch.slice(at, to - at))
            held += int(borders[to] - borders[at])
            at = to
            if held >= size or at < batch.num_rows:
                yield out()
                kept, held = [], 0
    if kept:
        yield out()


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 1 << 16):
        yield batch.slice(at, 1 << 16)


def threshold(counted: DataFrame, most: int) -> int:
    """The least ``n`` from which on no more than ``most`` rows follow, by the binned counts: a bounded number of bins comes to the driver."""
    bins = counted.groupBy(F.floor(F.log2("n") * STEPS).alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    found = 1 << 62
    for _, rows, least in bins:
        most -= rows
        if most < 0:
            break
        found = least
    return found


def as_bytes(found: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(found)
    return sink.getvalue().to_pybytes()


def table(data: bytes, model: Pair | None = None) -> tuple[pa.Array, Records | None]:
    """The broadcast segments, and their records where a model is given: once for each worker."""
    key = hash(data)
    if key not in _tables or (model is not None and _tables[key][1] is None):
        rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns]
        _tables.clear()
        _tables[key] = columns[0], Records(columns[1], model) if model is not None else None
    return _tables[key]


def with_own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents (id, key, body) of about ``COMPOSED`` bytes, and their joined rows (number of the key, place, record).

    Rows come in order of key, a key's documents before its rows.
    """
    names = ("key", "place", "id", "body", "record")
    kept, held = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = pa.table(batch.slice(at, 4096).columns, names=list(names))
            kept = part if kept is None else pa.concat_tables([kept, part])
            held += part["body"].nbytes
            if held >= COMPOSED:
                keys = kept["key"].to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key's rows may go on
                if whole:
                    yield split(kept.slice(0, whole))
                    kept = kept.slice(whole).combine_chunks()
                held = kept["body"].nbytes
    if kept is not None and kept.num_rows:
        yield split(kept)


def split(rows: pa.Table) -> tuple:
    own = pc.greater_equal(rows["place"], 0)
    docs, found = rows.filter(pc.invert(own)), rows.filter(own)
    body = docs["body"].combine_chunks()
    return docs["id"].combine_chunks(), docs["key"].to_numpy(), body if isinstance(body, pa.Array) else pa.concat_arrays(body.chunks), found["key"].to_numpy(), found["place"].to_numpy(), found["record"].combine_chunks()


def composed(ids: pa.Array, keys: np.ndarray, body: pa.Array, own_keys: np.ndarray, own_place: np.ndarray, own_records: pa.Array, model: Pair, held: pa.Array, common: Records) -> pa.RecordBatch:
    """The documents' alignments from the records of their segments."""
    found = Segments(body, model.start)
    index = pc.index_in(found.distinct, held)
    places, document = found.places, found.document
    known = pc.fill_null(index, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    record = known[places]
    if len(own_keys):
        first = np.ones(len(own_keys), bool)  # repeated rows bring theirs twice
        first[1:] = (own_keys[1:] != own_keys[:-1]) | (own_place[1:] != own_place[:-1])
        own_keys, kept = own_keys[first], pa.array(np.flatnonzero(first))
        rows = Records(own_records.take(kept), model)
        some = np.flatnonzero(record < 0)
        of, seg = own_places(document[some], places[some], len(known))
        place = np.arange(len(of)) - np.searchsorted(of, of)
        at = np.searchsorted(own_keys, keys[of]) + place
        order = of * len(known) + seg
        sorted_order = np.argsort(order)
        wanted = document[some] * len(known) + places[some]
        record[some] = len(common.ok) + at[sorted_order][np.searchsorted(order[sorted_order], wanted)]
        names = pa.concat_arrays([common.names, rows.names]) if len(rows.names) else common.names
        both = {name: np.concatenate([getattr(common, name), getattr(rows, name)]) for name in ("ok", "n_a", "n_b", "n_g", "n_l")}
    else:
        rows, names = None, common.names
        both = {name: getattr(common, name) for name in ("ok", "n_a", "n_b", "n_g", "n_l")}
    n = len(keys)
    ok = np.bincount(document[~both["ok"][record]], minlength=n) == 0
    use = ok[document]
    record, document = record[use], document[use]
    sums = {name: np.bincount(document, weights=both[name][record], minlength=n).astype(np.int64) for name in ("n_a", "n_b", "n_g", "n_l")}
    own = record >= len(common.ok)
    links, link_doc = [], []
    for source, mask, shift in ((common, ~own, 0), (rows, own, len(common.ok))):
        if source is not None:
            at = record[mask] - shift
            links.append(source.pairs[spread(source.at_l[at], source.n_l[at])])
            link_doc.append(np.repeat(document[mask], source.n_l[at]))
    pair_of, doc_of = np.concatenate(links), np.concatenate(link_doc)
    order = np.lexsort((pair_of, doc_of))
    pair_of, doc_of = pair_of[order], doc_of[order]
    new = np.ones(len(pair_of), bool)
    new[1:] = (pair_of[1:] != pair_of[:-1]) | (doc_of[1:] != doc_of[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(pair_of))).astype(np.int32)
    ends = pa.array(np.searchsorted(doc_of[first], np.arange(n + 1)).astype(np.int32))
    borders = pa.array(np.searchsorted(document, np.arange(n + 1)).astype(np.int32))
    groups = pc.binary_join(pa.ListArray.from_arrays(borders, names.take(pa.array(record))), ";")
    columns = [pa.array(keys), ids, *(pa.array(sums[name]) for name in ("n_a", "n_b", "n_g", "n_l")), groups, pa.ListArray.from_arrays(ends, pa.array(pair_of[first])), pa.ListArray.from_arrays(ends, pa.array(times))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])


def pair_counts(made: DataFrame, size_b: int) -> DataFrame:
    """``(pair, n, best)``: how many rows hold each linked id pair, and whether no other pair of its first id is held by more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            pairs, n = np.unique(np.concatenate(kept), return_counts=True)
            return small(pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"]))

        kept, held = [], 0
        for batch in batches:
            kept.append(batch.column(0).flatten().to_numpy())
            held += len(kept[-1])
            if held >= 1 << 22:
                yield from out()
                kept, held = [], 0
        if held:
            yield from out()

    counted = stored(made.select("pairs").mapInArrow(tidy(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.floor(F.col("pair") / size_b)
    highest = counted.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return stored(counted.withColumn("first", first).join(highest, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def rated(made: DataFrame, size_b: int, most: int = PAIRS) -> DataFrame:
    """``made``, a stored table of :func:`aligned` (or of columns derived from it), with ``n_best`` and ``count_sum`` over its links."""
    counts = pair_counts(made, size_b)
    least = threshold(counts, most)
    common = counts.where(F.col("n") >= least)
    shared = made.sparkSession.sparkContext.broadcast(as_bytes(common.toArrow()))
    names = [c for c in made.columns if c not in ("pairs", "times")]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _counts:
            _counts.clear()
            rows = pa.ipc.open_stream(shared.value).read_all()
            pair, n, best = (rows[c].to_numpy() for c in ("pair", "n", "best"))
            order = np.argsort(pair)
            _counts[key] = pair[order], n[order], best[order].astype(np.int64)
        pair, n, best = _counts[key]
        for batch in batches:
            *rest, pairs, times = batch.columns
            ends = pairs.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            wanted, number = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, wanted), max(0, len(pair) - 1))
            held = pair[at] == wanted if len(pair) else np.zeros(len(wanted), bool)
            score = [np.where(held, x[at] if len(x) else 0, 0) * number for x in (best, n)]
            totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in score]
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[~held]
            border = pa.array(np.searchsorted(doc, np.arange(len(ends))).astype(np.int32))
            left = [pa.ListArray.from_arrays(border, pa.array(x[~held])) for x in (wanted, number)]
            yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, totals), *left], names=[*names, "n_best", "count_sum", "left", "left_times"])

    kinds = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in names)
    scored = made.select(*names, "pairs", "times").mapInArrow(tidy(rate, forget), f"{kinds}, n_best long, count_sum long, left array<long>, left_times array<long>")
    others = counts.where(F.col("n") < least)
    if not others.take(1):
        return scored.drop("left", "left_times")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    open_pairs = scored.select("row", F.explode(F.arrays_zip("left", "left_times")).alias("link")).select("row", F.col("link.left").alias("pair"), F.col("link.left_times").alias("times"))
    sums = open_pairs.join(others, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    whole = scored.join(sums, "row", "left")
    return whole.select(*names, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))


def alignment_digests(df: DataFrame, a: str, b: bytes, size_b: int, id_col: str = "doc_id", **options) -> DataFrame:
    """Numbers of tokens, groups and links, the digest of the groups, and the links' counts over the corpus."""
    groups = F.when(F.length("groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    made = stored(aligned(df, a, b, id_col, **options).withColumn("groups", groups).withColumnRenamed("groups", "groups_sha256").drop("key"))
    return rated(made, size_b).select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
