"""Size-aware heavy-light join of documents by the Jaccard likeness of their shingles.

Sets link when 100 * |A and B| >= percent * |A or B|; a :class:`Contract` holds the words of
a shingle and ``percent``, 3 and 90 unless others are given, and all bounds that follow from
them. Equal sets are one class from the start; everything below is about classes, so that
copies cost nothing more.

Light sets (at most ``boundary`` shingles) are joined by enumerated subsets of fixed
size: the set itself and, where a linked set can lack one of its shingles, its subsets with
one shingle less. Two linked sets share one of them as long as neither can lack two. The
boundary is the cheaper of the last size that can lack none and the last that can lack one
(9 and 19 at 90 percent) for the sizes at hand.

Heavy sets are joined over inverted lists. Hash ranges cut a set into p segments, the
same for all sets of a size range; a segment's hash is a token. Sets that differ in d
shingles differ in at most d segments, and d <= n * (100 - percent) / percent, so that linked
sets share p - d tokens at least and meet in the list of one of their d + 1 rarest. Tokens are
counted over all sets first; those of one set alone only shorten its prefix.

Lists aren't expanded into pairs. (1) Every member of a list is verified against its
centre, the member with the fewest tokens of its own. (2) Links are contracted into
components. (3) Only pairs of a list that still lie in different components, and whose
own tokens leave room for a link, are verified one by one. No link that could join two
components is left out, so that the components are those of all links.

Shingles, sets and classes are told apart by 64-bit hashes.

Edge cases. A null text, or one without words, has an empty set, links with nothing and
is its own component; fewer words than a shingle has are a set of one. Repeated rows are one class. A
null id joins its class, but is no component's smallest id unless all are null. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .debruijn import LOWEST, bit_map, in_map, keyed
from .fingerprints import mixed
from .wordhash import buffers, run, runs, signed, slabs, words

#: A set's parity has 2**PARITY bits.
PARITY = 10
_base = 0x8BB84B93962EACC9 | 1


@dataclass(frozen=True)
class Contract:
    """Words of a shingle and least likeness in percent (1 to 99), and what follows from them."""

    shingle: int = 3
    percent: int = 90

    def __post_init__(self):
        if self.shingle < 1 or not 1 <= self.percent <= 99:
            raise ValueError("a shingle has a word at least, and the least likeness is 1 to 99 percent")

    @property
    def boundaries(self) -> tuple[int, int]:
        """The largest sets of which a linked set can lack no shingle, and one at most."""
        return 99 // (100 - self.percent), 199 // (100 - self.percent)

    @cached_property
    def ranges(self) -> np.ndarray:
        """Lower bounds of the heavy size ranges, from the least set that links with a heavy one: each is about the root of 2 times the last."""
        out = [max(1, self.percent * (self.boundaries[0] + 1) // 100)]
        while out[-1] < 1 << 40:
            out.append(int(out[-1] * 2**0.5) + 1)
        return np.array(out)

    def range_of(self, n: int) -> int:
        return int(np.searchsorted(self.ranges, n, "right")) - 1

    def segments(self, size_range: int) -> int:
        """Twice the shingles in which linked sets of a size range can differ, and two."""
        return 2 * ((int(self.ranges[size_range + 1]) - 1) * (100 - self.percent) // self.percent) + 2

    def differ(self, n: Column) -> Column:
        """Shingles in which a set of ``n`` and one that it links with can differ."""
        return F.floor(n * (100 - self.percent) / self.percent).cast("int")

    def differ_of(self, both: Column) -> Column:
        """The same of two sets with ``both`` shingles in all."""
        return F.floor(both * (100 - self.percent) / (100 + self.percent))


#: The contract of op6's SQL, and the one of documents that count as near copies elsewhere.
DIGEST, NEAR = Contract(3, 90), Contract(5, 80)


def sets(hashes: np.ndarray, before: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Each document's distinct shingles, ascending."""
    sums = runs(hashes, _base)
    out = []
    start = np.arange(max(0, len(hashes) - shingle + 1))
    grams = run(sums, _base, start, start + shingle, 31)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(run(sums, _base, np.array([a]), np.array([b]), 31))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mixed(own, 32).sum(dtype=np.uint64) + np.uint64(len(own)) * np.uint64(0x9E3779B97F4A7C15)
    return int(signed(mixed(np.array([total]), 33))[0])


def tokens(own: np.ndarray, boundary: int, contract: Contract = DIGEST) -> list[tuple[int, int, np.ndarray]]:
    """``(size range or -1 for light, number of segments, token hashes in order of segment)``."""
    n, out = len(own), []
    if not n:
        return out
    with np.errstate(over="ignore"):
        if n <= boundary:
            each = mixed(own, 34)
            whole = each.sum(dtype=np.uint64)
            keys = [mixed(np.array([whole + np.uint64(n)]), 35)]
            if n > contract.boundaries[0]:
                keys.append(mixed(whole - each + np.uint64(n - 1), 35))
            out.append((-1, 0, np.concatenate(keys)))
        if 100 * n >= contract.percent * (boundary + 1):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed(own, 36), dtype=np.uint64, out=sums[1:])
            for size_range in range(contract.range_of(n), contract.range_of(100 * n // contract.percent) + 1):
                p = contract.segments(size_range)
                low = np.array([-(-(j << 64) // p) for j in range(p)], np.uint64)
                at = np.append(np.searchsorted(own, low), n)
                number = np.arange(p, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size_range + 1)
                out.append((size_range, p, mixed(sums[at[1:]] - sums[at[:-1]] + mixed(number, 37), 38)))
    return out


def cheaper_boundary(sizes: DataFrame, contract: Contract = DIGEST) -> int:
    """Which of the two boundaries makes fewer list entries of the sets between them."""
    low, high = contract.boundaries
    found = {r.n: r.sets for r in sizes.where(F.col("n").between(low + 1, high)).groupBy("n").agg(F.count("*").alias("sets")).collect()}
    light = sum(k * (n + 1) for n, k in found.items())
    heavy = sum(k * contract.segments(contract.range_of(n)) * 2 for n, k in found.items())  # a segment of one or two shingles fits twice as often
    return high if light <= heavy else low


def each_set(batches: Iterator[pa.RecordBatch], text: int, contract: Contract):
    for batch in batches:
        for slab in slabs(batch, text):
            yield slab, sets(*words(*buffers(slab.column(text)), lower=True), contract.shingle)


def set_table(docs: DataFrame, contract: Contract = DIGEST) -> DataFrame:
    """``(doc, text_hash, n, class)`` of every row of ``keyed``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, own in each_set(batches, 2, contract):
            yield pa.RecordBatch.from_arrays([slab.column(0), slab.column(1), pa.array([len(s) for s in own], pa.int64()), pa.array([class_of(s) for s in own], pa.int64())], names=["doc", "text_hash", "n", "class"])

    return docs.select("doc", "text_hash", "text").mapInArrow(tidy(measure), "doc long, text_hash long, n long, class long")


def list_entries(docs: DataFrame, boundary: int, contract: Contract = DIGEST) -> DataFrame:
    """``(token, class, n, size_range, p, alone, taken)``: each set in the lists of its prefix."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in each_set(batches, 0, contract):
            found = [t for s in own for _, _, t in tokens(s, boundary, contract)]
            key, number = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(number)], names=["token", "n"])

    counted = stored(docs.select("text").mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("df")).where("df > 1"))
    shared = spark.sparkContext.broadcast(bit_map(counted, "token"))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, own in each_set(batches, 0, contract):
            rows: list[list[np.ndarray]] = []
            for s in own:
                for size_range, p, found in tokens(s, boundary, contract):
                    at = np.flatnonzero(in_map(bits, found))
                    if len(at):
                        rows.append([signed(found[at]), np.full(len(at), class_of(s)), np.full(len(at), len(s)), np.full(len(at), size_range), np.full(len(at), p), at])
            if rows:
                columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=["token", "class", "n", "size_range", "p", "segment"])

    entries = docs.select("text").mapInArrow(tidy(often), "token long, class long, n long, size_range int, p int, segment int").join(counted, "token")
    ranked = entries.groupBy("class", "n", "size_range", "p").agg(F.sort_array(F.collect_set(F.struct("df", "token", "segment"))).alias("shared"))  # at most p for each set
    alone = F.when(F.col("p") == 0, 0).otherwise(F.col("p") - F.size("shared"))
    room = contract.differ(F.col("n")) + 1 - alone
    prefix = F.when(F.col("p") == 0, F.col("shared")).when(room > 0, F.slice("shared", 1, F.greatest(room, F.lit(1))))
    # segments that other sets have too, as the bits of an array of longs: from the least on, a long at a time
    long = F.lit(0).cast("long")

    def zeros(n: Column) -> Column:
        return F.array_repeat(long, F.greatest(n, F.lit(0)))

    def bit(acc: Column, segment: Column) -> Column:
        at, one = F.call_function("div", segment, F.lit(64)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), segment % 64)
        same = F.struct(acc["at"].alias("at"), acc["bits"].bitwiseOR(one).alias("bits"), acc["out"].alias("out"))
        following = F.struct(at.alias("at"), one.alias("bits"), F.concat(acc["out"], F.array(acc["bits"]), zeros(at - acc["at"] - 1)).alias("out"))
        return F.when(at == acc["at"], same).otherwise(following)

    size = F.floor((F.col("p") + 63) / 64).cast("int")
    begun = F.struct(F.lit(0).alias("at"), long.alias("bits"), F.array().cast("array<bigint>").alias("out"))
    taken = F.when(size < 1, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.array_sort(F.transform("shared", lambda s: s["segment"])), begun, bit, lambda acc: F.concat(acc["out"], F.array(acc["bits"]), zeros(size - acc["at"] - 1))))
    named = ranked.select("class", "n", "size_range", "p", alone.alias("alone"), taken.alias("taken"), prefix.alias("prefix"))
    held = named.select("class", "n", "size_range", "p", "alone", "taken", F.explode("prefix").alias("entry"))  # apart: else every entry would make the bits anew
    return held.select(F.col("entry.token").alias("token"), "class", "n", "size_range", "p", "alone", "taken")


def verified(pairs: DataFrame, own: DataFrame, contract: Contract = DIGEST) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link; ``own`` has each class's shingles."""
    first = pairs.join(own.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
    both = first.join(own.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * same >= contract.percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def shingle_table(docs: DataFrame, wanted: DataFrame, contract: Contract = DIGEST) -> DataFrame:
    """``(class, shingles, parity)`` of the classes in ``wanted``.

    Bit k of ``parity`` is that of the number of shingles whose hash falls to it: two sets
    differ in at least as many shingles as their parities differ in bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "class"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, own in each_set(batches, 0, contract):
            named = {c: s for c, s in ((class_of(s), s) for s in own if len(s)) if in_map(bits, np.array([c]).view(np.uint64))[0]}
            if named:
                ends = np.cumsum([0, *map(len, named.values())]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(list(named.values())))))
                odd = [np.packbits((np.bincount((s >> np.uint64(64 - PARITY)).astype(np.int64), minlength=1 << PARITY) & 1).astype(np.uint8)).view(np.int64) for s in named.values()]
                words_each = (1 << PARITY) // 64
                parity = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * words_each), pa.array(np.concatenate(odd)))
                yield pa.RecordBatch.from_arrays([pa.array(list(named), pa.int64()), lists, parity], names=["class", "shingles", "parity"])

    found = docs.select("text").mapInArrow(tidy(pick), "class long, shingles array<long>, parity array<long>").join(wanted, "class", "left_semi")
    return stored(found.groupBy("class").agg(F.min(F.struct("shingles", "parity")).alias("s")).select("class", "s.*"))


def components(links: DataFrame) -> DataFrame:
    """``(class, component)`` of every class with a link, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    was = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("class"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("class"), F.col("v").alias("component")).distinct())


def links(docs: DataFrame, boundary: int, contract: Contract = DIGEST) -> DataFrame:
    """Links ``(a, b)`` of classes whose components are those of all links."""
    entries = stored(list_entries(docs, boundary, contract))
    lists = entries.groupBy("token").agg(F.min(F.struct("alone", "class")).alias("centre"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("token", F.col("centre.class").alias("a"))
    stars = stored(entries.join(lists, "token").where("class != a").select("a", F.col("class").alias("b")).distinct())
    wanted = stored(entries.join(lists, "token", "left_semi").select("class").distinct())
    own = shingle_table(docs, wanted, contract)
    first = stored(verified(stars, own, contract))
    joined = components(first)
    placed = entries.join(lists, "token", "left_semi").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = stored(placed)
    mixed_lists = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    left = placed.join(mixed_lists, "token", "left_semi").join(lists, "token").where("class != a")  # the centre has been compared
    listed = left.groupBy("class", "size_range").agg(F.collect_list("token").alias("own"))  # at most a set's prefix
    left = left.join(listed, ["class", "size_range"]).join(own.select("class", "parity"), "class")
    x, y = left.alias("x"), left.alias("y")
    apart = F.aggregate(F.zip_with("x.taken", "y.taken", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, b: s + b)
    differ = contract.differ_of(F.col("x.n") + F.col("y.n"))  # shingles that linked sets of these sizes can differ in
    bits = F.aggregate(F.zip_with("x.parity", "y.parity", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
    open_pair = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.class") < F.col("y.class"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.abs(F.col("x.n") - F.col("y.n")) <= differ)
        & (F.col("x.size_range") == F.col("y.size_range"))
        & ((F.col("x.p") == 0) | ((F.greatest("x.alone", "y.alone") <= differ) & (F.col("x.p") - apart <= differ)))
        & (bits <= differ)
        & (F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.token"))  # a pair comes once, from the first list that holds both
    )
    rest = x.join(y, open_pair).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    return first.union(verified(rest, own, contract))


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", contract: Contract = DIGEST) -> DataFrame:
    """``(doc, text_hash, n_shingles, component, component_id)`` of every row."""
    docs = keyed(df, id_col, text_col)
    table = stored(set_table(docs, contract))
    named = components(links(docs, cheaper_boundary(table, contract), contract))
    rows = table.join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))
    place = F.struct((F.col("doc") == LOWEST).alias("unnamed"), "doc", "text_hash")  # a row without an id comes last
    smallest = rows.where("n > 0").groupBy("component").agg(F.min(F.when(F.col("doc") != LOWEST, F.col("doc"))).alias("smallest"), F.min(place).alias("kept"))
    own = F.when(F.col("doc") != LOWEST, F.col("doc"))
    return rows.join(smallest, "component", "left").select(
        "doc", "text_hash", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("smallest")).otherwise(own).alias("component_id"), F.when(F.col("n") > 0, place == F.col("kept")).otherwise(True).alias("stays")
    )


def document_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", contract: Contract = DIGEST) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row."""
    return grouped(df, id_col, text_col, contract).select(F.when(F.col("doc") != LOWEST, F.col("doc")).alias(id_col), "n_shingles", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", contract: Contract = DIGEST) -> DataFrame:
    """The rows of ``df``, one of each group: the one with the smallest id, that of ``component_id``. Rows without words all stay."""
    stay = grouped(df, id_col, text_col, contract).where("stays").select(F.col("doc").alias("__quire_doc"), F.col("text_hash").alias("__quire_hash")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = df.withColumn("__quire_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))).withColumn("__quire_hash", F.xxhash64(text))
    return named.join(stay, ["__quire_doc", "__quire_hash"], "left_semi").dropDuplicates(["__quire_doc", "__quire_hash"]).select(*[F.col(f"`{c}`") for c in df.columns])


def brute(rows: list[tuple[int, str | None]], shingle: int = 3, percent: int = 90) -> list[tuple[int, int, int]]:
    """The contract over all pairs: for tests, with distinct ids."""
    import re

    made = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        made[key] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    root = {k: k for k in made}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(k for k in made if made[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = made[a], made[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted((k, len(made[k]), find(k)) for k in made)
