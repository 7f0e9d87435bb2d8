"""Document fingerprints by a randomised edit embedding.

A text is walked through by a shared random walk: at step j the walk shows the
character it stands on and then moves on by the random bit that step j has for that
character. Two texts at a small edit distance soon show the same characters at the
same steps again, so that their edit distance becomes a Hamming distance between
the walks' outputs (Chakraborty, Goldenberg and Koucky, 2016). The steps' bits
repeat after ``PERIOD`` steps; the walk is then an automaton whose state is the step
modulo the period, and it takes one look-up for each character.

A fingerprint samples one random bit of the shown character at 256 to 512 steps
that are spread over the whole walk. Level L has one step in each stretch of 2**L,
chosen out of those of level L - 1, so that fingerprints of texts of different
length share steps. Likeness is twice the share of equal bits less one, at least 0.

Edge cases. A null text is an empty one; two empty texts are alike by 1, an empty
and another by 0. Texts are walked through whole. Rows with equal ids stand in
order of their texts, a null id comes first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_points, emit, range_of, records, shuffle_partitions, tidy

PERIOD, CLASSES, SAMPLES = 1024, 256, 512


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 64-bit values of integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@lru_cache(1)
def walk_states() -> list[list]:
    """State of step j: for each class of characters the state in which the walk stands on the next one, then j."""
    moves = (mixed(np.arange(PERIOD * CLASSES), 1) & np.uint64(1)).reshape(PERIOD, CLASSES).astype(bool)
    states: list[list] = [[] for _ in range(PERIOD)]
    arrive = np.zeros((PERIOD, CLASSES), np.int64)
    near = np.full(CLASSES, 2 * PERIOD)
    for j in range(2 * PERIOD - 1, -1, -1):
        near = np.where(moves[j % PERIOD], j, near)
        if j < PERIOD:
            arrive[j] = (near + 1) % PERIOD
    for j in range(PERIOD):
        states[j].extend([states[k] for k in arrive[j].tolist()])
        states[j].append(j)
    return states


@lru_cache(64)
def sample_steps(level: int) -> np.ndarray:
    """The steps that level ``level`` samples, one of each stretch of 2**level."""
    at = np.arange(SAMPLES, dtype=np.int64)
    for k in range(level, 0, -1):
        at = finer(at, k)
    return at


def finer(at: np.ndarray, level: int) -> np.ndarray:
    """The samples of level ``level - 1`` that are samples ``at`` of level ``level``."""
    return 2 * at + (mixed(at + (np.int64(level) << 40), 2) & np.uint64(1)).astype(np.int64)


def fingerprint(text: str) -> str:
    """Level (2 hex digits), number of samples (4), and their bits."""
    if not text:
        return "000000"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    with np.errstate(over="ignore"):
        classes = (((points + np.uint32(1)) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint8)
    steps = np.fromiter(map(itemgetter(CLASSES), accumulate(classes.tobytes(), getitem, initial=walk_states()[0])), np.int64, len(points) + 1)
    moved = (steps[1:] - steps[:-1]) % PERIOD
    moved[moved == 0] = PERIOD
    times = np.concatenate([[0], np.cumsum(moved)])
    length = int(times[-1])
    level = max(0, (-(-length // SAMPLES) - 1).bit_length())
    at = sample_steps(level)
    at = at[at < length]
    shown = classes[np.searchsorted(times, at, "right") - 1].astype(np.int64)
    bits = (mixed(at * CLASSES + shown, 3) & np.uint64(1)).astype(np.uint8)
    return f"{level:02x}{len(at):04x}{np.packbits(bits).tobytes().hex()}"


def _parsed(value: str) -> tuple[int, np.ndarray]:
    count = int(value[2:6], 16)
    return int(value[:2], 16), np.unpackbits(np.frombuffer(bytes.fromhex(value[6:]), np.uint8), count=count)


def likeness(a: str, b: str) -> float:
    """0 to 1: equal bits among the steps that both levels share."""
    (la, xa), (lb, xb) = _parsed(a), _parsed(b)
    if not len(xa) or not len(xb):
        return float(len(xa) == len(xb))
    level, sides = max(la, lb), []
    for own, bits in ((la, xa), (lb, xb)):
        at = np.arange(SAMPLES, dtype=np.int64)
        for k in range(level, own, -1):
            at = finer(at, k)
        sides.append(np.where(at < len(bits), bits[np.minimum(at, len(bits) - 1)], 2))
    there = (sides[0] != 2) | (sides[1] != 2)
    return max(0.0, 2.0 * float((sides[0] == sides[1])[there].mean()) - 1.0)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row."""
    schema = pa.schema([("key", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(((key, fingerprint(text or "")) for key, text in records(batches)), schema, lambda row: 256)

    mapped = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "key long, fingerprint string")
    return mapped.select(F.col("key").alias(id_col), "fingerprint")


def scales(level: int, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(level, size, first bits)`` under which a fingerprint is banded.

    Sizes are three quarters of powers of two. A fingerprint is also banded at the next level, by the
    samples that it has there, so that texts meet if the shorter walk has three quarters of the longer one's steps.
    """
    at = finer(np.arange(SAMPLES, dtype=np.int64), level + 1)
    for own, there in ((level, bits), (level + 1, bits[at[at < len(bits)]])):
        power = min(256, 1 << (len(there).bit_length() - 1)) if len(there) else 0
        for size in sorted({3 * power // 4, 3 * power // 2 if power < 256 else 0} - {0} | ({1} if power == 1 else set())):
            if size <= len(there):
                yield own, size, there[:size]


def band_count(width: int, at_least: float, recall: float) -> int:
    """Bands of ``width`` bits of which two fingerprints of likeness ``at_least`` share one with chance ``recall``."""
    same = ((1 + at_least) / 2) ** width
    return 1 if same >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - same))))


def band_keys(value: str, width: int, bands: int) -> np.ndarray:
    """The bands of a fingerprint as 64-bit names; none for an empty one."""
    out, number = [], np.arange(bands * width, dtype=np.int64)
    for level, size, bits in scales(*_parsed(value)):
        chosen = bits[(mixed(number, 4) % np.uint64(size)).astype(np.int64)].reshape(bands, width).astype(np.uint64)
        packed = (chosen << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        out.append(mixed(packed ^ mixed(np.arange(bands) + (level << 40) + (size << 24), 5), 6))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def near_copies(prints: DataFrame, id_col: str = "doc_id", at_least: float = 0.8, width: int = 24, recall: float = 0.99) -> DataFrame:
    """``(representative, id, likeness)``: links of likeness ``at_least`` and more, from the lesser id, within the bands' recall.

    The rows of a band meet its least id; those that aren't alike meet the least of the others in the
    next round, and so on until each band's rows that are left lie in one group. Links that only join
    rows of one group are left out. Ids are distinct; null ids have no links. A band whose rows are all unlike takes as many rounds as it has rows.
    """
    from .common import stored
    from .jaccard import components

    bands = band_count(width, at_least, recall)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, value in records(batches):
            found = band_keys(value, width, bands)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int64)), pa.array(found)], names=["own", "band"])

    named = stored(prints.select(F.col(id_col).cast("long").alias("own"), "fingerprint").where("own is not null"))
    left = stored(named.mapInArrow(tidy(name), "own long, band long"))
    alike = F.pandas_udf(lambda a, b: a.combine(b, likeness), "double")
    seen = links = None
    while True:
        if links is not None:
            left = left.join(components(links.select(F.col("a"), F.col("b"))), left.own == F.col("class"), "left").select("own", "band", F.coalesce("component", "own").alias("component"))
        else:
            left = left.withColumn("component", F.col("own"))
        open_bands = left.groupBy("band").agg(F.min("own").alias("a"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "a")
        left = stored(left.join(open_bands, "band").select("band", "own", "a"))
        pairs = left.where("own > a").select("a", F.col("own").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        if not left.take(1):
            break
        compared = pairs.join(named.select(F.col("own").alias("a"), F.col("fingerprint").alias("fa")), "a").join(named.select(F.col("own").alias("b"), F.col("fingerprint").alias("fb")), "b")
        now = stored(compared.select("a", "b", alike("fa", "fb").alias("likeness")))
        seen = now.select("a", "b") if seen is None else seen.union(now.select("a", "b"))
        found = now.where(F.col("likeness") >= at_least)
        links = found if links is None else links.union(found)
        left = left.where("own > a").select("own", "band")  # the least id has met all rows of its band
    if links is None:
        return named.select(F.col("own").alias("representative"), F.col("own").alias(id_col), F.lit(0.0).alias("likeness")).limit(0)
    return links.select(F.col("a").alias("representative"), F.col("b").alias(id_col), "likeness")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first characters of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edited_and_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, beside those of the next document.

    Rows are dealt once, into ranges of ascending id; the first row of a range also goes to
    the range before it, so that each range can be walked through by itself. What the driver
    sees of the ids is one cut and one least id for each range.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = cut_points(docs, "doc_id", parts or shuffle_partitions(df.sparkSession))
    placed = docs.withColumn("part", range_of(F.col("doc_id"), cuts))
    first = {r.part: r.first.doc_id for r in placed.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first")).collect()}
    filled = sorted(first)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    table = F.array(*[F.struct(F.lit(first.get(p)).cast("long").alias("first"), F.lit(before.get(p, 0)).alias("before")) for p in range(len(cuts) + 1)])
    own = F.element_at(table, F.col("part") + 1)
    here, there = F.struct(F.col("part").alias("part"), F.lit(0).alias("peek")), F.struct(own["before"].alias("part"), F.lit(1).alias("peek"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(own["first"]), F.array(here, there)).otherwise(F.array(here))).alias("to"))
    ordered = dealt.select("doc_id", "text", "to.part", "to.peek").repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("peek", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last = None
            for key, text, peek in records(batches):
                own = fingerprint(text)
                if last is not None:
                    other = edited(last[1], text)
                    changed = fingerprint(other)
                    yield last[0], len(last[1]), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), last[2], changed, likeness(last[2], changed), likeness(last[2], own)
                if peek:
                    for _ in records(batches):
                        pass
                    return
                last = key, text, own

        yield from emit(rows(), schema, lambda row: 512)

    return ordered.select("doc_id", "text", "peek").mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
