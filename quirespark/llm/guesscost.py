"""Secrets in texts: fixed patterns, and values in a credential context that are hard to guess.

Three patterns give the base spans. Besides those, every value that stands after a
credential word (a wider list than the base pattern's, any characters up to white
space or the quote that opened it, without marks at its end) is rated by its guess cost: the least sum of bits over all ways to cut it
into known words, dates, repeats, keyboard walks and brute-force characters, found
by dynamic programming over its positions. Values of ``MIN_BITS`` and more are
spans of kind ``guess``, unless a base ``assign`` span covers them already.

Edge cases. A null text is an empty one and has no spans; an empty table gives no rows. Texts are scanned whole.
Positions count code points; ends are exclusive. Repeated rows have equal results.
Rows stand for themselves, also without an id. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, records, tidy

KINDS = ("assign", "access", "hex", "guess")
#: Least guess cost in bits, and least length, of a value that is reported.
MIN_BITS, MIN_LENGTH = 40.0, 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # greedy runs: as long a match as without the bound, or none
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?id)["']?\x20*[:=]\x20*(?:"([^\s"]{8,})|'([^\s']{8,})|([^\s"']\S{7,}))""",
    re.IGNORECASE | re.ASCII,
)

# Common words in passwords, most common first.
WORDS = (
    "password qwerty admin welcome letmein monkey dragon master login hello football baseball iloveyou sunshine princess shadow "
    "superman michael jordan secret summer winter spring autumn love money test guest root user changeme default example sample "
    "token access private public server database system manager office company home family house world spark cloud data demo temp "
    "pass word key code open close start stop black white green orange purple silver golden tiger eagle lion wolf bear computer "
    "internet google account network security january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday "
    # prose
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "that with have this will your from they been good much some time very when come here just like long make many more only over such take than them well were what "
    "about above across action active added address after again against agent allow allowed almost along already also although always among amount another answer anyone anything "
    "appear application approach around article asked assign attempt authentication author authorization available avoid away back base based basic became because become before began begin behind being believe below best better "
    "between beyond book both bring build business called cannot care carried case cause certain change check child choose city class clear client collect common community complete configuration "
    "connect consider contact contain content continue control copy correct country course create created credential credentials current customer date decide default define delete describe description detail develop device "
    "different difficult document does done down during each early easy education effect either else empty enable end enough enter entire error even event ever every everyone everything everywhere exactly except exist expect "
    "expired explain external face fact false family field figure file final find first follow following force form format found full function further future general generate given going great group half hand happen "
    "head help hidden high himself history hold hour however idea important include including increase information inside instance instead interest into invalid issue itself keep kind know known language large last later least "
    "leave left length less letter level life line list little local long longer look lost machine made main mean member message method might minute missing moment month most mother must name national nature near need never next night none "
    "nothing notice number object often once online option optional order original other others outside page paper part party people perhaps period person place plain point policy possible power present problem process "
    "produce program project protected provide provider question quite rather read reader ready real reason receive recent record remain remember remote remove report request require required reset result return right rotate safe same save school search second "
    "section secure seem select send sent server service session several shall short should show side similar simple since small social something sometimes soon special stand state still stored story string strong student study subject "
    "support sure table tell term text their then there therefore these thing think third those though thought three through today together toward true turn type unable unbelievable under understand unique unknown until update upon user username using usual usually valid value various version view "
    "visit wait want water week where whether which while whole whose within without woman wonderful working would write wrong year young yourself"
).split()
# The rows that keyboard walks follow, forwards or backwards.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz")



def ranked(words: Iterable[str]) -> dict[str, int]:
    """Words in lower case, most common first, to the number of guesses that each takes."""
    return {word: rank for rank, word in enumerate(dict.fromkeys(w.lower() for w in words if len(w) > 2), 2)}


RANK = ranked(WORDS)
STEPS = {pair for row in ROWS for way in (row, row[::-1]) for pair in zip(way, way[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
#: Bits for the first key of a walk and its direction, and for each further character of a walk or a repeat.
WALK_BITS, STEP_BITS = math.log2(47) + 1, 0.5
_length: list[tuple[dict, int]] = []  # the dictionary that was last in use, and its longest word
YEAR_BITS, MONTH_BITS, DAY_BITS = math.log2(200), math.log2(12), math.log2(31)


def char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(52) if c.isascii() else math.log2(100)  # either case
    return math.log2(33)


def _grown(run: list[float]) -> tuple[float, float]:
    return run[0] + STEP_BITS, min(run[1], run[2]) + STEP_BITS


def _longest(rank: dict[str, int]) -> int:
    if not _length or _length[0][0] is not rank:
        _length[:] = [(rank, max(map(len, rank), default=0))]
    return _length[0][1]


def guess_bits(value: str, rank: dict[str, int] = RANK) -> float:
    """The least sum of bits over the segmentations of ``value``; O(length) for bounded words and dates."""
    n, low, longest = len(value), value.lower(), _longest(rank)
    if len(low) != n:
        low = value
    best = [0.0] + [math.inf] * n

    def offer(end: int, bits: float) -> None:
        if bits < best[end]:
            best[end] = bits

    # least bits of what ends here in a run of one character, or a walk, of 1, 2, and 3 or more characters
    same, walk = [math.inf] * 3, [math.inf] * 3
    for i in range(n):
        here = best[i]
        offer(i + 1, here + char_bits(value[i]))
        repeats, steps = i > 0 and value[i] == value[i - 1], i > 0 and (low[i - 1], low[i]) in STEPS
        same = [here + char_bits(value[i]), *(_grown(same) if repeats else (math.inf, math.inf))]
        walk = [here + WALK_BITS, *(_grown(walk) if steps else (math.inf, math.inf))]
        offer(i + 1, min(same[2], walk[2]))
        for size in range(3, min(longest, n - i) + 1):
            guesses = rank.get(low[i : i + size])
            if guesses:
                part = value[i : i + size]
                case = 0.0 if part == low[i : i + size] else 1.0 if part.istitle() or part.isupper() else float(size)
                offer(i + size, here + math.log2(guesses) + case)
        if value[i].isdigit():
            for stop in (4, 6, 7, 8, 10):
                if i + stop <= n and DATE.fullmatch(value, i, i + stop):
                    offer(i + stop, here + YEAR_BITS + (MONTH_BITS if stop > 4 else 0) + (DAY_BITS if stop >= 8 else 0))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place, end)`` of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], rank: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    starts, ends = [a for a, kind, _ in base if kind == 0], [b for _, kind, b in base if kind == 0]  # apart and in order
    found = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(m.lastindex), m[m.lastindex].rstrip(".,:;!?)]}>\"'")
        end = start + len(value)
        before = bisect_right(starts, start)
        if len(value) < MIN_LENGTH or before and end <= ends[before - 1]:
            continue
        if guess_bits(value, rank) >= MIN_BITS:
            found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] | None = None) -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>)`` of every row, in order of start, then kind.

    ``words`` is another dictionary, most common words first (of another language, or counted in the corpus); it goes to every task.
    """
    shared = df.sparkSession.sparkContext.broadcast(RANK if words is None else ranked(words))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("key", pa.int64()), ("spans", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value

        def rows():
            for key, text in records(batches):
                base = base_spans(text or "")
                found = sorted(base + guess_spans(text or "", base, rank))
                yield key, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]

        yield from emit(rows(), schema, lambda row: 64 + 48 * len(row[1]))

    was = df.schema[id_col].dataType
    mapped = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "key long, spans array<struct<kind: string, start: long, end: long>>")
    return mapped.select(F.col("key").cast(was).alias(id_col), "spans")


def span_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and text of the spans that :func:`scan` returns."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        F.col(id_col),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def brute(text: str) -> tuple[int, int, int, str]:
    """The base columns, straight from their definition: for tests."""
    patterns = (
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 0, 18),
        (r"[0-9a-f]+", 0, 0, 16),
    )
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least] for k, (p, flags, group, least) in enumerate(patterns)]
    return *map(len, found), hashlib.sha256(joined(sorted(sum(found, []))).encode()).hexdigest()
