"""Line dedup by a segment-partition edit join, in DataFrame functions throughout.

A line goes if an equal line, or one within a threshold of edits, stands before it: in
a document of smaller id, or earlier in the same one. Lines are judged on the input.

The threshold is a number (``THRESHOLD``, as in the query's SQL), or classes of length (``GROWING``):
the shorter line of a pair decides. A line is listed in the segments of its own class, and looks
for shorter lines in the segments of theirs.

Equal lines meet in partial minima over 96 bits of hashes of a line. For the others, a line is split
into threshold-plus-one segments; an edit at most touches one, so that a near line has
one of them unchanged, at a place that the two lengths leave open (the multi-match-aware
places of Li, Deng, Wang and Feng, 2011). Distinct lines alone enter the index, by hashes
of length, segment number and segment; lists that hold one line are dropped at once. A
list's lines are verified against its earliest one. Where a line stays and others of its list
come before it, lists are compared pair by pair: small ones as they are, and middling ones by
sketches of their lines first (parities of hashed characters and pairs of characters, of which an edit
turns four at most), so that near copies with more edits than allowed give no pairs. Large lists are split again by the
segments of what their lines don't share (numbered forms by their numbers), until they are no longer large.

The check is a banded bit-parallel automaton: for every number of errors, the diagonals
that can be reached are the bits of an integer, which shifts and masks move on by one
character at a time. It begins behind what both lines begin with and ends before what both end with (in
blocks), and stops once no diagonal is left.

Near lines have ``SHORTEST`` characters (code points) or more. Shorter lines always stay by the
query's SQL; where ``short`` is set, as in the pipeline, equal ones go too. Short blank lines, of white
space alone, part a text and stay then.

Edge cases. A null text stays null and has no lines; an empty text stays empty. A text
whose lines all go becomes empty. A repeated row (equal id and text) is the same document
and keeps the same lines; rows with equal ids and other texts stand in order of a hash of
the text; a null id comes first. An empty table gives no rows. Clashing names of other
columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

THRESHOLD, SHORTEST = 1, 20
#: Least lengths, and the edits from there on: one for 20 characters. Places to look at grow with the cube of the edits (4, 12, 26, 49, 82).
GROWING = ((20, 1), (40, 2), (60, 3))
LOWEST = -(1 << 63)
#: Rows up to which the hashes of lines that need a check are broadcast (16 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 500_000
#: Lines of a list that are compared pair by pair, by their texts and by sketches first, and how often a larger list is split.
SMALL, MIDDLE, LEVELS = 32, 8192, 16
#: Pairs in all, for each entry of a list, up to which lists that are left aren't split any more.
LEFT = 2
#: Characters after which a pair's check may end early, and of which its common beginning and end consist.
BLOCK = 16


def places(threshold: int) -> list[tuple[int, int, int]]:
    """``(difference in length, segment, shift)`` at which a line looks for segments of no longer lines."""
    out = []
    for longer in range(threshold + 1):
        for i in range(1, threshold + 2):
            low = max(1 - i, longer - (threshold + 1 - i))
            high = min(i - 1, longer + (threshold + 1 - i))
            out += [(longer, i - 1, shift) for shift in range(low, high + 1)]
    return out


def classes(threshold: int | tuple) -> list[tuple[int, int | None, int]]:
    """``(least length, length from which the next class holds, edits)``."""
    found = ((0, threshold),) if isinstance(threshold, int) else threshold
    return [(low, high, edits) for (low, edits), (high, _) in zip(found, [*found[1:], (None, 0)], strict=True)]


def inside(length: Column, low: int, high: int | None) -> Column:
    return (length >= low) if high is None else (length >= low) & (length < high)


def place_table(threshold: int | tuple) -> Column:
    """All places as ``array<struct<edits, longer, i, shift, listed>>``; a line's own segments are listed."""
    rows = [(edits, longer, i, shift, int(not longer and not shift)) for edits in sorted({e for _, _, e in classes(threshold)}) for longer, i, shift in places(edits)]
    return F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("edits", "longer", "i", "shift", "listed"), strict=True)]) for r in rows])


def looked_at(threshold: int | tuple, size: Column) -> Column:
    """The places of a line of ``size`` characters."""
    if isinstance(threshold, int):
        return place_table(threshold)

    return F.filter(place_table(threshold), lambda p: p["edits"] == edits_allowed(size - p["longer"], threshold))


def cut_at(size: Column, table: Column) -> Column:
    """Where the places of a line lie: the last segments are longer by one where a length doesn't divide.

    Lambdas keep this small: written out for each place, it is too long to be compiled.
    """

    def parted(p: Column) -> Column:
        own, n = size - p["longer"], p["edits"] + 1
        return F.struct(p.alias("p"), own.alias("own"), F.call_function("div", own, n).cast("int").alias("base"), (n - own % n).alias("short"))

    def cut(q: Column) -> Column:
        start = q["p"]["i"] * q["base"] + F.greatest(F.lit(0), q["p"]["i"] - q["short"]) + q["p"]["shift"]
        return F.struct(q["p"].alias("p"), q["own"].alias("own"), start.alias("start"), (q["base"] + (q["p"]["i"] >= q["short"]).cast("int")).alias("width"))

    return F.filter(F.transform(F.transform(table, parted), cut), lambda q: (q["start"] >= 0) & (q["start"] + q["width"] <= size))


def keys(line: Column, size: Column, threshold: int | tuple) -> Column:
    """``array<struct<list, listed>>``: hashes under which a line is listed, and others under which it looks for lines."""
    return F.transform(cut_at(size, looked_at(threshold, size)), lambda q: F.struct(F.xxhash64(q["own"], q["p"]["i"], F.substring(line, q["start"] + 1, q["width"])).alias("list"), q["p"]["listed"].alias("listed")))


def entries(text: Column, size: Column, table: Column, into: Column | None = None, listed: Column | None = None) -> Column:
    """What :func:`keys` lists and looks for, with the characters on either side of the segment that a list is about.

    ``into`` is the list that is split further, if it is one: two lines of a list that are near have rests that
    are, and share a segment of those. A line's difference in length and number of edits stay.
    """

    def entry(q: Column) -> Column:
        parts = [q["own"], q["p"]["i"], F.substring(text, q["start"] + 1, q["width"])]
        rest = F.concat(F.substring(text, F.lit(1), q["start"]), F.substring(text, q["start"] + q["width"] + 1, size))
        own = q["p"]["listed"] if listed is None else q["p"]["listed"] * listed
        return F.struct(F.xxhash64(*parts if into is None else [into, *parts]).alias("list"), own.alias("listed"), q["p"]["longer"].alias("longer"), q["p"]["edits"].alias("edits"), rest.alias("rest"))

    return F.transform(cut_at(size, table), entry)


def finer_entries(threshold: int | tuple) -> Column:
    """The entries of an entry's rest."""
    own = F.filter(place_table(threshold), lambda p: (p["edits"] == F.col("edits")) & (p["longer"] == F.col("longer")))
    return entries(F.col("rest"), F.length("rest"), own, F.col("list"), F.col("listed"))


def sketch(line: Column) -> Column:
    """Parities of hashed characters (``c``, 64 bits), of pairs side by side (``p0`` to ``p3``) and of pairs with one character between them (``s0`` to ``s3``).

    A replaced character turns two bits of the first, and four of each of the others; one that is put in or left out turns one, three and five: at most.
    """
    names = ["c", *[f"{kind}{k}" for kind in "ps" for k in range(4)]]

    def turned(bits: Column, code: Column, when: Column | None = None) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(F.lit(63)))
        return bits.bitwiseXOR(bit if when is None else F.when(when, bit).otherwise(F.lit(0).cast("long")))

    def coded(x: Column, i: Column) -> Column:
        own, beside, over = F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)
        return F.struct(F.hash(own).alias("c"), F.when(beside.isNotNull(), F.hash(own, beside)).alias("p"), F.when(over.isNotNull(), F.hash(over, own)).alias("s"))

    def step(state: Column, code: Column) -> Column:
        share = lambda kind: F.shiftrightunsigned(code[kind], 6).bitwiseAND(F.lit(3))
        return F.struct(turned(state["c"], code["c"]).alias("c"), *[turned(state[f"{kind}{k}"], code[kind], share(kind) == k).alias(f"{kind}{k}") for kind in "ps" for k in range(4)])

    none = F.struct(*[F.lit(0).cast("long").alias(name) for name in names])
    # the characters are cut apart once: a lambda's variable holds them
    held = F.array(F.split(line, ""))
    return F.transform(held, lambda x: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: coded(x, i)), none, step))[0]


def may_be_near(a: str, b: str, edits: int) -> Column:
    """Whether the sketches of two rows with ``size``, ``most`` and ``sketch`` leave open that their lines are near.

    They do if some numbers of replaced characters and of others, ``edits`` at most together, explain all bits that differ.
    """
    apart = F.abs(F.col(f"{a}.size") - F.col(f"{b}.size"))
    most = F.when(F.col(f"{a}.size") <= F.col(f"{b}.size"), F.col(f"{a}.most")).otherwise(F.col(f"{b}.most"))

    def unlike(*names: str) -> Column:
        out = F.lit(0)
        for name in names:
            out = out + F.bit_count(F.col(f"{a}.sketch.{name}").bitwiseXOR(F.col(f"{b}.sketch.{name}")))
        return out

    single, pairs, spread = unlike("c"), unlike("p0", "p1", "p2", "p3"), unlike("s0", "s1", "s2", "s3")
    # with fewer edits in all than allowed, one more replaced character does no harm to the bounds
    explained = F.lit(False)
    for others in range(edits + 1):
        replaced = most - others
        explained = explained | ((replaced >= 0) & (apart <= others) & (single <= 2 * replaced + others) & (pairs <= 4 * replaced + 3 * others) & (spread <= 4 * replaced + 5 * others))
    return explained


def edits_allowed(size: Column, threshold: int | tuple) -> Column:
    """The edits that a line of ``size`` characters allows to no shorter ones; -1 without a class."""
    out = F
    for low, high, edits in classes(threshold):
        out = out.when(inside(size, low, high), edits)
    return out.otherwise(-1)


def near(a: Column, b: Column, threshold: int | tuple) -> Column:
    """Whether two strings are within the edits that the shorter one's class allows."""
    if isinstance(threshold, int):
        return within(a, b, threshold)
    shorter = F.least(F.length(a), F.length(b))
    most = max(e for _, _, e in classes(threshold))
    # long lines that are nearly near take the automaton's lambdas milliseconds: Spark's own bounded distance sends them away first
    return F.when(F.levenshtein(a, b, most) < 0, False).otherwise(within(a, b, most, edits_allowed(shorter, threshold)))


def within(a: Column, b: Column, threshold: int, allowed: Column | None = None) -> Column:
    """Whether two strings are within ``threshold`` edits, or within ``allowed``, if that is fewer: bit d + threshold of level e says that diagonal d takes e errors at most."""
    width, full = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1

    def closed(levels: list[Column]) -> list[Column]:
        out = [levels[0]]
        for level in levels[1:]:
            out.append(level.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
        return out

    def levels(values: list[Column]) -> Column:
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(values)])

    first = levels([F.lit(sum(1 << (threshold + d) for d in range(e + 1))) for e in range(threshold + 1)])

    def alike(x: Column, at: Column, to: Column) -> Column:
        return F.slice(x["l"], at, BLOCK) == F.slice(x["r"], to, BLOCK)

    def blocks(count: Column, same) -> Column:
        """How many of ``count`` blocks are the same, from the first on."""
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
        return F.when(count < 1, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), start, lambda acc, k: F.when(acc["open"] & same(k), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("open"))))["n"])

    def with_head(x: Column) -> Column:
        count = F.call_function("div", F.least(F.size(x["l"]), F.size(x["r"])), F.lit(BLOCK)).cast("int")
        return F.struct(x["l"].alias("l"), x["r"].alias("r"), count.alias("count"), blocks(count, lambda k: alike(x, k * BLOCK + 1, k * BLOCK + 1)).alias("head"), x["allowed"].alias("allowed"))

    def with_tail(x: Column) -> Column:
        na, nb = F.size(x["l"]), F.size(x["r"])
        same = blocks(x["count"] - x["head"], lambda k: alike(x, na - (k + 1) * BLOCK + 1, nb - (k + 1) * BLOCK + 1))
        return F.struct(x["l"].alias("l"), x["r"].alias("r"), (x["head"] * BLOCK).alias("from"), (na - same * BLOCK).alias("to"), (nb - na).alias("end"), x["allowed"].alias("allowed"))

    def check(pair: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            c = F.get(pair["l"], i)
            same = F.lit(0)
            for d in range(width):
                same = same.bitwiseOR(F.when(F.get(pair["r"], i + (d - threshold)) == c, 1 << d).otherwise(0))
            out = [state["r0"].bitwiseAND(same)]
            for e in range(1, threshold + 1):
                was, less = state[f"r{e}"], state[f"r{e - 1}"]
                out.append(was.bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)))
            return levels(closed(out))

        def stretch(state: Column, k: Column) -> Column:
            low = pair["from"] + k * BLOCK
            rows = F.sequence(low, F.least(low + BLOCK, pair["to"]) - 1)
            return F.when(state[f"r{threshold}"] == 0, state).otherwise(F.aggregate(rows, state, step))  # no diagonal is left: far apart

        left = F.call_function("div", pair["to"] - pair["from"] + (BLOCK - 1), F.lit(BLOCK)).cast("int")
        last = F.when(left < 1, first).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(left, F.lit(1)) - 1), first, stretch))
        level = last[f"r{threshold}"] if allowed is None else F.element_at(F.transform(F.array(last), lambda x: F.array(*[x[f"r{e}"] for e in range(threshold + 1)]))[0], pair["allowed"] + 1)
        return F.call_function("shiftright", level, pair["end"] + threshold).bitwiseAND(F.lit(1)) == 1

    na, nb = F.length(a), F.length(b)
    # the characters are cut apart once, and what both lines begin and end with is left out: lambdas' variables hold them
    most = F.lit(threshold) if allowed is None else allowed
    pair = F.array(F.struct(F.split(a, "").alias("l"), F.split(b, "").alias("r"), most.alias("allowed")))
    close = F.abs(na - nb) <= most
    return F.when(~close, False).when((na == 0) | (nb == 0), True).otherwise(F.exists(F.transform(F.transform(pair, with_head), with_tail), check))


def numbered(df: DataFrame, id_col: str, text_col: str, short: bool = False) -> DataFrame:
    """``(doc, text_hash, at, line, id, other)`` of the lines that count; ``id`` and ``other`` are hashes of 64 and 32 bits."""
    docs = df.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.split(F.col(text_col), "\n").alias("lines"))
    each = docs.select("doc", "text_hash", F.posexplode("lines").alias("at", "line"))  # apart: else every line would hash the whole text
    counts = F.length("line") >= SHORTEST
    return each.where(counts | F.col("line").rlike(r"[^\x20\x09-\x0D]") if short else counts).withColumn("id", F.xxhash64("line")).withColumn("other", F.hash("line"))


def distinct_lines(lines: DataFrame, threshold: int | tuple) -> DataFrame:
    """``(id, other, n, first, line, keys)`` of each line's text: how often it stands, where first, and its keys. Lines that are too short to be near have none."""
    long = F.length("line") >= SHORTEST
    found = lines.select("id", "other", F.struct("doc", "text_hash", "at", F.when(long, F.col("line")).alias("line")).alias("e")).groupBy("id", "other").agg(F.count("*").alias("n"), F.min("e").alias("e"))
    known = found.select("id", "other", "n", F.struct("e.doc", "e.text_hash", "e.at").alias("first"), "e.line", F.length("e.line").alias("size"))
    return stored(known.select("id", "other", "n", "first", "line", F.when(F.col("line").isNotNull(), keys(F.col("line"), F.col("size"), threshold)).alias("keys")))


def shared_lists(distinct: DataFrame) -> DataFrame:
    """``(list, id, listed)`` of lists with a listed line and another one: keys are counted in parts, not gathered."""
    every = distinct.select("id", F.explode("keys").alias("e")).select("id", "e.*")
    shared = stored(every.groupBy("list").agg(F.count("*").alias("n"), F.max("listed").alias("listed")).where("n > 1 and listed = 1").select("list"))
    return stored(every.join(bounded(shared), "list").distinct())


def bounded(keys: DataFrame) -> DataFrame:
    """A stored table of 64-bit names, broadcast if it has few enough rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def near_lines(distinct: DataFrame, threshold: int | tuple) -> DataFrame:
    """``(id, other)`` of the lines that a near line stands before.

    In each round a list's lines are verified against its earliest listed one, so that the pairs are no more
    than the lists' entries. What can still matter then is a line that stays and an earlier one beside it. Lists
    with such lines are compared pair by pair if they have ``SMALL`` lines at most, and up to ``MIDDLE`` by
    sketches, which let hardly any pair through that isn't near; larger ones are split by
    the segments of what their lines don't share, so that numbered forms, say, part by their numbers.
    """
    lists = shared_lists(distinct)
    wanted = stored(lists.select("id").distinct())
    texts = distinct.where("line is not null").select("id", F.struct("other", "first", "line").alias("t")).join(bounded(wanted), "id", "left_semi")
    own = stored(texts.groupBy("id").agg(F.min("t").alias("t")).select("id", "t.*"))

    def later(pairs: DataFrame) -> DataFrame:
        """The later lines of the pairs that are near."""
        a, b = own.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("first").alias("fa")), own.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("first").alias("fb"))
        dealt = pairs.repartition(shuffle_partitions(pairs.sparkSession), "a", "b")  # few bytes and long checks: else they may all lie in a task
        return dealt.join(a, "a").join(b, "b").where(near(F.col("la"), F.col("lb"), threshold)).select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()

    def met(side: DataFrame, also: Column | None = None) -> DataFrame:
        """Each two lines of a list whose later one stays, once."""
        x, y = side.alias("x"), side.where("listed = 1").alias("y")
        stays = F.when(F.col("x.first") > F.col("y.first"), ~F.col("x.gone")).otherwise(~F.col("y.gone"))
        each_once = (F.col("x.listed") == 0) | (F.col("x.id") < F.col("y.id"))
        both = (F.col("x.list") == F.col("y.list")) & (F.col("x.id") != F.col("y.id")) & each_once & stays
        pairs = x.join(y, both if also is None else both & also)
        return stored(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())

    members = stored(lists.join(own.select("id", "first"), "id"))
    entered = members.count()
    gone, small = None, []
    for level in range(LEVELS + 1):
        heads = members.groupBy("list").agg(F.min(F.when(F.col("listed") == 1, F.struct("first", "id"))).alias("head"), F.count("*").alias("n")).select("list", F.col("head.id").alias("head"), "n")
        beside = stored(members.join(heads, "list").where("id != head"))
        late = later(beside.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
        gone = stored(late if gone is None else gone.union(late).distinct())
        marked = beside.where("n > 2").join(gone.withColumn("gone", F.lit(True)), "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        open_lists = marked.groupBy("list").agg(F.min("first").alias("least"), F.max(F.when(~F.col("gone"), F.col("first"))).alias("last"), F.max("listed").alias("any")).where("least < last and any = 1").select("list")
        left = stored(marked.join(open_lists, "list", "left_semi"))
        final = F.lit(level == LEVELS)
        if level:
            final = final | (F.length("rest") - F.col("longer") <= F.col("edits"))
        large = left.where((F.col("n") > MIDDLE) & ~final)
        middle = left.where((F.col("n") > SMALL) & (F.col("n") <= MIDDLE) & ~final)
        work = large.agg(F.sum("n")).first()[0] or 0
        done = work <= LEFT * entered  # few enough for all lists that are left: no more in all than a constant for each entry
        paired = left.where((F.col("n") <= SMALL) | (F.col("n") > MIDDLE) | final) if done else left.where((F.col("n") <= SMALL) | final)
        small.append(met(paired))
        sketches = own.join(middle.select("id").distinct(), "id", "left_semi").select("id", F.length("line").alias("size"), edits_allowed(F.length("line"), threshold).alias("most"), sketch(F.col("line")).alias("sketch"))
        small.append(met(middle.join(stored(sketches), "id"), may_be_near("x", "y", max(e for _, _, e in classes(threshold)))))
        if done:
            break
        if not level:
            split = stored(large.select("list").distinct())
            held = own.join(large.select("id").distinct(), "id", "left_semi")
            large = held.select("id", "first", F.explode(entries(F.col("line"), F.length("line"), looked_at(threshold, F.length("line")))).alias("e")).select("id", "first", "e.*").join(bounded(split), "list", "left_semi")
        finer = stored(large.select("id", "first", F.explode(finer_entries(threshold)).alias("e")).select("id", "first", "e.*").distinct())
        marked = finer.join(gone.withColumn("gone", F.lit(True)), "id", "left")
        shared = marked.groupBy("list").agg(F.min("first").alias("least"), F.max(F.when(F.col("gone").isNull(), F.col("first"))).alias("last"), F.max("listed").alias("any")).where("least < last and any = 1").select("list")
        members = stored(finer.join(shared, "list", "left_semi"))
    pairs = small[0]
    for more in small[1:]:
        pairs = pairs.union(more)
    return gone.union(later(pairs.distinct())).distinct().join(own.select("id", "other"), "id")


def repeated_lines(df: DataFrame, threshold: int | tuple = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``(doc, text_hash, at)`` of every line that an equal or near line stands before."""
    lines = numbered(df, id_col, text_col, short)
    distinct = distinct_lines(lines, threshold)
    late = near_lines(distinct, threshold)
    known = stored(distinct.select("id", "other", "n", "first").join(late.withColumn("near", F.lit(True)), ["id", "other"], "left").where("n > 1 or near"))
    # a line that stands very often is dealt to several tasks; there are 4 such lines for each partition at most
    whole = known.agg(F.sum("n")).first()[0] or 0
    often = max(1, -(-whole // (4 * shuffle_partitions(df.sparkSession))))
    shares = F.ceil(F.col("n") / often).cast("int")
    dealt = F.broadcast(known.where(F.col("n") > often).select("id", "other", shares.alias("shares")))
    salted = lines.select("doc", "text_hash", "at", "id", "other").join(dealt, ["id", "other"], "left").withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "text_hash", "at"), "shares").cast("int")))
    to = known.select("id", "other", "first", "near", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > often, shares - 1).otherwise(0))).alias("share"))
    return salted.join(to, ["id", "other", "share"]).where((F.struct("doc", "text_hash", "at") != F.col("first")) | F.col("near")).select("doc", "text_hash", "at")


def without_repeats(df: DataFrame, threshold: int | tuple = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``df`` with all its columns, and ``__quire_lines`` and ``__quire_gone``: its text's lines, and those that went."""
    gone = repeated_lines(df, threshold, id_col, text_col, short).groupBy(F.col("doc").alias("__quire_doc"), F.col("text_hash").alias("__quire_hash")).agg(F.collect_set("at").alias("__quire_at"))
    named = df.withColumn("__quire_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))).withColumn("__quire_hash", F.xxhash64(F.col(text_col)))
    both = named.join(gone, ["__quire_doc", "__quire_hash"], "left")
    lines = F.split(F.col(text_col), "\n")
    # the lines are cut apart once: a lambda's variable holds them; and array_except hashes, where a look-up would search
    held = F.array(F.struct(lines.alias("l"), F.col("__quire_at").alias("at")))
    kept = F.get(F.transform(held, lambda h: F.transform(F.array_except(F.sequence(F.lit(0), F.size(h["l"]) - 1), h["at"]), lambda i: F.get(h["l"], i))), F.lit(0))
    text = F.when(F.col("__quire_at").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    others = [text.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in df.columns]
    return both.select(*others, F.coalesce(F.size(lines), F.lit(0)).alias("__quire_lines"), F.coalesce(F.size("__quire_at"), F.lit(0)).alias("__quire_gone"))


def deduplicated(df: DataFrame, threshold: int | tuple = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """The rows of ``df`` with the lines that stay."""
    return without_repeats(df, threshold, id_col, text_col, short).select(*[F.col(f"`{c}`") for c in df.columns])


def line_digests(df: DataFrame, threshold: int | tuple = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's lines, those that went, and the digest of what is left."""
    found = without_repeats(df.select(id_col, text_col), threshold, id_col, text_col)
    return found.select(id_col, F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__quire_lines")).cast("long").alias("n_lines"), F.col("__quire_gone").cast("long").alias("n_removed"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
