import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quirespark.llm import lines as L
from quirespark.llm.queries import QUERIES

from .util import ODD_TEXTS, empty_documents, odd_documents, save


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, threshold):
    """Line by line against every earlier one, with distinct ids."""
    seen, out = [], []
    for key, text in sorted(rows, key=lambda r: r[0]):
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            near = len(line) >= L.SHORTEST and any(line == s or abs(len(line) - len(s)) <= threshold and distance(line, s) <= threshold for s in seen)
            if len(line) >= L.SHORTEST and line not in seen:
                seen.append(line)
            gone += near
            if not near:
                kept.append(line)
        out.append((key, 0 if text is None else len(text.split("\n")), gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def edited(rng, line, edits):
    own = list(line)
    for _ in range(edits):
        at = rng.randrange(len(own))
        how = rng.randrange(3)
        if how == 0:
            own[at] = rng.choice("xyzé")
        elif how == 1:
            own.insert(at, rng.choice("xyz漢"))
        else:
            del own[at]
    return "".join(own)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()))


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_automaton_is_the_edit_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("abc", "abcd")]
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randrange(1, 30)))
        pairs.append((a, edited(rng, a, rng.randrange(0, min(5, len(a))))))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.within(F.col("a"), F.col("b"), threshold).alias("near"))
    assert all(r.near == (distance(r.a, r.b) <= threshold) for r in df.collect())


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_automaton_on_longer_lines(spark, threshold):
    """Common beginnings and ends, edits at the borders of blocks, and pairs that are far apart."""
    rng = random.Random(10 + threshold)
    pairs = []
    for n in (15, 16, 17, 31, 32, 33, 48, 64, 100):
        for _ in range(25):
            a = "".join(rng.choices("ab", k=n))
            pairs.append((a, edited(rng, a, rng.randrange(0, 6))))
        a = "".join(rng.choices("ab", k=n))
        pairs += [(a, a), (a, a[:16] + "xyzw" + a[16:]), (a, a[::-1]), (a + "x", a), (a, "x" + a), (a + a, a + "yé" + a)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.within(F.col("a"), F.col("b"), threshold).alias("near"))
    assert [(r.a, r.b) for r in df.collect() if r.near != (distance(r.a, r.b) <= threshold)] == []


@pytest.mark.parametrize("threshold", [1, 2])
def test_near_lines_equal_brute_force(spark, threshold):
    rng = random.Random(21)
    bases = ["".join(rng.choices("abcd ", k=rng.choice([19, 20, 21, 22, 35, 60]))) for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, threshold)
    assert sum(r[2] for r in want) > 40
    assert found(L.line_digests(df, threshold)) == want


def test_query(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op8_near_lines"](spark, sf)) == brute(rows, L.THRESHOLD)
    odd = odd_documents(spark)
    assert QUERIES["op8_near_lines"](spark, save(odd, tmp_path / "odd")).count() == len(ODD_TEXTS) + 1
    got = L.deduplicated(odd)
    assert got.columns == odd.columns and got.count() == len(ODD_TEXTS) + 1
    assert QUERIES["op8_near_lines"](spark, save(empty_documents(spark), tmp_path / "none")).count() == 0


def test_plan_has_no_python(spark, sf):
    plan = L.line_digests(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_drops_equal_short_lines(spark):
    import corpus_pipeline

    line = "a line of twenty or more characters"
    rows = [(1, f"Of.\n\n{line}\nOf."), (2, f"Of.\nOn.\n \n{line}s\n\n漢"), (3, " \n漢\nNo."), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: f"Of.\n\n{line}", 2: "On.\n \n\n漢", 3: " \nNo.", 4: None}


def brute_growing(rows):
    """Each document's text without lines that an equal or near one stands before: edits by the shorter line's length."""
    seen, out = [], {}
    for key, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            allowed = [(s, max((e for low, e in L.GROWING if min(len(line), len(s)) >= low), default=0)) for s in seen]
            if not any(abs(len(line) - len(s)) <= e and distance(line, s) <= e for s, e in allowed):
                kept.append(line)
            seen.append(line)
        out[key] = "\n".join(kept)
    return out


def test_pipeline_allows_more_edits_in_longer_lines(spark):
    import corpus_pipeline

    rng = random.Random(8)
    bases = ["".join(rng.choices("abcdefgh ", k=k)) for k in (18, 20, 21, 38, 39, 40, 41, 42, 57, 59, 60, 61, 63, 90, 200)]
    rows = [(i, "\n".join(edited(rng, rng.choice(bases), rng.randrange(5)) for _ in range(rng.randrange(1, 8)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_growing(rows)
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == want
    one = {r.doc_id: r.text for r in L.deduplicated(docs, short=True).collect()}
    assert sum(map(len, one.values())) > sum(map(len, want.values()))



def test_many_lines_that_share_a_segment(spark):
    """Ten thousand numbered lines: near are those that an earlier one differs from in one digit."""
    from collections import Counter

    rng = random.Random(5)
    numbers = rng.sample(range(100_000), 10_000)
    lines = [f"Entry number {i:05d} of the register of births and deaths" for i in numbers]
    docs = [(k, "\n".join(lines[100 * k : 100 * k + 100])) for k in range(100)]
    seen, want = set(), Counter()
    for at, number in enumerate(numbers):
        digits = f"{number:05d}"
        near = any(digits[:i] + d + digits[i + 1 :] in seen for i in range(5) for d in "0123456789")
        want[at // 100] += near
        seen.add(digits)
    got = {r.doc_id: r.n_removed for r in L.line_digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: want[k] for k in range(100)} and sum(got.values()) > 1000


@pytest.mark.parametrize("threshold", [1, 3])
def test_large_lists_are_split_without_loss(spark, threshold):
    rng = random.Random(threshold)
    frame = "abcdefgh" * 3
    lines = []
    for _ in range(150):
        at = rng.randrange(len(frame) - 6)
        lines.append(frame[:at] + "".join(rng.choices("xyz", k=rng.randrange(3, 6))) + frame[at + 4 :])
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(50)]
    was, L.SMALL = L.SMALL, 4
    try:
        got = found(L.line_digests(spark.createDataFrame(rows, "doc_id long, text string"), threshold))
    finally:
        L.SMALL = was
    assert got == brute(rows, threshold)


def test_near_copies_with_too_many_edits_give_few_rows(spark, monkeypatch):
    """A group of long lines that share most segments and differ by some words: no table grows much beyond the lists' entries."""
    rng = random.Random(77)
    base = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(50))
    lines = []
    for _ in range(400):
        own = base.split(" ")
        for at in rng.sample(range(len(own)), 2):
            own[at] += "".join(rng.choices("abcdefghij", k=4))
        lines.append(" ".join(own))
    lines += [edited(rng, rng.choice(lines), rng.randrange(1, 6)) for _ in range(100)]
    rows = [(i, "\n".join(lines[10 * i : 10 * i + 10])) for i in range(50)]
    made, plain = [], L.stored

    def counted(df):
        out = plain(df)
        made.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(L, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in L.deduplicated(docs, L.GROWING, short=True).collect()}
    entries = next(n for names, n in made if names == ["id", "list", "listed", "first"])
    assert max(n for _, n in made) <= 1.5 * entries
    seen, want = [], {}
    for key, text in rows:
        kept = []
        for line in text.split("\n"):
            if not any(closer(line, s) for s in seen):
                kept.append(line)
            seen.append(line)
        want[key] = "\n".join(kept)
    assert got == want and sum(map(len, want.values())) < sum(len(text) for _, text in rows)


def closer(a, b, most=3):
    """Whether two strings are within ``most`` edits, by the places that each number of edits leads to."""
    if abs(len(a) - len(b)) > most:
        return False
    reached = {(0, 0)}
    for _ in range(most + 1):
        ends = set()
        for i, j in reached:
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            ends.add((i, j))
        if (len(a), len(b)) in ends:
            return True
        reached = {(i + x, j + y) for i, j in ends for x, y in ((1, 1), (1, 0), (0, 1)) if i + x <= len(a) and j + y <= len(b)}
    return False


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_sketches_let_near_lines_through(spark, edits):
    rng = random.Random(30 + edits)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices("abcdé漢", k=rng.randrange(4, 60)))
        pairs.append((a, edited(rng, a, rng.randrange(edits + 1))))
    pairs += [("abcdefghijklmnop", "ponmlkjihgfedcba"), ("abcdefghijklmnop", "qrstuvwxyzABCDEF")]
    side = lambda c: F.struct(F.length(c).alias("size"), F.lit(edits).alias("most"), L.sketch(F.col(c)).alias("sketch"))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", side("a").alias("x"), side("b").alias("y"))
    got = df.select(L.may_be_near("x", "y", edits).alias("open")).collect()
    assert all(r.open for r in got[:-2]) and not any(r.open for r in got[-2:])


def test_very_long_documents_and_ties(spark):
    line = "a line of twenty or more characters"
    rows = [(5, "\n".join([line] * 100_000)), (None, f"{line}\nshort"), (7, f"{line} one\nkept line that is long enough"), (7, f"{line} one\nanother kept line that is long"), (7, f"{line} one\nkept line that is long enough"), (8, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_lines, r.n_removed) for r in L.line_digests(docs).collect()))
    ties = [g for g in got if g[0] == 7]
    assert [g for g in got if g[0] != 7] == [(0, 2, 0), (5, 100_000, 100_000), (8, 1, 0)]
    assert len(ties) == 3 and sorted(t[2] for t in ties) in ([0, 0, 1], [0, 1, 1])  # equal rows keep the same lines; the other text of that id comes before or after
