import random

import numpy as np

from quirespark.llm import debruijn as D
from quirespark.llm import wordhash as H
from quirespark.llm.queries import QUERIES

from .util import ODD_TEXTS, empty_documents, odd_documents, save


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))


def texts(rng):
    """Documents that share, overlap, repeat and slightly change passages of a few words."""
    words = [f"w{i}" for i in range(30)] + ["é", "漢"]
    pool = [rng.choices(words, k=rng.randrange(15, 70)) for _ in range(12)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += p[a : rng.randrange(a, len(p)) + 1] if rng.random() < 0.5 else p
            parts += rng.choices(words, k=rng.randrange(0, 10))
        if rng.random() < 0.3:
            parts[rng.randrange(len(parts))] = "changed"
        out.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return [*out, "a " * 500, "a b " * 400, "", None, " ".join(pool[0][:19]), " ".join(pool[0])]


def test_shared_passages_equal_brute_force(spark):
    rows = list(enumerate(texts(random.Random(11))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(D.removal_digests(D.without_repeats(df))) == D.brute(rows)
    assert found(D.removal_digests(D.without_repeats(df, window=6, node=3))) == D.brute(rows, 6)


def test_long_documents_are_hashed_as_a_whole(monkeypatch):
    text = ("one two three  " * 3000 + "x" * 5000 + " y").encode()
    data = np.frombuffer(text, np.uint8)
    whole, _ = H.words(data, np.array([0, len(data)]))
    monkeypatch.setattr(H, "SLAB", 1000)
    cut, before = H.words(data, np.array([0, len(data)]))
    assert np.array_equal(whole, cut) and before.tolist() == [0, 9002]


def test_query(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op3_repeated_passages"](spark, sf)) == D.brute(rows)
    odd = QUERIES["op3_repeated_passages"](spark, save(odd_documents(spark), tmp_path / "odd"))
    assert odd.count() == len(ODD_TEXTS) + 1
    assert found(QUERIES["op3_repeated_passages"](spark, save(empty_documents(spark), tmp_path / "none"))) == []


def test_branching_paths_and_many_contexts(spark):
    """A passage in 1,500 contexts, and passages that part and meet again."""
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(10**9)}"
    common = [word() for _ in range(45)]
    left, right, middle = [[word() for _ in range(60)] for _ in range(3)]
    rows = [(i, " ".join([word() for _ in range(5)] + common + [word() for _ in range(4)])) for i in range(1500)]
    forks = [left + middle + right, left[10:] + middle, middle + right[:40], left + [word()] + middle, middle[:30] + right, right + right, middle + middle]
    rows += [(2000 + i, " ".join(x)) for i, x in enumerate(forks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(D.removal_digests(D.without_repeats(docs)))
    assert got == D.brute(rows) and [r[2] for r in got[:1500]] == [0] + [45] * 1499


def test_long_repeats_are_few_paths(spark):
    """What two documents share without a branch is one path, however long; a third that has half of it makes it two."""
    rng = random.Random(6)
    passage = [f"u{rng.randrange(10**9)}" for _ in range(3000)]
    rows = [(1, " ".join(["a"] * 3 + passage)), (2, " ".join(["b"] * 7 + passage + ["c"]))]
    edge = "edge long, other long, doc long, text_hash long, low int, high int, n long, prior long, priors long, after long, afters long"
    chain = [(k, -k, 1, 0, 5 * k, 5 * k + 4, 2, k - 1, k - 1, k + 1, k + 1) for k in range(2, 100)]
    chain += [(1, -1, 1, 0, 5, 9, 2, 0, 7777, 2, 2), (100, -100, 1, 0, 500, 502, 2, 99, 99, 0, 0)]
    ends = sorted((r.edge, r.path, r.shift, r.words, r.end) for r in D.paths(spark.createDataFrame(chain, edge)).collect())
    assert ends == [(1, 1, 0, 495 + 2 + 20, 1), (100, 1, 495, 495 + 2 + 20, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[2] for r in found(D.removal_digests(D.without_repeats(docs)))] == [0, 3000]
    more = [*rows, (3, " ".join(passage[1500:]))]
    assert found(D.removal_digests(D.without_repeats(spark.createDataFrame(more, "doc_id long, text string")))) == D.brute(more)


def test_null_ids_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, f"{text} more"), (5, f"x {text}"), (5, f"x {text}"), (9, "short"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in D.without_repeats(docs).collect())
    null = [g for g in got if g[0] == -1]  # the two texts without an id stand in order of a hash
    assert sorted(null) in ([(-1, 40, 0), (-1, 41, 40)], [(-1, 40, 40), (-1, 41, 0)])
    assert got[2:] == [(5, 41, 40), (5, 41, 40), (9, 0, 0), (9, 1, 0)]
