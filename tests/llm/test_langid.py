import collections
import math
import random
import zlib

import numpy as np
import pytest

from quirespark.llm import langid as L
from quirespark.llm.queries import QUERIES

from .util import ODD_TEXTS, empty_documents, odd_documents, save


def test_counts_are_those_of_every_n_gram():
    for text in ("", "a", "aé", "Abc abc abc漢字", "xy" * 50):
        at, number = L.counts(text)
        assert number.sum() == sum(max(0, len(text) - n + 1) for n in (1, 2, 3))
    long = "the quick brown fox é " * 200
    whole = L.counts(long)
    was, L.SLICE = L.SLICE, 100
    cut = L.counts(long)
    L.SLICE = was
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op7_language"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    hits = collections.Counter((r.score > 0.9, r.lang_pred == r.lang) for r in out)
    assert hits[True, True] >= 0.9 * (hits[True, True] + hits[True, False])


def test_odd_and_empty_tables(spark, tmp_path):
    rows = {r.doc_id: r for r in QUERIES["op7_language"](spark, save(odd_documents(spark), tmp_path / "odd")).collect()}
    assert len(rows) == len(ODD_TEXTS)
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in range(4))
    assert QUERIES["op7_language"](spark, save(empty_documents(spark), tmp_path / "none")).count() == 0
    docs = odd_documents(spark)
    assert L.accepted(docs).columns == docs.columns


def test_weights_are_sparse():
    rng = np.random.default_rng(1)
    rows = [(i % 2, np.unique(rng.integers(0, 500, 40)), None) for i in range(200)]
    rows = [(y, np.append(at, 600 + y), np.full(len(at) + 1, 1 / np.sqrt(len(at) + 1))) for y, at, _ in rows]
    weights, bias = L.fit(rows, 2)
    assert (weights == 0).mean() > 0.9
    assert all((weights[:, at] @ value + bias).argmax() == y for y, at, value in rows)


def plain_bucket(gram):
    """The bucket of an n-gram's code points, with Python's integers."""
    word = (1 << 32) - 1
    value = ord(gram[0]) * 0x9E3779B1 & word
    for c in gram[1:]:
        value = ((value ^ value >> 15) * 0x85EBCA6B + ord(c) * 0x9E3779B1) & word
    return (((value ^ value >> 16) * 0xC2B2AE35) & word) >> 18


def plain_vector(text, idf):
    lower = text.lower()
    counted = collections.Counter(plain_bucket(lower[i : i + n]) for n in (1, 2, 3) for i in range(len(lower) - n + 1))
    value = {b: (1 + math.log(k)) * idf[b] for b, k in counted.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    return {b: v / norm for b, v in value.items()}


def plain_fit(rows, classes, seed=7):
    """Follow the regularised leader with dictionaries, a row at a time; the bias is one more feature that is always 1."""
    z, n = [collections.defaultdict(float) for _ in range(classes)], [collections.defaultdict(float) for _ in range(classes)]

    def weight(c, b):
        if abs(z[c][b]) <= L.L1:
            return 0.0
        return -(z[c][b] - math.copysign(L.L1, z[c][b])) / ((L.BETA + math.sqrt(n[c][b])) / L.ALPHA + L.L2)

    def chances(vector):
        scores = [sum(weight(c, b) * v for b, v in vector.items()) for c in range(classes)]
        high = max(scores)
        e = [math.exp(s - high) for s in scores]
        return scores, [x / sum(e) for x in e]

    rng = np.random.default_rng(seed)
    for _ in range(L.EPOCHS):
        for i in rng.permutation(len(rows)):
            label, vector = rows[i]
            vector = {**vector, "bias": 1.0}
            _, p = chances(vector)
            steps = []
            for c in range(classes):
                for b, v in vector.items():
                    g = (p[c] - (c == label)) * v
                    steps.append((c, b, g, weight(c, b)))
            for c, b, g, w in steps:
                z[c][b] += g - (math.sqrt(n[c][b] + g * g) - math.sqrt(n[c][b])) / L.ALPHA * w
                n[c][b] += g * g
    return chances


def test_model_equals_plain_python(spark):
    """Document frequencies, vectors, fit, temperature and scores again, without arrays; all rows are in the sample here."""
    texts = {"en": "the cat sat on the mat and the dog ran to it", "de": "der Hund läuft über die große Straße und schläft", "es": "el niño come la manzana y la niña mañana también"}
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(texts))
        words = texts[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12))), lang if i % 9 else None))
    rows += [(100, "", "en"), (101, None, "de"), (102, "123 ...", None), (None, "der große Hund", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learnt = [(str(k) if k is not None else "", t or "", lang) for k, t, lang in rows if zlib.crc32(("" if k is None else str(k)).encode()) % 4 != 2 and lang is not None]
    seen = collections.Counter(b for _, t, _ in learnt for b in {plain_bucket(t.lower()[i : i + n]) for n in (1, 2, 3) for i in range(len(t.lower()) - n + 1)})
    idf = collections.defaultdict(lambda: math.log(1 + len(learnt)) + 1, {b: math.log((1 + len(learnt)) / (1 + k)) + 1 for b, k in seen.items()})
    languages = sorted({lang for _, _, lang in learnt})
    vectors = [(languages.index(lang), plain_vector(t, idf)) for _, t, lang in sorted(learnt, key=lambda r: (r[0], r[2]))]
    chances = plain_fit([v for i, v in enumerate(vectors) if i % 5], len(languages))
    calibration = [(label, chances({**v, "bias": 1.0})[0]) for i, (label, v) in enumerate(vectors) if not i % 5]

    def loss(t):
        return sum(-math.log(max(1e-12, math.exp(s[y] / t - max(s) / t) / sum(math.exp(x / t - max(s) / t) for x in s))) for y, s in calibration)

    t = min((math.exp(math.log(0.02) + i * (math.log(10) - math.log(0.02)) / 119) for i in range(120)), key=loss)
    got = {r.doc_id: r for r in L.predicted(docs).collect()}
    for key, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
            continue
        scores, _ = chances({**plain_vector(text, idf), "bias": 1.0})
        e = [math.exp((s - max(scores)) / t) for s in scores]
        best = max(range(len(e)), key=e.__getitem__)
        assert got[key].lang_pred == languages[best] and abs(got[key].score - e[best] / sum(e)) < 1e-6


def test_too_many_languages(spark):
    was, L.LANGUAGES = L.LANGUAGES, 2
    try:
        with pytest.raises(ValueError):
            L.train(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(12)], "doc_id long, text string, lang string"))
    finally:
        L.LANGUAGES = was
