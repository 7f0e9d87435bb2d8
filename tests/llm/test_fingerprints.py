import hashlib
import random

import numpy as np

from quirespark.llm import fingerprints as E
from quirespark.llm.queries import QUERIES

from .util import empty_documents, odd_documents, save


def walk(text):
    """The embedding step by step, as it is defined."""
    moves = (E.mixed(np.arange(E.PERIOD * E.CLASSES), 1) & np.uint64(1)).reshape(E.PERIOD, E.CLASSES)
    shown, j = [], 0
    for c in text:
        k = ((((ord(c) + 1) * 2654435761) & 0xFFFFFFFF) >> 16) & 0xFF
        while True:
            shown.append(k)
            j += 1
            if moves[(j - 1) % E.PERIOD, k]:
                break
    return shown


def test_samples_are_those_of_the_walk():
    rng = random.Random(1)
    for n in (1, 5, 300, 3000):
        text = "".join(rng.choices("abc é漢\n", k=n))
        shown = walk(text)
        level, bits = E._parsed(E.fingerprint(text))
        at = [a for a in E.sample_steps(level).tolist() if a < len(shown)]
        assert len(at) == len(bits) and (len(shown) < 512 or 256 <= len(at) <= 512)
        assert bits.tolist() == [int(E.mixed(np.array([a * 256 + shown[a]]), 3)[0] & np.uint64(1)) for a in at]


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghij klmnop", k=4000))
    other = "".join(rng.choices("abcdefghij klmnop", k=4000))
    few = text[:1000] + "X" + text[1001:2000] + text[2001:]
    a = E.fingerprint(text)
    assert E.likeness(a, a) == 1 and E.likeness(a, E.fingerprint(few)) > 0.8 and E.likeness(a, E.fingerprint(other)) < 0.25
    assert 0.6 < E.likeness(a, E.fingerprint(text[:3000] + other[:1000])) < 0.95
    assert E.likeness("000000", "000000") == 1 and E.likeness("000000", a) == 0


def brute(rows):
    rows = sorted(((k is not None, k or 0, t or ""), k, t or "") for k, t in rows)
    for i, (_, key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        other = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, b, c = map(E.fingerprint, (text, other, after))
        yield key, len(text), hashlib.sha256(other.encode()).hexdigest(), a, b, E.likeness(a, b), E.likeness(a, c)


def test_query(spark, sf, tmp_path):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for folder in (sf, save(odd_documents(spark), tmp_path / "odd"), save(empty_documents(spark), tmp_path / "none")):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        found = QUERIES["op1_edit_fingerprints"](spark, folder)
        assert found.columns == names
        assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_near_copies_meet_the_least_id(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefghij klmnop", k=2000))
    rows = [(i, base[: 100 * i] + "Q" + base[100 * i + 1 :]) for i in range(1, 6)] + [(9, "".join(rng.choices("xyz w", k=2000)))]
    prints = E.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.representative, r.doc_id) for r in E.near_copies(prints, at_least=0.5).collect()}
    # the walks of two texts meet again after a random time, so that a copy may be missed
    assert {b for _, b in found} <= {2, 3, 4, 5} and len({b for _, b in found}) >= 3 and all(a < b for a, b in found)


def flipped(rng, bits, share):
    out = bits.copy()
    at = rng.sample(range(len(bits)), int(len(bits) * share))
    out[at] ^= 1
    return out


def written(level, bits):
    return f"{level:02x}{len(bits):04x}{np.packbits(bits).tobytes().hex()}"


def test_near_copies_beyond_the_least_id_of_a_band(spark, monkeypatch):
    rng = random.Random(6)
    one, two = (np.array(rng.choices((0, 1), k=400), np.uint8) for _ in range(2))
    two[:8] = one[:8]
    rows = [(1, written(3, one)), (2, written(3, two)), (3, written(3, two))]
    monkeypatch.setattr(E, "band_keys", lambda value, width, bands: np.array([7]))  # all in one band, whose least id is unlike the others
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    assert [(r.representative, r.doc_id) for r in E.near_copies(prints).collect()] == [(2, 3)]


def test_neighbouring_levels_share_bands():
    rng = random.Random(7)
    fine = np.array(rng.choices((0, 1), k=510), np.uint8)
    at = E.finer(np.arange(512), 5)
    coarse = np.concatenate([fine[at[at < 510]], np.array(rng.choices((0, 1), k=3), np.uint8)])
    a, b = written(4, fine), written(5, coarse)
    assert E.likeness(a, b) > 0.8 and len(np.intersect1d(E.band_keys(a, 24, 40), E.band_keys(b, 24, 40)))


def test_bands_reach_their_recall():
    rng = random.Random(9)
    bands, met = E.band_count(24, 0.8, 0.99), 0
    for _ in range(300):
        bits = np.array(rng.choices((0, 1), k=rng.randrange(257, 513)), np.uint8)
        met += bool(len(np.intersect1d(E.band_keys(written(2, bits), 24, bands), E.band_keys(written(2, flipped(rng, bits, 0.1)), 24, bands))))
    assert met >= 280
    assert not len(E.band_keys("000000", 24, bands))
