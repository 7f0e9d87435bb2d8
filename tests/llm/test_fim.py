import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import fim

from .util import ODD_TEXTS, empty_documents, odd_documents

TEXTS = [*ODD_TEXTS, "has <P> inside", "a<S>", "<M", " \t x", "x \n", "<<P", "ends with <", "wort " * 5000, "é" * 9000 + " 漢字 " * 3000, " " * 10_000, "\x0b\x0cword\x1fother"]


def rows(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("rate", [50, 100])
def test_against_lists_of_tokens(spark, rate, monkeypatch):
    monkeypatch.setattr(fim, "RATE", rate)
    texts = TEXTS * 9  # under nine ids each
    made = fim.transformed(rows(spark, texts), rate=rate)
    got = {r.doc_id: tuple(r)[1:] for r in made.collect()}
    assert got == {i: fim.brute(i, t) for i, t in enumerate(texts)}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}
    digests = {r.doc_id: r for r in fim.form_digests(made).collect()}
    for i, t in enumerate(texts):
        assert digests[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert digests[i].output_sha256 == hashlib.sha256(got[i][4].encode()).hexdigest()


def test_small_chunks(spark, monkeypatch):
    """Cuts that lie on, before and behind the borders of chunks."""
    import numpy as np

    monkeypatch.setattr(fim, "CHUNK", 4)
    data = np.frombuffer("ab  cd é f  gh12345678 x ".encode() + b"next one", np.uint8)
    borders = np.array([0, 26, 26, 34])
    starts, before = fim.chunked(borders, 4)
    assert before.tolist() == [0, 7, 7, 9] and starts.tolist() == [0, 4, 8, 12, 16, 20, 24, 26, 30]
    pairs, _ = fim.counted(data, borders, starts)
    text = data[:26].tobytes()
    want = [i + 1 for i in range(25) if not text[i : i + 1].isspace() and text[i + 1 : i + 2].isspace()]
    for rank, place in enumerate(want):
        own = int(np.searchsorted(pairs[1:8], rank + 1))
        assert fim.located(data, 26, int(starts[own]), rank - int(pairs[own])) == place
    assert pairs[7] == len(want) and pairs[9] - pairs[7] == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢\n\t<P>SM", max_size=60), min_size=1, max_size=6))
def test_borders_of_any_texts(texts):
    import numpy as np

    data = "".join(texts).encode()
    borders = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for chunk in (1, 3, 64):
        starts, before = fim.chunked(borders, chunk)
        pairs, points = fim.counted(np.frombuffer(data, np.uint8), borders, starts)
        for i, t in enumerate(texts):
            assert pairs[before[i + 1]] - pairs[before[i]] + bool(t) == fim.brute(None, t)[0]
            assert points[before[i + 1]] - points[before[i]] == len(t)


def test_odd_and_empty_tables(spark):
    odd = fim.transformed(odd_documents(spark)).collect()
    assert len(odd) == len(ODD_TEXTS) + 1
    assert fim.form_digests(fim.transformed(empty_documents(spark))).collect() == []
    null = fim.transformed(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in null) == sorted([fim.brute(None, "a b"), fim.brute(None, None)])
