import collections
import re

import pytest

from quirespark.llm import mixing
from quirespark.llm.queries import QUERIES

from .util import empty_documents, odd_documents, save


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    """Targets by hand: the excess is shared again until none is above."""
    sizes = collections.Counter()
    for source, text in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, free, out = 1.5 * sum(sizes.values()), list(order), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            free.remove(s)
    return sizes, out


@pytest.mark.parametrize("rows_per_bucket", [8192, 3])
def test_query(spark, sf, tmp_path, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_per_bucket)
    for folder in (sf, save(odd_documents(spark), tmp_path / "odd")):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        sizes, target = targets([(r.source, r.text) for r in docs])
        found = QUERIES["op4_fair_mix"](spark, folder).collect()
        assert len(found) == len(docs)
        source = {r.doc_id: r.source for r in docs}
        text = {r.doc_id: r.text for r in docs}
        taken = collections.Counter()
        for r in found:
            s = source[r.doc_id]
            assert r.size == size(text[r.doc_id]) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
            assert 0 <= r.taken <= 2 * r.size
            taken[s] += r.taken
        assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
        again = QUERIES["op4_fair_mix"](spark, folder).collect()
        assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_is_in_order_of_finish(spark, sf):
    rows, mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    got = mixed.orderBy("at").collect()
    at = 0
    for a, b in zip(got, got[1:]):
        assert a.at == at and a.finish <= b.finish
        at += a.taken


def test_empty_table(spark, tmp_path):
    assert QUERIES["op4_fair_mix"](spark, save(empty_documents(spark), tmp_path / "none")).count() == 0


def test_rows_keep_their_columns(spark):
    docs = odd_documents(spark)
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert got.count() >= 1
