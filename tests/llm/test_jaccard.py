import random

import pytest

from quirespark.llm import jaccard as J
from quirespark.llm.queries import QUERIES

from .util import ODD_TEXTS, empty_documents, odd_documents, save


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def texts(rng, sizes, copies):
    """Groups of texts whose members differ from a base by a few words, so that they link in chains."""
    out = []
    for size in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25) + 1)):
                at = rng.randrange(len(own))
                how = rng.randrange(3)
                if how == 0:
                    own[at] = f"x{rng.randrange(10**6)}"
                elif how == 1:
                    own.insert(at, f"y{rng.randrange(10**6)}")
                elif len(own) > 1:
                    del own[at]
            if rng.random() < 0.2:
                own = [w.upper() for w in own]
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    made = texts(rng, [1, 2, 3, 8, 11, 12, 13, 19, 20, 21, 22, 23, 30, 41, 60, 75, 105, 150, 151, 210, 300], 14)
    made += [None, "", " ", "a b", "A B", "a b c " * 50]
    rng.shuffle(made)
    rows = list(enumerate(made))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = J.brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 50
    assert found(J.document_groups(df)) == want
    stay = {r.doc_id for r in J.one_of_each(df).collect()}
    assert stay == {c for _, _, c in want}


def test_query(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op6_shingle_groups"](spark, sf)) == J.brute(rows)
    odd = odd_documents(spark)
    got = QUERIES["op6_shingle_groups"](spark, save(odd, tmp_path / "odd"))
    assert got.count() == len(ODD_TEXTS) + 1 and {r.component_id for r in got.collect() if r.doc_id in (5, 6)} == {5}
    assert J.one_of_each(odd).columns == odd.columns and J.one_of_each(odd).count() == len(ODD_TEXTS) - 1
    assert found(QUERIES["op6_shingle_groups"](spark, save(empty_documents(spark), tmp_path / "none"))) == []


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (2, 60)])
def test_other_contracts_equal_brute_force(spark, shingle, percent):
    rng = random.Random(shingle)
    made = texts(rng, [1, 4, 5, 6, 8, 9, 10, 12, 13, 14, 17, 21, 30, 41, 60, 105, 210], 12)
    made += [None, "", " ", "a b c d", "A B c d", "a b c d e " * 50]
    rng.shuffle(made)
    rows = list(enumerate(made))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    contract, want = J.Contract(shingle, percent), J.brute(rows, shingle, percent)
    assert len({c for _, _, c in want}) < len(rows) - 50 and want != J.brute(rows, shingle, 90)
    assert found(J.document_groups(df, contract=contract)) == want
    for boundary in contract.boundaries:  # whichever is cheaper here
        linked = J.components(J.links(J.keyed(df, "doc_id", "text"), boundary, contract))
        groups = linked.groupBy("component").count().count()
        assert groups == sum(n > 1 for n in _sizes(rows, shingle, percent))


def _sizes(rows, shingle, percent):
    """Numbers of different sets in each component."""
    own = {}
    for key, text in rows:
        w = (text or "").lower().split()
        own[key] = frozenset(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    members = {}
    for key, n, component in J.brute(rows, shingle, percent):
        if n:
            members.setdefault(component, set()).add(own[key])
    return map(len, members.values())


def test_pipeline_drops_near_copies_at_five_words(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    other = [*base[:20], "x", *base[21:60], "y", *base[61:]]  # 86 of 106 shingles of five words, 0.81; of three 0.88
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "one of its own kind and no other")], "doc_id long, text string")
    assert J.brute([tuple(r) for r in docs.collect()]) == [(1, 98, 1), (2, 98, 2), (3, 6, 3)]
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [1, 3]
