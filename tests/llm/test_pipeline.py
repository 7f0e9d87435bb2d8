import base64
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quirespark.llm.queries import tokenizer

from .util import empty_documents, odd_documents, save


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    for docs in (odd_documents(spark), empty_documents(spark)):
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            folder = save(stage(spark, docs, ""), tmp_path / f"{name}-{id(columns)}")
            docs = spark.read.parquet(f"{folder}/documents.parquet")
            assert i == 4 or docs.columns == columns
        assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_whole_run(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    for r in rows[:50]:
        text = own.decode_bytes(r.ids)
        assert hashlib.sha256(text).hexdigest() == r.decoded_sha256 and own.encode_ordinary(text.decode()) == r.ids


def lines_by_hand(rows):
    """Texts without the lines that an equal or near line stands before; distances by DuckDB, over all pairs of distinct lines."""
    import duckdb
    import pandas as pd

    from quirespark.llm import lines as L

    first, counted = {}, {}
    for key, text in sorted(rows):
        for at, line in enumerate(text.split("\n")):
            if len(line) >= L.SHORTEST or line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (key, at))
                counted[key, at] = line
    long = pd.DataFrame([(i, line, len(line)) for i, line in enumerate(first) if len(line) >= L.SHORTEST], columns=["i", "line", "n"])
    edits = "CASE " + " ".join(f"WHEN a.n >= {low} THEN {e}" for low, e in reversed(L.GROWING)) + " ELSE 0 END"  # a is the shorter one
    pairs = duckdb.sql(f"SELECT a.line, b.line FROM long a JOIN long b ON b.n BETWEEN a.n AND a.n + 3 AND a.i <> b.i WHERE b.n - a.n <= {edits} AND levenshtein(a.line, b.line) <= {edits}").fetchall()
    near = {max(p, key=first.__getitem__) for p in pairs}
    out = {}
    for key, text in rows:
        kept = [line for at, line in enumerate(text.split("\n")) if (key, at) not in counted or (first[line] == (key, at) and line not in near)]
        out[key] = "\n".join(kept)
    return out


def copies_by_hand(spark, rows, weights=(3, 1, 2), share=1.5, most=2.0, seed=17):
    """How often fair queueing takes each ``(id, text, source)``; only the hash that shuffles is the operator's."""
    import math
    import re

    from pyspark.sql import functions as F

    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    heavy = {s: weights[i % 3] for i, s in enumerate(sources)}
    full, budget = set(), share * sum(total.values())
    while True:
        free = [s for s in sources if s not in full]
        level = (budget - sum(most * total[s] for s in full)) / sum(heavy[s] for s in free) if free else 0.0
        over = {s for s in free if heavy[s] * level > most * total[s]}
        if not over:
            break
        full |= over
    target = {s: most * total[s] if s in full else heavy[s] * level for s in sources}
    passes = spark.createDataFrame([(k, t, p) for k, t, _ in rows for p in range(3)], "k long, t string, p int")
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("p"), F.col("k").cast("string"), F.xxhash64("t")), 33)
    place = {(r.k, r.p): r.h for r in passes.select("k", "p", spot.alias("h")).collect()}
    served = []
    for s in sources:
        before = 0
        for p in range(math.ceil(target[s] / total[s]) if total[s] else 0):
            for k in sorted((k for k, _, x in rows if x == s and size[k]), key=lambda k: (place[k, p], k)):
                taken = min(size[k], math.floor(target[s]) - before)
                if taken > 0:
                    served.append((min(1.0, (before + size[k]) / target[s]), k, p, taken))
                before += size[k]
    at, out = 0, {}
    for _, k, _, taken in sorted(served):
        taken = min(taken, int(budget) - at)
        at += taken
        if taken > 0 and 2 * taken >= size[k]:
            out[k] = out.get(k, 0) + 1
    return out


def test_run_equals_stages_by_hand(spark, sf, tmp_path):
    """Every row of the run against brute force, stage by stage; the language model that is fitted is taken as given."""
    from quirespark.llm import jaccard, langid

    more = [(100_000 + i, t, None, "src1", len(t)) for i, t in enumerate(["12 345 - 6", "...\n\n", "7" * 900])]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    long = max((line for r in table.collect() for line in r.text.split("\n")), key=len)  # copies that differ in a long word
    more += [(200_000 + i, f"{long[: 300 * i]} {'abcdefgh'[i:] * 2} {long[300 * i :]}", "en", None, 0) for i in range(3)]
    folder = save(table.unionByName(spark.createDataFrame(more, table.schema)), tmp_path / "in")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    model = langid.train(table)
    found = {k: model.predict(r.text) for k, r in docs.items()}
    told = sorted((k, docs[k].text) for k, (lang, score) in found.items() if lang != "und" and score >= 0.3)
    texts = lines_by_hand(told)
    alone = {k for k, _, component in jaccard.brute(sorted(texts.items()), 5, 80) if k == component}
    kept = [(k, texts[k], docs[k].source) for k in sorted(alone)]
    assert len(docs) > len(told) > len(alone) > 50 and sum(map(len, texts.values())) < sum(len(t) for _, t in told)
    copies = copies_by_hand(spark, kept)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((k, tuple(own.encode_ordinary(t))) for k, t, _ in kept for _ in range(copies.get(k, 0)))
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_null_ids_ties_and_stored_folders(spark):
    import os

    from quirespark import scratch

    rows = [(None, "the same short text of a few words here", "en", "a"), (None, "another text without an id, of more words", "en", None), (3, "a tie of two texts with the id three", "en", "a"), (3, "das ist ein anderer Text mit der Nummer drei", "de", "a"), (3, "a tie of two texts with the id three", "en", "a"), (4, None, None, None), (5, "", "en", "b")]
    docs = spark.createDataFrame(rows * 4, "doc_id long, text string, lang string, source string")
    with scratch.scratch(spark) as made:
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = scratch.stored(stage(spark, docs, ""))
            assert docs.columns == (["doc_id", "text", "lang", "source"] if i < 4 else ["doc_id", "n_tokens", "ids", "decoded_sha256"])
            assert docs.count() > 0
        folders = [p.removeprefix("file:") for p in made]
        assert len(folders) > 20 and 0 < sum(map(os.path.isdir, folders)) < 20  # those of a stage go when a later one begins
    assert not any(map(os.path.exists, folders))


def test_interleaved_runs_keep_their_tables(spark, sf, tmp_path):
    """A later stage of one run leaves alone what another run's earlier stage has stored and not yet written."""
    (_, dedup), (_, join) = corpus_pipeline.STAGES[1:3]
    table = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    first = dedup(spark, table, str(tmp_path / "a"))
    other = spark.createDataFrame([(1, "some words of the other run here", "en", "s", 1)], table.schema)
    assert join(spark, other, str(tmp_path / "b")).count() == 1
    assert first.count() == table.count()
