import hashlib
import zlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quirespark.llm import alignment
from quirespark.llm.queries import tokenizer

from .util import ODD_TEXTS, empty_documents, odd_documents

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
TEXTS = [
    *ODD_TEXTS,
    "plain words, with more words\nand lines\r\n\r\nthat end \t in tabs 　 wide　 blanks   ",
    "code {\r  return x;\r}\r\n\tindent\x0b\x0c \x1c x",
    "▁ is read as a blank",
    "x▁y",
    "<s> </s> <unk> <0x0A> <|endoftext|>",
    "emoji 🙂🙂👩‍👩‍👧 漢字かな é é ﬁ",
    " starts with a blank",
    "  two",
    "\nstarts with a line",
    "x" * 70_000 + " y",
    "0123456789" * 30 + " 1 22 333",
    "the cat\x00sat",
    "a b a b a b, the the the",
]


def brute(rows):
    """The contract, with whole texts and the libraries themselves."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(code): byte for byte, code in alignment.byte_alphabet().items()}
    linked, count = [], Counter()
    for _, text in rows:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            linked.append(([], [], [], []))
            continue

        def ranges(tokens):
            out, at = [], 0
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            return out

        ra, rb = ranges(bytes_a), ranges(bytes_b)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, r in zip(ids_a, ra) if low < r[1] <= e) + "|" + ",".join(str(i) for i, r in zip(ids_b, rb) if low < r[1] <= e)) if len(text) < 5000 else None
            low = e
        pairs, j = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[j][1] <= s:
                j += 1
            k = j
            while k < len(rb) and rb[k][0] < e:
                pairs.append((ids_a[i], ids_b[k]))
                k += 1
        count.update(set(pairs))
        linked.append((ids_a, ids_b, groups if len(text) < 5000 else len(ends), pairs))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (key, _), (ids_a, ids_b, groups, pairs) in zip(rows, linked):
        digest = None if isinstance(groups, int) else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        number = groups if isinstance(groups, int) else len(groups)
        out.append((key, len(ids_a), len(ids_b), number, len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


def digests(df, **options):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        a, b = f.read(), g.read()
    size = sentencepiece.SentencePieceProcessor(model_file=B).get_piece_size()
    return [tuple(r) for r in alignment.alignment_digests(df, a, b, size, **options).collect()]


def by_key(rows):
    return sorted(rows, key=repr)


def compare(got, rows):
    want = brute(rows)
    unknown = {w[:-1] for w in want if w[-1] is None}  # long texts: without the digest
    assert by_key(g[:-1] + (None,) if g[:-1] in unknown else g for g in got) == by_key(want)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20, 0])
def test_against_the_libraries(spark, frequent):
    rows = [*enumerate(TEXTS), (None, "the cat sat"), (3, "the cat sat on"), (5, TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(digests(df, frequent=frequent), rows)


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 0 and len(r.text or "") < 5000]
    compare(digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), frequent=200), rows)


def test_rare_pairs_are_joined(spark, monkeypatch):
    rows = list(enumerate(TEXTS[:8]))
    monkeypatch.setattr(alignment, "rated", lambda made, size_b, f=alignment.rated: f(made, size_b, most=5))
    compare(digests(spark.createDataFrame(rows, "doc_id long, text string"), frequent=5), rows)


def test_small_slabs(spark, monkeypatch):
    """Documents and their rows come in many batches."""
    rows = [(i, f"{t or ''} tail {i}") for i, t in enumerate(TEXTS * 3) if len(t or "") < 5000]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(alignment, "COMPOSED", 50)
    try:
        compare(digests(spark.createDataFrame(rows, "doc_id long, text string"), frequent=30), rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_splits_are_verified():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        model = alignment.Pair(f.read(), g.read())
    assert model.starts == b" \t\n\x0b\x0c"  # pieces with a carriage return behind other characters
    import pyarrow as pa

    found = alignment.Segments(pa.array([" a bc\n\nd\xa0 e\r f  g ", "", " a bc"]), model.start)
    assert found.distinct.to_pylist() == [" a", " bc", "\n\nd\xa0 e\r f", "  g", " "] and found.before.tolist() == [0, 5, 5, 7] and found.places.tolist() == [0, 1, 2, 3, 4, 0, 1]
    assert b" " in alignment.split_bytes([" \xa0 \xa0".encode()], [])
    assert alignment.split_bytes([b"ab", b" c", b"  "], [b" d", b"\n"]) == b" \t\n\x0b\x0c\r"
    assert b" " not in alignment.split_bytes([b"a b"], [])
    assert b"\r" not in alignment.split_bytes([], [b";\r"]) and b"\r" in alignment.split_bytes([b" \r"], []) and b"\r" not in alignment.split_bytes([], [b" \r"])


def test_odd_and_empty_tables(spark):
    assert len(digests(odd_documents(spark))) == len(ODD_TEXTS) + 1
    assert digests(empty_documents(spark)) == []
