import glob
import zlib
from array import array

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quirespark.llm import tokenfiles
from quirespark.llm.queries import QUERIES, tokenizer

from .util import ODD_TEXTS, empty_documents, odd_documents, save


def brute(rows):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.encode_special_tokens = True
    at, out = 0, []
    for key, text in sorted((k, x or "") for k, x in rows):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def found(df):
    return sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()))


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op9_token_files"](spark, sf)) == brute(rows)


def test_odd_and_empty_tables(spark, tmp_path):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) == len(ODD_TEXTS) + 1
    assert found(QUERIES["op9_token_files"](spark, save(docs, tmp_path / "odd"))) == sorted(brute(rows))
    assert found(QUERIES["op9_token_files"](spark, save(empty_documents(spark), tmp_path / "none"))) == []


def test_files_are_ordered_and_carry_page_indexes(spark, sf, tmp_path):
    path = str(tmp_path / "tokens")
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenfiles.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, f.read(), 2, parts=3)
    keys = []
    for name in sorted(glob.glob(f"{path}/*.parquet")):
        file = pq.ParquetFile(name)
        keys += file.read(columns=["doc_id"])["doc_id"].to_pylist()
        ids = [file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns) if "ids" in file.metadata.row_group(0).column(i).path_in_schema]
        assert all(c.has_column_index and c.has_offset_index for c in ids) and any("DICT" in e for c in ids for e in c.encodings)
    assert keys == sorted(keys) and len(keys) == 200


def plain_tokenizer(literals):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.encode_special_tokens = not literals  # False is the library's default
    return t


def test_chunks_equal_the_library():
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    points = [chr(c) for c in range(1, 0x3100)]
    texts = [x for c in points for x in (f"{c},", f"{c}.", f"a{c}.", f"{c}a,", f"ab {c}b{c}, d.")]
    odd = ["İ.", "é,", "é,", "Å.", "Σας. ΣΑΣ,", "ǅ.", "don't, we'll.", "x,.", ",.", "<|endoftext|>", "a<|endoftext|>.", "<|ENDOFTEXT|>,", "<|startoftext|>b c", "ab!!", "é###", "x&&&", "word?!;:,.", "слово,!", "a1%%", "$$", "don't!", "x'!", "ß%$"]
    for literals in (False, True):
        library, own = plain_tokenizer(literals), tokenfiles.Chunks(vocabulary, literals)
        assert own.parts
        for some in ([*texts, *odd] if not literals else [*texts[::7], *odd],):
            want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
            got = [array("i", x).tolist() for x in own.texts(some)]
            assert [t for t, a, b in zip(some, want, got, strict=True) if a != b] == []
    assert array("i", tokenfiles.Chunks(vocabulary, True).texts(["<|endoftext|>"])[0]).tolist() == [49407]


def test_other_vocabularies_and_memory():
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    texts = ["the cat,  sat.\n\nÉcole ", "", "İ. x"]
    own, library = tokenfiles.Chunks(vocabulary), Tokenizer.from_str(vocabulary)
    library.encode_special_tokens = True
    assert not own.parts and [array("i", x).tolist() for x in own.texts(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        small = tokenfiles.Chunks(f.read())
    was, tokenfiles.MEMO = tokenfiles.MEMO, 1000
    try:
        words = [f"word{i} of" for i in range(200)]
        assert [array("i", x).tolist() for x in small.texts(words)] == [e.ids for e in plain_tokenizer(False).encode_batch(words, add_special_tokens=False)]
        assert len(small) < 20
    finally:
        tokenfiles.MEMO = was


def test_null_ids_and_ties(spark):
    rows = [(None, "b c."), (None, "a"), (3, "x"), (3, None), (3, "x"), (1, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, tokenfiles.token_digests(docs, open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read(), 2).select("start", "n_tokens", "doc_id").collect()))
    assert [g[2] for g in got] == [None, None, 1, 3, 3, 3]
    assert [g[0] for g in got] == [0, *[a + n for a, n, _ in got[:-1]]] and [n for _, n, _ in got] == [2, 4, 50_001, 1, 2, 2]
