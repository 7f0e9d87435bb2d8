import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quirespark.llm import bpe
from quirespark.llm.queries import QUERIES, tokenizer

from .util import ODD_TEXTS, empty_documents, odd_documents, save

RANKS = bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def brute():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library(brute):
    own, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(7)
    alphabet = "aaabcdeéñß 0123\n'\t.,-=漢🙂 "
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(alphabet, k=rng.randrange(400))) for _ in range(300)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (63, 64, 65, 129, 3000)]
    for text in texts:
        ids = own.encode(text)
        assert ids == brute.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_white_space_and_classes_split_as_in_the_library(brute):
    own = bpe.Codec(RANKS, P.PATTERN)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    text = "a".join(f"{chr(c)}b {chr(c)}" for c in points)
    assert own.encode(text) == brute.encode_ordinary(text)


def test_query(spark, sf, brute):
    for row in QUERIES["op10_byte_bpe"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        ids = brute.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_odd_and_empty_tables(spark, tmp_path):
    rows = QUERIES["op10_byte_bpe"](spark, save(odd_documents(spark), tmp_path / "odd")).collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (0, 1)} == {(0, empty, empty)}
    assert QUERIES["op10_byte_bpe"](spark, save(empty_documents(spark), tmp_path / "none")).count() == 0
