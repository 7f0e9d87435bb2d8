"""Null ids, rows with equal ids, repeated rows and truly long texts, where an operator's own tests have none of them."""

import base64
import hashlib
import zlib

import public_tokenizers as P
import tiktoken

from quirespark.llm import bpe, fingerprints, guesscost, jaccard, langid, media, mixing
from quirespark.llm.queries import tokenizer

LONG = "word of a long text, " * 60_000  # 1.2 million characters
ROWS = [
    (None, "no id, password = abcdefghijkl99", "en", None, 1, 2),
    (None, "no id either", None, "s", 1, 2),
    (4, "tie one two three four", "en", "s", 1, 2),
    (4, "tie five six seven eight", "de", "s", 1, 2),
    (4, "tie five six seven eight", "de", "s", 1, 2),
    (5, None, None, None, 1, 2),
    (6, "", "en", "", 1, 2),
    (7, LONG, "en", "s", 1, 2),
]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, fingerprint int, size int").repartition(3)


def by_key(rows):
    return sorted(rows, key=repr)


def test_fingerprints(spark):
    got = fingerprints.edited_and_next(docs(spark)).collect()
    assert len(got) == len(ROWS) and by_key((r.doc_id, r.n_chars) for r in got) == by_key((k, len(t or "")) for k, t, *_ in ROWS)
    ordered = sorted(((-1 if k is None else k, t or "") for k, t, *_ in ROWS))
    want = [hashlib.sha256(fingerprints.edited(t, ordered[(i + 1) % len(ordered)][1]).encode()).hexdigest() for i, (_, t) in enumerate(ordered)]
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 2


def test_media(spark):
    got = media.media_table(docs(spark)).collect()
    want = []
    for key, text, *_ in ROWS:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((key, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert by_key(tuple(r)[:5] for r in got) == by_key(want)


def test_media_of_short_reads(tmp_path):
    """A read that comes back short is made again on a new file, whether its header or its data is cut."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x" * 100)
        z.writestr("b", b"y" * 100)
    member = zipfile.ZipFile(out).infolist()[1]

    class Store:
        opened = 0

        def open_input_file(self, path):
            Store.opened += 1
            return io.BytesIO(out.getvalue())

    for cut in (member.header_offset, member.header_offset + 10, member.header_offset + 40):
        Store.opened = 0
        assert media.read_member(Store(), "p", io.BytesIO(out.getvalue()[:cut]), member) == b"y" * 100 and Store.opened == 1


def test_mix(spark):
    got = mixing.mixed_documents(docs(spark)).collect()
    assert by_key((r.doc_id, r["size"]) for r in got) == by_key((k, len((t or "").split())) for k, t, *_ in ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert by_key(map(tuple, got)) == by_key(map(tuple, mixing.mixed_documents(docs(spark)).collect()))


def test_secrets(spark):
    got = guesscost.span_digests(guesscost.scan(docs(spark))).collect()
    assert by_key((r.doc_id, (r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == by_key((k, guesscost.brute(t or "")) for k, t, *_ in ROWS)


def test_groups(spark):
    rows = jaccard.document_groups(docs(spark)).collect()
    assert by_key((r.doc_id, r.component_id) for r in rows) == by_key([(None, None), (None, None), (4, 4), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7)])
    near = [(None, "a b c d e f g h i j k l"), (9, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l")]
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert {r.component_id for r in jaccard.document_groups(df).collect()} == {3} and [r.doc_id for r in jaccard.one_of_each(df).collect()] == [3]


def test_language(spark):
    got = langid.predicted(docs(spark)).collect()
    assert by_key((r.doc_id, r.held_out) for r in got) == by_key((k, zlib.crc32(("" if k is None else str(k)).encode()) % 4 == 2) for k, *_ in ROWS)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (5, 6))


def test_bpe(spark):
    ranks = bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})
    got = bpe.encode_decode(docs(spark), ranks, P.PATTERN).collect()
    assert by_key((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == by_key((k, own.encode_ordinary(t or ""), (t or "").encode()) for k, t, *_ in ROWS)


def test_memos_are_bounded():
    ranks = bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, P.PATTERN)
    was, bpe.MEMO = bpe.MEMO, 20_000
    try:
        texts = [f"piece{i} q{i}z" for i in range(400)]
        singly = [x for t in texts for x in codec.encode_all([t])]
        assert len(codec.memo) < 200 and codec.held <= bpe.MEMO + 2000
    finally:
        bpe.MEMO = was
    assert singly == codec.encode_all(texts)
    codec.forget()
    assert not codec.memo and codec.held == 0
