import hashlib
import json
import os
import zipfile
import zlib

import pytest

from quirespark.llm import media as M
from quirespark.llm.queries import QUERIES

from .util import ODD_TEXTS, empty_documents, odd_documents, save


def padded(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 10_000])
def test_images_are_lossless(n):
    data = os.urandom(n)
    payload, size = M.decode_image(M.encode_image(data))
    assert size == n and payload[:n] == data and len(payload) % 64 == 0 and len(payload) >= 64 and not any(payload[n:])


def check(rows):
    for r in rows:
        payload = padded(r.text)
        image = M.encode_image((r.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())


def test_query(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op2_media_archives"](spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    check(rows)
    odd = odd_documents(spark)
    rows = QUERIES["op2_media_archives"](spark, save(odd, tmp_path / "odd")).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    check(rows)
    assert len({r.feature for r in rows if r.doc_id in (5, 6)}) == 1
    assert QUERIES["op2_media_archives"](spark, save(empty_documents(spark), tmp_path / "none")).count() == 0


def test_ranges_cover_each_member_once_and_retry_by_offset(tmp_path, monkeypatch):
    name = tmp_path / "a.zip"
    with zipfile.ZipFile(name, "w") as z:
        for i in range(50):
            z.writestr(f"{i:08d}-{i}.png", M.encode_image(os.urandom(500)))
    (tmp_path / "manifest.json").write_text(json.dumps([["a.zip", name.stat().st_size]]))
    monkeypatch.setattr(M, "RANGE_BYTES", 4096)
    reader = M.ArchiveReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 3
    failed = []
    whole = M.zlib.crc32

    def flaky(data, *a):
        if len(data) > 300 and len(failed) < 2:
            failed.append(1)
            return 0
        return whole(data, *a)

    monkeypatch.setattr(M, "zlib", type("Z", (), {"crc32": staticmethod(flaky)}))
    keys = [k for p in parts for b in reader.read(p) for k in b.column(0).to_pylist()]
    assert keys == list(range(50)) and len(failed) == 2
