"""Encrypted files that open with an empty password, and others that stay closed."""

import hashlib
import os

import pytest

from quirespark.sources import pdf, security

from .test_conversion import stream, text_of
from .test_pdf_objects import FONT, Saved, page_text


def test_ciphers():
    """Vectors of the ciphers' own descriptions."""
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        assert security.cbc_encrypted(key, bytes(16), plain).hex() == want
        assert security.cbc_decrypted(key, bytes(16), bytes.fromhex(want)) == plain
    key, start, data = os.urandom(16), os.urandom(16), os.urandom(160)
    assert security.cbc_decrypted(key, start, security.cbc_encrypted(key, start, data)) == data
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and security.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    assert security.aes(key, b"short") == security.aes(key, b"") == b""


def sealed(key, data, number, generation, method):
    if method == "V2":
        return security.rc4(hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little")).digest()[: min(len(key) + 5, 16)], data)
    own = key if method == "AESV3" else hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + b"sAlT").digest()[: min(len(key) + 5, 16)]
    start, fill = bytes(range(16)), 16 - len(data) % 16
    return start + security.cbc_encrypted(own, start, data + bytes([fill]) * fill)


ID = b"0123456789abcdef"


def settings(kind, password=b""):
    """The ``Encrypt`` entry of a kind, the file's key, and the method."""
    owner = bytes(range(32))
    padded = (password + security.PAD)[:32]
    if kind in ("rc4-40", "rc4-128", "aes-128"):
        version, revision, size = {"rc4-40": (1, 2, 5), "rc4-128": (2, 3, 16), "aes-128": (4, 4, 16)}[kind]
        key = hashlib.md5(padded + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + ID).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        if revision == 2:
            user = security.rc4(key, security.PAD)
        else:
            user = hashlib.md5(security.PAD + ID).digest()
            for i in range(20):
                user = security.rc4(bytes(x ^ i for x in key), user)
            user += bytes(16)
        more = b"/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF" if kind == "aes-128" else b""
        return b"<</Filter/Standard/V %d/R %d/Length %d/P -4/O<%s>/U<%s>%s>>" % (version, revision, 8 * size, owner.hex().encode(), user.hex().encode(), more), key, "AESV2" if kind == "aes-128" else "V2"
    revision, key = (5 if kind == "aes-256-r5" else 6), bytes(range(100, 132))
    salts = b"validsal", b"key salt"
    user = security.hardened(password, salts[0], revision) + salts[0] + salts[1]
    kept = security.cbc_encrypted(security.hardened(password, salts[1], revision), bytes(16), key)
    more = b"/CF<</StdCF<</CFM/AESV3/Length 32>>>>/StmF/StdCF/StrF/StdCF"
    return b"<</Filter/Standard/V 5/R %d/Length 256/P -4/O<%s>/U<%s>/UE<%s>%s>>" % (revision, bytes(48).hex().encode(), user.hex().encode(), kept.hex().encode(), more), key, "AESV3"


def made(kind, password=b"", packed=False):
    entry, key, method = settings(kind, password)
    s = Saved()
    root = b"/Root 1 0 R/Encrypt 9 0 R/ID[<%s><%s>]" % (ID.hex().encode(), ID.hex().encode())
    shown = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (secret of %s) Tj ET" % kind.encode()
    page = b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Note<%s>>>" % sealed(key, b"a string", 3, 0, method).hex().encode()
    rows = [s.put(1, b"<</Type/Catalog/Pages 2 0 R>>"), s.put(2, b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>>>>>"), s.put(4, stream(sealed(key, shown, 4, 0, method))), s.put(9, entry)]
    if packed:  # the page and the font in an object stream, which is encrypted as a whole
        members = {3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Note(a string)>>", 5: FONT}
        first = b"3 0 5 %d " % (len(members[3]) + 1)
        body = sealed(key, first + b" ".join(members.values()), 8, 0, method)
        rows.append(s.put(8, b"<</Type/ObjStm/N 2/First %d/Length %d>>\nstream\n%s\nendstream" % (len(first), len(body), body)))
        return s.stream(rows, packed=[(3, 8, 0), (5, 8, 1)], head=root).data
    return s.table([*rows, s.put(3, page), s.put(5, FONT)], root=root).data


KINDS = ["rc4-40", "rc4-128", "aes-128", "aes-256-r5", "aes-256-r6"]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("kind", KINDS)
def test_files_that_open(kind, packed):
    content = made(kind, packed=packed)
    assert page_text(content) == [f"secret of {kind}"]
    file = pdf.File(content)
    assert not file.repaired and file.table(pdf.Ref(3))["Note"] == b"a string"
    broken = content.replace(b"startxref\n", b"startxref\n9")
    assert pdf.File(broken).repaired and page_text(broken) == [f"secret of {kind}"]


@pytest.mark.parametrize("kind", KINDS)
def test_files_that_stay_closed(kind):
    with pytest.raises(ValueError, match="encrypted"):
        pdf.parse(made(kind, b"open sesame"))


def test_other_handlers():
    with pytest.raises(ValueError, match="encrypted"):
        pdf.parse(made("rc4-128").replace(b"/Standard", b"/Adobe.X"))
    assert text_of(pdf.parse(made("aes-128"))[1])
