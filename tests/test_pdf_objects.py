"""Objects by the chain of cross-reference sections, damaged files, and work that is done once for each file."""

import struct
import zlib

import pytest

from quirespark.plans import convert, packages
from quirespark.sources import pdf, ruling

from .test_conversion import stream, text_of


def page_text(content):
    return [x for b in text_of(pdf.parse(content)[1]) for x in b]


def shown(text):
    return stream(b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (%s) Tj ET" % text.encode())


FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"


class Saved:
    """A file and its revisions, with tables or streams of cross-references as asked for."""

    def __init__(self, ahead=b""):
        self.data, self.last, self.ahead = ahead + b"%PDF-1.7\n", None, len(ahead)

    def put(self, number, value, generation=0):
        at = len(self.data) - self.ahead
        self.data += b"%d %d obj\n%s\nendobj\n" % (number, generation, value)
        return number, at, generation

    def table(self, rows, free=(), root=b"/Root 1 0 R", more=b""):
        at, lines = len(self.data) - self.ahead, b""
        for number, place, generation in rows:
            lines += b"%d 1\n%010d %05d n \n" % (number, place, generation)
        for number, generation in free:
            lines += b"%d 1\n%010d %05d f \n" % (number, 0, generation)
        prev = b"/Prev %d" % self.last if self.last is not None else b""
        self.data += b"xref\n" + lines + b"trailer\n<<" + root + prev + more + b">>\n"
        return self.end(at)

    def stream(self, rows, number=90, packed=(), free=(), prev=True, head=b"/Root 1 0 R"):
        at = len(self.data) - self.ahead
        every = sorted([(n, 1, a, g) for n, a, g in rows] + [(n, 2, c, i) for n, c, i in packed] + [(n, 0, 0, 0) for n in free] + [(number, 1, at, 0)])
        raw = zlib.compress(b"".join(struct.pack(">BIH", *r[1:]) for r in every))
        index = b" ".join(b"%d 1" % r[0] for r in every)
        before = b"/Prev %d" % self.last if prev and self.last is not None else b""
        self.data += b"%d 0 obj\n<</Type/XRef%s%s/W[1 4 2]/Index[%s]/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (number, head, before, index, len(raw), raw)
        return self.end(at)

    def end(self, at):
        self.last = at
        self.data += b"startxref\n%d\n%%%%EOF\n" % at
        return self


def first_revision(ahead=b""):
    s = Saved(ahead)
    kids = b"<</Type/Pages/Kids[3 0 R 6 0 R]/Count 2/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>>>>>"
    rows = [s.put(1, b"<</Type/Catalog/Pages 2 0 R>>"), s.put(2, kids), s.put(3, b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"), s.put(4, shown("first")), s.put(5, FONT), s.put(6, b"<</Type/Page/Parent 2 0 R/Contents 7 0 R>>"), s.put(7, shown("second"))]
    return s.table(rows)


def test_last_revision_counts():
    s = first_revision()
    assert page_text(s.data) == ["first", "second"]
    s.table([s.put(4, shown("first, replaced"))], free=[(7, 1)])  # and the second page's content deleted
    assert page_text(s.data) == ["first, replaced"] and not pdf.File(s.data).repaired
    s.table([s.put(7, shown("of another generation"), 1)])  # its number given away again; the page refers to generation 0
    assert page_text(s.data) == ["first, replaced"]
    s.table([s.put(6, b"<</Type/Page/Parent 2 0 R/Contents 7 1 R>>")])
    assert page_text(s.data) == ["first, replaced", "of another generation"] and not pdf.File(s.data).repaired


def test_an_unused_later_copy_is_not_read():
    """Bytes that no section names: without the chain, the later copy would win."""
    s = first_revision()
    s.put(4, shown("never saved"))
    s.data += b"startxref\n%d\n%%%%EOF\n" % s.last
    assert page_text(s.data) == ["first", "second"]


def test_streams_and_hybrid_files():
    s = first_revision()
    members = {4: b"null", 20: b"<</Type/Page/Parent 2 0 R/Contents 21 0 R>>"}
    heads, body, at = [], b"", 0
    for n, v in members.items():
        heads.append(b"%d %d" % (n, at))
        body += v + b" "
        at += len(v) + 1
    first = b" ".join(heads) + b" "
    packed = first + body
    objects = b"<</Type/ObjStm/N 2/First %d/Length %d>>\nstream\n%s\nendstream" % (len(first), len(packed), packed)
    rows = [s.put(30, objects), s.put(21, shown("packed")), s.put(2, b"<</Type/Pages/Kids[3 0 R 20 0 R]/Count 2/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>>>>>")]
    s.stream(rows, packed=[(20, 30, 1)])  # object 4 of the object stream is none: no entry says so
    assert page_text(s.data) == ["first", "packed"] and not pdf.File(s.data).repaired
    # a hybrid file: what the table hides, its stream shows, before the revisions that precede it
    h = first_revision()
    before = h.last
    extra = [h.put(20, b"<</Type/Page/Parent 2 0 R/Contents 21 0 R>>"), h.put(21, shown("hidden from old readers"))]
    h.stream(extra, prev=False, head=b"")
    hidden, h.last = h.last, before
    h.table([h.put(2, b"<</Type/Pages/Kids[3 0 R 20 0 R]/Count 2/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>>>>>")], more=b"/XRefStm %d" % hidden)
    assert page_text(h.data) == ["first", "hidden from old readers"] and not pdf.File(h.data).repaired


def test_offsets_behind_other_bytes():
    assert page_text(first_revision(b"mail header\r\n\r\n").data) == ["first", "second"]
    assert not pdf.File(first_revision(b"junk\n").data).repaired


def test_broken_chains_are_repaired():
    good = first_revision().data
    broken = [
        good.replace(b"startxref\n", b"startxref\n9"),  # a place outside the file
        good[: good.rindex(b"xref\n", 0, good.rindex(b"startxref"))],  # cut off
        good.replace(b"(first)", b"(first, edited by hand)"),  # offsets that no longer hold
        good.replace(b"xref\n1 1", b"xref\n1 9999"),  # a table that ends early
    ]
    for content in broken:
        assert pdf.File(content).repaired or page_text(content)
        assert page_text(content)[0].startswith("first") and page_text(content)[1] == "second"
    loop = first_revision()
    loop.table([loop.put(4, shown("again"))], more=b"/Prev %d" % (len(loop.data) + 60))
    assert page_text(loop.data)


def test_packed_files_need_no_repair():
    assert not pdf.File(packages.packed_pdf(1, "a\nb")).repaired
    assert pdf.File(packages.pdf(1, "a\nb")).repaired  # it has no cross-references


def test_fonts_and_streams_are_read_once(monkeypatch):
    maps, inflated = [], []
    read, unpacked = pdf.Font.read_map, pdf._inflated
    monkeypatch.setattr(pdf.Font, "read_map", lambda self, data: maps.append(len(data)) or read(self, data))
    monkeypatch.setattr(pdf, "_inflated", lambda data, *a: inflated.append(len(data)) or unpacked(data, *a))
    body = "\n".join(f"line {i} of a long text" for i in range(41 * 12))
    pages, blocks = pdf.parse(packages.packed_pdf(1, body))
    assert len(pages) == 41 and len(maps) == 1 and [x for b in text_of(blocks) for x in b] == body.split("\n")
    assert len(inflated) == len(set(inflated)) or len(inflated) <= 41 * 8


def test_streams_are_bounded():
    bomb = zlib.compress(b"0" * 5_000_000)
    assert len(pdf._inflated(bomb)) == 5_000_000
    with pytest.raises(pdf.TooLarge):
        pdf._inflated(bomb, 100_000)
    with pytest.raises(pdf.TooLarge):
        pdf._run_lengths(bytes([129, 1]) * 10_000, 5000)
    with pytest.raises(pdf.TooLarge):
        pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85]) * 100, 1, 5)
    s = first_revision()
    packed = b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(bomb), bomb)
    s.table([s.put(4, packed)])
    with pytest.raises(pdf.TooLarge):
        pdf.read(s.data, 1_000_000)
    whole = zlib.compress(bytes(range(256)) * 40)
    assert pdf._inflated(whole[:-9]) and (bytes(range(256)) * 40).startswith(pdf._inflated(whole[:-9]))


def damaged():
    """Three pages, the second of which has a stream that can't be decoded."""
    s = first_revision()
    bad = b"<</Filter/ASCII85Decode/Length 9>>\nstream\n\xff\xfe\x01zz\x02\x03~>\nendstream"
    kids = b"<</Type/Pages/Kids[3 0 R 10 0 R 6 0 R]/Count 3/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>>>>>"
    return s.table([s.put(2, kids), s.put(10, b"<</Type/Page/Parent 2 0 R/Contents 11 0 R>>"), s.put(11, bad)]).data


@pytest.mark.parametrize("mode", ["fast", "academic"])
def test_damage_within_a_page(spark, mode):
    pages, blocks, failed, _ = pdf.read(damaged())
    assert len(pages) == 3 and [b[0] for b in blocks] == [1, 3] and list(failed) == [2]
    docs = spark.createDataFrame([("d", damaged())], "doc_id string, content binary")
    row = convert.pdf_markdown(docs, mode=mode).first()
    assert row.error is None and "first" in row.markdown and "<!-- page 3 -->" in row.markdown and "second" in row.markdown
    assert ("skipped on page 2: ValueError" in row.markdown) == (mode == "academic")


def content_of(shown):
    s = first_revision()
    s.table([s.put(4, b"<</Length %d>>\nstream\n%s\nendstream" % (len(shown), shown))])
    return s.data


def test_operations_are_read_as_wholes(monkeypatch):
    """A page's usual operations take one step each, and say what they say in an unusual form."""
    usual = b"".join(b"BT /F1 10 Tf 1 0 0 1 40 %d Tm (row %d) Tj <4142> Tj ET\nq 1 0 0 1 0 0 cm 40 %d 100 20 re S Q\n" % (700 - 20 * i, i, 695 - 20 * i) for i in range(20))
    unusual = usual.replace(b" ", b" % a note\n").replace(b"(row % a note\n", b"(row ")
    seen, real = [], pdf.Reader.value

    def counted(self):
        seen.append(self.references)
        return real(self)

    monkeypatch.setattr(pdf.Reader, "value", counted)
    one = pdf.read(content_of(usual))
    steps = seen.count(False)
    assert one == pdf.read(content_of(unusual)) and len(one[1]) and one[3]
    assert steps < 10 and seen.count(False) > 500


def test_cells_hold_the_spans_within():
    """Spans of many rows go to their cells from top to bottom, those of one height from left to right."""
    ys = list(range(0, 2000, 20))
    table = ruling.Table(0.0, 0.0, 100.0, 2000.0, [[(0.0, float(y), 50.0, y + 20.0), (50.0, float(y), 100.0, y + 20.0)] for y in ys])
    spans = [pdf.Span(t, "F", 6.0, 0, x, x + 4.0, y + d) for y in reversed(ys) for t, x, d in (("c", 60.0, 18.0), ("b", 70.0, 10.2), ("a", 60.0, 9.8), (f"{y}", 2.0, 12.0))]
    assert ruling.texts(table, spans) == [[f"{y}", "a b c"] for y in ys]


def test_lists_of_characters_are_read_as_wholes(monkeypatch):
    """The pairs of a ToUnicode map take no step each, also with surrogates, and say the same behind a note."""
    pairs = b"<0001> <0041>\n<0002> <D835DCB3>\n<0003> <00660069>\n" + b"".join(b"<%04X> <%04X>\n" % (k, 0x4E00 + k) for k in range(4, 90))
    plain = b"begincmap 89 beginbfchar\n" + pairs + b"endbfchar endcmap "
    seen, real = [], pdf.Reader.value
    monkeypatch.setattr(pdf.Reader, "value", lambda self: seen.append(1) or real(self))

    def codes(data):
        font = pdf.Font.__new__(pdf.Font)
        font.codes, font.lengths = {}, []
        font.read_map(data)
        return font.codes

    found, steps = codes(plain), len(seen)
    assert found == codes(plain.replace(b"<0001>", b"% a note\n<0001>")) and len(found) == 89 and found[b"\0\2"] == "𝒳" and found[b"\0\3"] == "fi"
    assert steps < 10
