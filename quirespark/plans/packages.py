"""Small Word and PDF files made of texts, to be converted again."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape


def docx(doc_id: int, body: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    lines = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", body or "").split("\n")
    text = lambda s: f'<w:r><w:t xml:space="preserve">{escape(s)}</w:t></w:r>'
    head = f'<w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr>{text(f"Document {doc_id}")}</w:p>'
    math = "<w:p><m:oMath><m:f><m:num><m:r><m:t>a≤b</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p>"
    merged = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>{text("wide")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{text("l")}</w:p></w:tc><w:tc><w:p>{text("r")}</w:p></w:tc></w:tr></w:tbl>'
    document = f"<w:document {ns}><w:body>{head}{''.join(f'<w:p>{text(x)}</w:p>' for x in lines)}{math}{merged}</w:body></w:document>"
    style = f'<w:styles {ns}><w:style w:type="paragraph" w:styleId="T1"><w:name w:val="Custom"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", document)
        z.writestr("word/styles.xml", style)
    return out.getvalue()


def pdf(doc_id: int, body: str) -> bytes:
    lines = (body or "").split("\n")
    pages = [lines[i : i + 12] for i in range(0, len(lines), 12)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} >>", "<< /Type /Font /BaseFont /Helvetica >>"]
    out = [f"{i} 0 obj\n{o}\nendobj\n".encode() for i, o in enumerate(objects, 1)]
    for k, page in enumerate(pages):
        n = 4 + 2 * k
        shown = b"BT /F1 10 Tf\n" + b"".join(b"1 0 0 1 40 %d Tm (%s) Tj\n" % (842 - 110 - 50 * i, x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")) for i, x in enumerate(page)) + b"ET"
        packed = zlib.compress(shown)
        out.append(b"%d 0 obj\n<< /Type /Page /MediaBox [0 0 600 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>\nendobj\n" % (n, n + 1))
        out.append(b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % (n + 1, len(packed)) + packed + b"\nendstream\nendobj\n")
    return b"%PDF-1.4\n" + b"".join(out) + b"%%EOF"


def html(doc_id: int, body: str) -> bytes:
    lines = "".join(f"<p>{escape(x)}</p>" for x in (body or "").split("\n"))
    rest = f"<ol><li>one<ul><li><em>in</em> it</li></ul></li><li><a href='u'>two</a></li></ol><table><tr><th>n</th><th><b>v</b></th></tr><tr><td>{doc_id}</td><td>a|b</td></tr></table>"
    return f"<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style></head><body><h1>Document {doc_id}</h1>{lines}{rest}<script>no()</script></body></html>".encode()


def loose_html(doc_id: int, body: str) -> bytes:
    """The lines in turn as items, table rows and quoted paragraphs, with the end tags left out that pages may leave out, and stray ones."""
    lines = [escape(x) for x in (body or "").replace("$", "S").split("\n")]  # no formulas
    items, rows, quoted = lines[::3], lines[1::3], lines[2::3]
    table = "<table><tr><th>k<th>v" + "".join(f"<tr><td>{k}</i><td>{x}<table><tr><td>in</table>" for k, x in enumerate(rows)) + "</table>"
    return f"<title>d{doc_id}</title><p>Items</b> of <i>{doc_id}<ul><li>none{''.join(f'<li>{x}' for x in items)}</ul>{table}<blockquote><p>quoted{''.join(f'<p>{x}' for x in quoted)}</blockquote><p>end".encode()


def packed_pdf(doc_id: int, body: str) -> bytes:
    """The same pages as newer programs write them: objects in a compressed object stream, a cross-reference stream
    instead of a table, entries that pages inherit or refer to, a two-byte font with a ToUnicode map, text
    placed by a matrix, and every second line in a form that uses a graphics state of its page.
    """
    lines = (body or "").split("\n")
    shown = [lines[i : i + 12] for i in range(0, len(lines), 12)]
    code = {c: k for k, c in enumerate(sorted(set(body or "")), 1)}
    shapes = {ord(c): f"{k:04x}" for c, k in code.items()}
    entries = [f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in code.items()]
    groups = [f"{len(entries[i : i + 100])} beginbfchar\n" + "\n".join(entries[i : i + 100]) + "\nendbfchar" for i in range(0, len(entries), 100)]
    cmap = "/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "\n".join(groups) + "\nendcmap"

    def text(line: str) -> str:
        return f"<{line.translate(shapes)}>"

    packed = {
        1: "<</Type/Catalog/Pages 2 0 R>>",
        2: f"<</Type/Pages/Count {len(shown)}/Kids[{' '.join(f'{10 + 4 * k} 0 R' for k in range(len(shown)))}]/MediaBox 6 0 R/Resources 7 0 R>>",
        3: "<</Type/Font/Subtype/Type0/BaseFont/ABCDEF+Quire/Encoding/Identity-H/DescendantFonts[4 0 R]/ToUnicode 8 0 R>>",
        4: "<</Type/Font/Subtype/CIDFontType2/BaseFont/ABCDEF+Quire/DW 500>>",
        5: "<</Type/ExtGState/Font[3 0 R 10]>>",
        6: "[0 0 600 842]",
        7: "<</Font<</F1 3 0 R>>/ExtGState<</GS1 5 0 R>>>>",
    }
    streams: dict[int, tuple[str, bytes]] = {8: ("", cmap.encode())}
    for k, page in enumerate(shown):
        n = 10 + 4 * k
        forms = "".join(f"/X{i} {n + 2} 0 R" for i in range(1, len(page), 2))
        packed[n] = f"<</Type/Page/Parent 2 0 R/Contents {n + 3} 0 R" + (f"/Resources<</Font<</F1 3 0 R>>/ExtGState<</GS1 5 0 R>>/XObject {n + 1} 0 R>>" if forms else "") + ">>"
        packed[n + 1] = "<<" + "".join(f"/X{i} {1_000_000 + 100 * n + i} 0 R" for i in range(1, len(page), 2)) + ">>"
        placed = []
        for i, line in enumerate(page):
            y = 842 - 110 - 50 * i
            if i % 2:
                streams[1_000_000 + 100 * n + i] = ("/Type/XObject/Subtype/Form/BBox[0 0 600 842]/Resources<<>>", f"BT /GS1 gs {text(line)} Tj ET".encode())
                placed.append(f"q 1 0 0 1 40 {y} cm /X{i} Do Q")
            else:
                placed.append(f"q 1 0 0 1 40 {y} cm BT /F1 10 Tf [{text(line)}] TJ ET Q")
        streams[n + 3] = ("", "\n".join(placed).encode())
    heads, bodies, at = [], [], 0
    for number, value in packed.items():
        heads.append(f"{number} {at}")
        bodies.append(value)
        at += len(value) + 1
    first = len(" ".join(heads)) + 1
    streams[9] = (f"/Type/ObjStm/N {len(packed)}/First {first}", (" ".join(heads) + "\n" + "\n".join(bodies)).encode())
    out, spots = b"%PDF-1.5\n", {}
    for number, (head, data) in streams.items():
        spots[number] = len(out)
        small = zlib.compress(data)
        out += f"{number} 0 obj\n<<{head}/Filter/FlateDecode/Length {len(small)}>>\nstream\n".encode() + small + b"\nendstream\nendobj\n"
    places = {number: (1, spot, 0) for number, spot in spots.items()} | {number: (2, 9, i) for i, number in enumerate(packed)} | {9_999_999: (1, len(out), 0)}
    rows = [bytes(7), *(struct.pack(">BIH", *places[number]) for number in sorted(places))]
    ups = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for above, row in zip(rows, rows[1:], strict=False))  # differences from the row above
    small = zlib.compress(ups)
    index = " ".join(f"{number} 1" for number in sorted(places))
    end = f"9999999 0 obj\n<</Type/XRef/Root 1 0 R/W[1 4 2]/Index[{index}]/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length {len(small)}>>\nstream\n".encode()
    return out + end + small + f"\nendstream\nendobj\nstartxref\n{len(out)}\n%%EOF".encode()


# --- fonts without ToUnicode -------------------------------------------------


def _index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    ends = [1]
    for x in items:
        ends.append(ends[-1] + len(x))
    return struct.pack(">HB", len(items), 4) + b"".join(struct.pack(">I", e) for e in ends) + b"".join(items)


def cff(names: list[str]) -> bytes:
    """A font program whose glyph ``i + 1`` has the name ``names[i]`` and the code ``i + 1``; its outlines are empty."""
    header, own, strings = bytes([1, 0, 4, 4]), _index([b"Quire"]), _index([n.encode() for n in names])
    ahead = len(header) + len(own) + len(_index([bytes(18)])) + len(strings) + 2
    encoding = bytes([0, len(names), *range(1, len(names) + 1)])
    charset = b"\0" + b"".join(struct.pack(">H", 391 + i) for i in range(len(names)))
    places = [(15, ahead + len(encoding)), (16, ahead), (17, ahead + len(encoding) + len(charset))]
    top = b"".join(b"\x1d" + struct.pack(">i", place) + bytes([key]) for key, place in places)
    return header + own + _index([top]) + strings + b"\0\0" + encoding + charset + _index([b"\x0e"] * (len(names) + 1))


def type1(names: list[str]) -> bytes:
    rows = "".join(f"dup {i} /{n} put\n" for i, n in enumerate(names, 1))
    return f"%!PS-AdobeFont-1.0: Quire\n/FontName /Quire def\n/Encoding 256 array\n0 1 255 {{1 index exch /.notdef put}} for\n{rows}readonly def\ncurrentdict end\ncurrentfile eexec\n".encode() + bytes(32)


def truetype(characters: dict[int, str]) -> bytes:
    """A font program whose ``cmap`` takes each character to its glyph; all glyphs are 500 wide."""
    groups = sorted((ord(c), g) for g, c in characters.items())
    sub = struct.pack(">HHIII", 12, 0, 16 + 12 * len(groups), 0, len(groups)) + b"".join(struct.pack(">III", c, c, g) for c, g in groups)
    count = max(characters, default=0) + 1
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 10, 12) + sub,
        b"head": bytes(18) + struct.pack(">H", 1000) + bytes(34),
        b"hhea": bytes(34) + struct.pack(">H", 1),
        b"hmtx": struct.pack(">HH", 500, 0) + bytes(2 * (count - 1)),
        b"maxp": struct.pack(">IH", 0x5000, count),
    }
    at, heads, bodies = 12 + 16 * len(tables), b"", b""
    for name, data in tables.items():
        data += bytes(-len(data) % 4)
        heads += name + struct.pack(">III", 0, at + len(bodies), len(data))
        bodies += data
    return struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0) + heads + bodies


def glyph_name(c: str) -> str:
    return f"uni{ord(c):04X}" if ord(c) < 0x10000 else f"u{ord(c):X}"


def font_pdf(doc_id: int, body: str) -> bytes:
    """The pages of :func:`pdf` in fonts that have no ToUnicode map, by turns: a TrueType program with glyphs of its own
    order, two predefined character maps (UTF-16 and a national encoding), and simple fonts with a CFF and a Type 1 program.
    """
    lines = (body or "").split("\n")
    shown = [lines[i : i + 12] for i in range(0, len(lines), 12)]
    kinds, simple = [], {3: [], 4: []}
    for i, line in enumerate(lines):
        kind = (doc_id + i) % 5 + 1
        if kind in simple:
            more = sorted(set(line) - set(simple[kind]))
            if len(simple[kind]) + len(more) > 250:
                kind = 2
            else:
                simple[kind] += more
        kinds.append(kind)
    glyphs = {c: 3 + 2 * k for k, c in enumerate(sorted({c for line, kind in zip(lines, kinds, strict=True) if kind == 1 for c in set(line)}, reverse=True))}
    cids = {c: k for k, c in enumerate(sorted(glyphs), 1)}
    placed = {ord(c): chr(k) for c, k in cids.items()}
    to_glyph = b"\0\0" + b"".join(struct.pack(">H", glyphs[c]) for c in sorted(cids))
    codes = {kind: {c: i for i, c in enumerate(own, 1)} for kind, own in simple.items()}

    def text(line: str, kind: int) -> bytes:
        if kind == 1:
            data = line.translate(placed).encode("utf-16-be")
        elif kind == 2:
            data = line.encode("utf-16-be", "replace")
        elif kind == 5:
            data = line.encode("gb18030", "replace")
        else:
            data = bytes(map(codes[kind].__getitem__, line))
        return b"<" + data.hex().encode() + b">"

    def packed(head: bytes, data: bytes) -> bytes:
        small = zlib.compress(data)
        return b"<<%s/Filter/FlateDecode/Length %d>>\nstream\n" % (head, len(small)) + small + b"\nendstream"

    wide = b"<</Type/Font/Subtype/Type0/BaseFont/Quire/Encoding/%s/DescendantFonts[<</Type/Font/Subtype/%s/BaseFont/Quire/DW 500%s>>]>>"
    names = [[glyph_name(c) for c in simple[kind]] for kind in (3, 4)]
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Count %d/Kids[%s]/MediaBox[0 0 600 842]/Resources<</Font<</F1 3 0 R/F2 4 0 R/F3 5 0 R/F4 6 0 R/F5 7 0 R>>>>>>" % (len(shown), b" ".join(b"%d 0 R" % (20 + 2 * k) for k in range(len(shown)))),
        3: wide % (b"Identity-H", b"CIDFontType2", b"/FontDescriptor<</Type/FontDescriptor/FontFile2 10 0 R>>/CIDToGIDMap 11 0 R"),
        4: wide % (b"UniJIS-UTF16-H", b"CIDFontType0", b""),
        5: b"<</Type/Font/Subtype/Type1/BaseFont/Quire/FontDescriptor<</Type/FontDescriptor/Flags 4/FontFile3 12 0 R>>>>",
        6: b"<</Type/Font/Subtype/Type1/BaseFont/Quire/FontDescriptor<</Type/FontDescriptor/Flags 4/FontFile 13 0 R>>>>",
        7: wide % (b"GBK2K-H", b"CIDFontType0", b""),
        10: packed(b"", truetype({g: c for c, g in glyphs.items()})),
        11: packed(b"", to_glyph),
        12: packed(b"/Subtype/Type1C", cff(names[0])),
        13: packed(b"", type1(names[1])),
    }
    for k, page in enumerate(shown):
        own = kinds[12 * k : 12 * k + 12]
        content = b"BT\n" + b"".join(b"/F%d 10 Tf 1 0 0 1 40 %d Tm %s Tj\n" % (kind, 842 - 110 - 50 * i, text(x, kind)) for i, (x, kind) in enumerate(zip(page, own, strict=True))) + b"ET"
        objects[20 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (21 + 2 * k)
        objects[21 + 2 * k] = packed(b"", content)
    out, rows = b"%PDF-1.6\n", []
    for number, value in objects.items():
        rows.append(b"%d 1\n%010d 00000 n \n" % (number, len(out)))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, value)
    return out + b"xref\n" + b"".join(rows) + b"trailer\n<</Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % len(out)


def table_pdf(doc_id: int, body: str | None) -> bytes:
    """Lines as the rows of ruled tables, ten on a page, under a heading row; every third page has a title over all columns.

    Rules are drawn by turns as stroked lines, as rectangles around cells, and as thin filled areas.
    """
    if body is None:
        return b""
    lines = body.split("\n")
    shown = [lines[i : i + 10] for i in range(0, len(lines), 10)]
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {len(shown)}/Kids[{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(shown)))}]/MediaBox[0 0 600 842]/Resources<</Font<</F1 3 0 R>>>>>>", "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    out = [f"{i} 0 obj\n{o}\nendobj\n".encode() for i, o in enumerate(objects, 1)]
    xs = [50, 100, 500, 550]
    for k, page in enumerate(shown):
        n = 4 + 2 * k
        rows = [[b"no", b"line", b"n"]] + [[b"%d" % (10 * k + i), x.encode("cp1252", "replace"), b"%d" % len(x)] for i, x in enumerate(page)]
        top, ys = 740, [740 - 40 * i for i in range(len(rows) + 1)]
        cells = [(xs[j], ys[i], xs[j + 1], ys[i + 1], text) for i, row in enumerate(rows) for j, text in enumerate(row)]
        if k % 3 == 2:
            cells.append((50, 780, 550, 740, b"title of page %d" % (k + 1)))
            top = 780
        drawn = []
        for x0, y0, x1, y1, text in cells:
            size = min(10, (x1 - x0 - 8) / max(1, len(text)) * 2)
            shown_text = text.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            drawn.append(b"BT /F1 %.4f Tf 1 0 0 1 %d %d Tm (%s) Tj ET" % (size, x0 + 4, y1 + 15, shown_text))
            if k % 3 == 1:
                drawn.append(b"%d %d %d %d re S" % (x0, y1, x1 - x0, y0 - y1))
        if k % 3 == 0:
            drawn += [b"%d %d m %d %d l S" % (50, y, 550, y) for y in ys] + [b"%d %d m %d %d l S" % (x, ys[-1], x, ys[0]) for x in xs]
        elif k % 3 == 2:
            drawn += [b"50 %.1f 500 1 re f" % (y - 0.5) for y in (top, *ys)] + [b"%.1f %d 1 %d re f" % (x - 0.5, ys[-1], (top if x in (50, 550) else ys[0]) - ys[-1]) for x in xs]
        packed = zlib.compress(b"\n".join(drawn))
        out.append(b"%d 0 obj\n<</Type/Page/Parent 2 0 R/Contents %d 0 R>>\nendobj\n" % (n, n + 1))
        out.append(b"%d 0 obj\n<</Length %d/Filter/FlateDecode>>\nstream\n" % (n + 1, len(packed)) + packed + b"\nendstream\nendobj\n")
    return b"%PDF-1.4\n" + b"".join(out) + b"trailer\n<</Root 1 0 R>>\n%%EOF"


# --- stand-ins for models: what they are asked is what they answer -------------


def layout(content: bytes, page_no: int, width: float, height: float) -> list[tuple]:
    """The same three regions on every page but the second, where it fails."""
    if page_no == 2:
        raise RuntimeError("no model")
    return [("figure", 0.9, 100, 100, 200, 150), ("isolate_formula", 0.9, 100, 200, 200, 250), ("table", 0.9, 1, 300, 200, 350)]


def picture(content: bytes, page_no: int, box: tuple, scale: float) -> bytes:
    return f"{page_no} {' '.join(map(str, box))} {scale}".encode()


def formula(content: bytes, page_no: int, box: tuple, scale: float) -> str:
    return f"y = {page_no}" if (box, scale) == ((96.0, 196.0, 204.0, 254.0), 4.0) else "wrong"
