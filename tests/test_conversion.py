"""One parse for each file, providers, assets whose links resolve, registered converters, retries."""

import io
import os
import re
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

import quirespark
from quirespark import cli, registry
from quirespark.plans import convert, packages, sinks, translate
from quirespark.providers import Providers, cache_settings, ready
from quirespark.sources import docx, html, pdf, tiff
from quirespark.sources.files import read_files

from .test_sources import NS, package


def calls(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


def counting(path, parse):
    def run(*arguments):
        with open(path, "a") as f:
            f.write("call\n")
        return parse(*arguments)

    return run


# --- PDF -------------------------------------------------------------------


def text_of(blocks):
    return [["".join(s["text"] for s in line["spans"]) for line in b[4]] for b in blocks]


def file(objects, trailer="<</Root 1 0 R>>"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer\n" + trailer.encode()


def stream(data, head=b""):
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (head, len(data), data)


def one_page(content, fonts=b"/F1<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold>>", page=b"", more=None):
    return file({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<<%s>>>>%s>>" % (fonts, page), 4: stream(content), **(more or {})})


def test_packed_files():
    body = "\n".join(f"line {i} émigré 漢字 🙂 (x)" for i in range(30))
    found, blocks = pdf.parse(packages.packed_pdf(1, body))
    assert [p[1:] for p in found] == [(600.0, 842.0)] * 3 and [x for b in text_of(blocks) for x in b] == body.split("\n")
    assert blocks[0][4][0]["spans"][0]["font"] == "Quire" and blocks[1][3]["x0"] == 40.0


def test_content():
    shown = b"q 2 0 0 2 10 20 cm BT /F1 12 Tf 1 0 0 1 5 100 Tm (A) Tj 300 Tz [(B) -900 (C(d\\051))] TJ ET Q BT /F1 8 Tf 12 TL 50 300 Td (one) Tj T* (two) Tj (three) ' ET"
    pages, blocks = pdf.parse(one_page(shown))
    assert pages == [(1, 600.0, 800.0)] and text_of(blocks) == [["AB C(d))"], ["one", "two", "three"]]
    first = blocks[0][4][0]["spans"][0]
    assert first["size"] == 24.0 and first["flags"] == 16 and blocks[0][3]["x0"] == 20.0 and round(blocks[0][3]["y0"], 3) == 800 - 220 - 24
    turned, _ = pdf.parse(one_page(b"BT /F1 8 Tf (x) Tj ET", page=b"/Rotate 90/CropBox[0 0 300 500]"))
    assert turned == [(1, 500.0, 300.0)]


def test_encodings_and_inherited_states():
    fonts = b"/F1<</Type/Font/Subtype/Type1/BaseFont/AAAAAA+X/Encoding<</Differences[65/eacute/uni4E2D/f_i 70/nothing.known]>>>>"
    assert text_of(pdf.parse(one_page(b"BT /F1 9 Tf (ABCFZ) Tj ET", fonts))[1]) == [["é中fi�Z"]]
    form = {5: b"<</Type/ExtGState/Font[6 0 R 7]>>", 6: b"<</Type/Font/Subtype/Type1/BaseFont/Times-Italic>>", 7: stream(b"BT /GS1 gs (in a form) Tj ET", b"/Type/XObject/Subtype/Form/Resources<<>>")}
    page = b"/Resources<</ExtGState<</GS1 5 0 R>>/XObject<</X 7 0 R>>>>"
    spans = pdf.parse(one_page(b"/X Do", page=page, more=form))[1][0][4][0]["spans"]
    assert [(s["text"], s["font"], s["size"], s["flags"]) for s in spans] == [("in a form", "Times-Italic", 7.0, 2)]


def test_damaged_files():
    with pytest.raises(ValueError):
        pdf.parse(file({1: b"<</Type/Catalog>>"}, "<</Root 1 0 R/Encrypt 9 0 R>>"))
    assert pdf.parse(b"") == ([], []) and pdf.parse(b"1 0 obj << /A [ ( << ") == ([], [])
    cyclic = file({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 3 0 R]>>", 3: b"<</Type/Page/Contents 3 0 R>>"})
    assert pdf.parse(cyclic) == ([(1, 612.0, 792.0)], [])
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == b"-----A---B"
    whole = packages.packed_pdf(1, "a line of text\nand another one")
    for cut in range(0, len(whole), 37):  # whatever is left of a file, it is read or refused, not a crash of another kind
        try:
            pdf.parse(whole[:cut])
        except ValueError:
            pass


@pytest.fixture
def pdfs(spark, tmp_path):
    rows = [(f"d{i}", packages.packed_pdf(i, "\n".join(f"Some text of document {i}, line {k} of it" for k in range(30)))) for i in range(8)] + [("bad", b"nothing"), ("null", None)]
    return spark.createDataFrame(rows, "doc_id string, content binary").repartition(3)


@pytest.mark.parametrize("mode", ["fast", "academic"])
def test_one_parse_for_each_document(spark, pdfs, tmp_path, mode):
    log = tmp_path / "calls"
    made = convert.conversion(pdfs.withColumn("ext", F.lit(".pdf")).withColumn("mime", F.lit(None).cast("string")), mode=mode, provider=counting(str(log), pdf.parse))
    rows = {r.doc_id: r for r in made.documents.collect()}
    assert made.documents.count() == 10 and made.events.count() > 0
    assert calls(log) == 10
    assert rows["d3"].markdown.count("<!-- page ") == 3 and "document 3, line 29" in rows["d3"].markdown
    assert rows["bad"].error == rows["null"].error == "ValueError: no pages were found"
    pages = made.events.where("stage = 'pages' and doc_id = 'd1'").orderBy("seq").collect()
    assert [(e.current, e.total) for e in pages] == [(1, 3), (2, 3), (3, 3)]


def layout(content, page_no, width, height):
    if page_no == 2:
        raise RuntimeError("no model")
    return [("figure", 0.9, 30, 90, 300, 125), ("isolate_formula", 0.8, 30, 140, 300, 170), ("title", 0.9, 0, 0, 600, 842)] if page_no == 1 else []


def tables(content, page_no, width, height):
    if page_no == 2:
        raise RuntimeError("no tables")
    return [(30, 90, 300, 125)] if page_no == 1 else [(30.7, 340, 300, 370)]


def test_regions_and_a_failing_page(spark, pdfs):
    providers = Providers(layout=layout, tables=tables, render=lambda data, page, box: b"PNG%d" % page, formula=lambda data, page, box: "$$ x \\le 1 $$")
    made = convert.pdf_conversion(pdfs.where("doc_id = 'd1'"), providers=providers, assets="d1_assets")
    text = made.documents.first().markdown
    assert "![figure page 1](d1_assets/page-0001-01-figure.png)" in text and "$$\nx \\le 1\n$$" in text
    assert "<!-- page 2 -->\n\n<!-- layout detection skipped on page 2: RuntimeError: no model -->\n\nSome text of document 1, line 12 of it" in text
    assert "![table page 3](d1_assets/page-0003-01-table.png)" in text and "page-0001-02-table" not in text  # page 1 has it as a figure
    covered = ["line 0 of", "line 1 of", "line 29 of"]
    assert not any(c in text for c in covered) and "line 2 of" in text
    assets = {r.rel_path: bytes(r.content) for r in made.assets.collect()}
    assert assets == {"page-0001-01-figure.png": b"PNG1", "page-0003-01-table.png": b"PNG3"}
    assert set(re.findall(r"d1_assets/([^)]*)\)", text)) == set(assets)


def test_regions_without_pictures(spark, pdfs):
    d1 = pdfs.where("doc_id = 'd1'")
    text = convert.pdf_markdown(d1, providers=Providers(layout=layout)).first().markdown
    assert "![" not in text and "line 0 of" in text and "<!-- formula OCR unavailable -->" in text and "line 1 of" not in text

    def failing(*_):
        raise OSError("no renderer")

    made = convert.pdf_conversion(d1, providers=Providers(layout=layout, render=failing, formula=failing), assets="x")
    assert "![" not in made.documents.first().markdown and made.assets.count() == 0 and "line 0 of" in made.documents.first().markdown


def test_empty_tables(spark, pdfs):
    made = convert.conversion(pdfs.withColumn("ext", F.lit(".pdf")).withColumn("mime", F.lit("")).limit(0))
    assert made.documents.count() == made.assets.count() == made.events.count() == 0


def test_models_are_loaded_once(tmp_path):
    class Model:
        key = "test model"
        loads = 0

        def load(self):
            Model.loads += 1
            return lambda: os.environ["TORCH_HOME"]

    was = dict(os.environ)
    try:
        assert ready(Model(), str(tmp_path))() == str(tmp_path / "torch") and ready(Model()) is ready(Model()) and Model.loads == 1
        assert ready(None) is None and cache_settings("/c")["XDG_CACHE_HOME"] == "/c"
    finally:
        os.environ.clear()
        os.environ.update(was)


# --- Word ------------------------------------------------------------------


def word(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS} xmlns:v="urn:schemas-microsoft-com:vml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>')
        for name, data in parts.items():
            z.writestr(f"word/{name}.xml", f"<w:{name} {NS}>{data}</w:{name}>")
    return out.getvalue()


def p(text, properties=""):
    return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def item(text, level, number=1):
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def markdown(content, **options):
    return html.to_markdown(docx.to_html(content, **options)[0])[0]


def test_lists_controls_and_notes():
    levels = lambda *kinds: "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{k}"/></w:lvl>' for i, k in enumerate(kinds))
    numbering = f'<w:abstractNum w:abstractNumId="0">{levels("bullet", "decimal")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal")}</w:abstractNum>' + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{a}"/></w:num>' for n, a in ((1, 0), (2, 1)))
    body = item("a", 0) + item("b", 1) + item("c", 1) + item("d", 0) + p("between") + item("one", 0, 2) + item("two", 0, 2) + item("no list", 0, 0)
    assert markdown(word(body, numbering=numbering)) == "* a\n  1. b\n  2. c\n* d\n\nbetween\n\n1. one\n2. two\n\nno list"
    control = f"<w:sdt><w:sdtContent>{p('in a control')}<w:sdt><w:sdtContent>{p('deeper')}</w:sdtContent></w:sdt></w:sdtContent></w:sdt>"
    inline = '<w:p><w:r><w:t>x</w:t></w:r><w:sdt><w:sdtContent><w:r><w:t>y</w:t></w:r></w:sdtContent></w:sdt><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    notes = f'<w:footnote w:id="2">{p("the note")}</w:footnote><w:footnote w:id="3">{p("never cited")}</w:footnote>'
    text = markdown(word(control + inline, footnotes=notes))
    assert text.startswith("in a control\n\ndeeper\n\nxy[[1]](#footnote-2)\n\n1. the note") and "[↑](#footnote-ref-2)" in text and "never" not in text


def test_style_maps():
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{n}"/></w:style>' for k, n in (("A", "It's"), ("B", "heading 2"), ("C", "Own")))
    body = p("a", '<w:pStyle w:val="A"/>') + p("b", '<w:pStyle w:val="B"/>') + p("c", '<w:pStyle w:val="C"/>')
    package = word(body, styles=styles)
    assert markdown(package) == "a\n\n## b\n\nc"
    assert markdown(package, style_map="p[style-name='It\\'s'] => h3:fresh\np[style-name='Heading 2'] => p\nr[style-name='x'] => b") == "### a\n\nb\n\nc"


def test_more_mathematics():
    math = lambda inside: markdown(word(f"<w:p><m:oMath>{inside}</m:oMath></w:p>"))
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    assert math(f"<m:limLow><m:e>{r('lim')}</m:e><m:lim>{r('n')}</m:lim></m:limLow>") == "$\\lim_{n}$"
    assert math(f"<m:limUpp><m:e>{r('x')}</m:e><m:lim>{r('n')}</m:lim></m:limUpp>") == "$\\overset{n}{x}$"
    assert math(f"<m:groupChr><m:e>{r('x')}</m:e></m:groupChr>") == "$\\underbrace{x}$"
    assert math(f"<m:eqArr><m:e>{r('x')}</m:e><m:e>{r('y')}</m:e></m:eqArr>") == "$\\begin{array}{c}x \\\\ y\\end{array}$"
    assert math(f"<m:sPre><m:sub>{r('1')}</m:sub><m:sup>{r('2')}</m:sup><m:e>{r('H')}</m:e></m:sPre>") == "${}_{1}^{2}{H}$"


def picture(order="<", packing=1, data=bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])):
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, packing), (262, 3, 2), (273, 4, 8), (277, 3, 3), (279, 4, len(data))]
    rows = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in tags)
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8 + len(data)) + data + struct.pack(order + "H", len(tags)) + rows + bytes(4)


def test_tiff():
    import zlib

    plain = tiff.to_png(picture())
    assert plain[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBB", plain[16:26]) == (2, 2, 8, 2)
    assert zlib.decompress(plain[41 : 41 + struct.unpack(">I", plain[33:37])[0]]) == b"\0\xff\0\0\0\xff\0\0\0\0\xff\x09\x09\x09"
    raw = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    assert tiff.to_png(picture(">")) == tiff.to_png(picture(packing=8, data=zlib.compress(raw))) == tiff.to_png(picture(packing=32773, data=bytes([11]) + raw)) == plain
    assert tiff.to_png(b"") is tiff.to_png(b"II*\0junk") is tiff.to_png(picture(packing=7)) is None


def test_docx_parsed_once_with_links(spark, tmp_path, monkeypatch):
    log = tmp_path / "calls"
    docs = spark.createDataFrame([("a/x.docx", package(), "x_assets"), ("a/y.docx", b"no zip", "y_assets")], "doc_id string, content binary, assets string").withColumn("ext", F.lit(".docx")).withColumn("mime", F.lit(""))
    monkeypatch.setattr(docx, "to_html", counting(str(log), docx.to_html))
    made = convert.conversion(docs)
    assert made.documents.count() == 2 and made.events.count() > 0
    links = {r.rel_path for r in made.assets.collect()}
    text = made.documents.where("error is null").first().markdown
    found = re.findall(r"!\[\]\(x_assets/([^)]*)\)", text)
    assert found == ["image-0001.png", "image-0002.png"] and set(found) <= links


# --- the rest --------------------------------------------------------------


def test_command_line_parses_once_and_resets_assets(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/My Doc.docx").write_bytes(package())
    (tmp_path / "in/a.pdf").write_bytes(packages.packed_pdf(1, "Some text in a file"))
    monkeypatch.chdir(tmp_path)
    log = tmp_path / "calls"
    monkeypatch.setattr(convert.files.docx, "to_html", counting(str(log), docx.to_html))
    for _ in range(2):
        assert cli.main([f"{tmp_path}/in/*", "-o", "out", "--progress"], spark) == 0
        outputs = [x for x in capsys.readouterr().out.split("\n") if x]
        for name in outputs:
            text = open(name, encoding="utf-8").read()
            for link in re.findall(r"!\[[^\]]*\]\(([^)]*)\)", text):
                assert os.path.isfile(os.path.join(os.path.dirname(name), link))
        folder = next(d for d, _, _ in os.walk(tmp_path / "out") if d.endswith("_assets"))
        assert sorted(os.listdir(folder)) == ["image-0001.png", "image-0002.emf", "image-0002.png"] or sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == ["image-0001.png", "image-0002.emf", "image-0002.png"]
        (tmp_path / folder / "stale.png").write_bytes(b"old")
    assert len(outputs) == 2


def test_registered_converters(spark):
    own = registry.Converter("upper", lambda ext, mime: ext == ".txt", lambda docs, options: convert.Conversion(docs.select("doc_id", F.upper(F.decode("content", "UTF-8")).alias("markdown"))), -2.0)
    docs = spark.createDataFrame([("a", ".txt", None, b"x"), ("b", ".md", None, b"y"), ("c", ".zzz", None, b"z")], "doc_id string, ext string, mime string, content binary")
    was = dict(registry.CONVERTERS)
    registry.register(own)
    try:
        assert {r.doc_id: r.markdown for r in convert.convert(docs).collect()} == {"a": "X", "b": "y"}
    finally:
        registry.CONVERTERS.clear()
        registry.CONVERTERS.update(was)
    assert list(registry.CONVERTERS)[:2] == ["pdf", "docx"] or set(list(registry.CONVERTERS)[:2]) == {"pdf", "docx"}
    assert quirespark.convert_path is convert.convert_path and quirespark.translate is translate.translate


def test_translation_retries_and_errors(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider(text, lang_in, lang_out):
        with open(log, "a") as f:
            f.write("call\n")
        if "bad" in text:
            raise TimeoutError("too slow")
        return text.upper()

    df = spark.createDataFrame([("d", "good one\n\nbad one\n\n`x`\n"), ("e", "fine"), ("f", None)], "doc_id string, markdown string")
    rows = {r.doc_id: r for r in translate.translated(df, provider, pause=0.0).collect()}
    assert rows["d"].markdown == "GOOD ONE\n\nbad one\n\n`x`\n" and rows["d"].translation_error == "TimeoutError: too slow"
    assert rows["e"].markdown == "FINE" and rows["e"].translation_error is None and rows["e"].blocks == 1


def test_reset_folders(spark, tmp_path):
    (tmp_path / "a_assets").mkdir()
    (tmp_path / "a_assets/x").write_text("old")
    assert sinks.reset_folders(spark.createDataFrame([("a_assets",), ("b_assets",), ("a_assets",)], "folder string"), str(tmp_path)) == 1
    assert not (tmp_path / "a_assets").exists()


def test_read_files_of_other_kinds(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(packages.packed_pdf(1, "Some text"))
    assert read_files(spark, str(tmp_path)).first().ext == ".pdf"


def test_command_line_translates(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "notes.md").write_text("# One\n\nsome text\n\nbad text\n")

    def provider(text, lang_in, lang_out):
        if "bad" in text:
            raise TimeoutError("too slow")
        return f"{lang_in}-{lang_out} {text}"

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(translate, "PAUSE", 0.0)
    assert cli.main(["translate", f"{tmp_path}/notes.md", "-o", "out", "--lang-out", "de", "--progress"], spark, provider) == 0
    said = capsys.readouterr()
    name = next(x for x in said.out.split("\n") if x)
    assert name.endswith("notes_de.md") and open(name).read() == "# en-de One\n\nen-de some text\n\nbad text\n"
    assert '"stage": "translation", "current": 3, "total": 3' in said.err and "TimeoutError: too slow" in said.err
