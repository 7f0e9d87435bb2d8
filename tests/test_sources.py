"""Parsers, conversion end to end, sinks, streaming and the command line."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quirespark import cli, queries
from quirespark.operators.styles import style_map
from quirespark.plans import convert, packages, pages, sinks, translate
from quirespark.sources import docx, html, pdf
from quirespark.sources.files import read_files

NS = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)


def package():
    """Styles, an outline level set in a paragraph, formulas, a merged table, two images."""
    styles = (
        f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="A"><w:name w:val="Chapter"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style>'
        '<w:style w:type="paragraph" w:styleId="B"><w:name w:val="TOC 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>'
        '<w:style w:type="paragraph" w:styleId="C"><w:name w:val="Part"/></w:style><w:style w:type="character" w:styleId="D"><w:name w:val="x"/></w:style></w:styles>'
    )
    p = lambda s, style=None, more="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/>{more}</w:pPr>" if style else ""}<w:r><w:t>{s}</w:t></w:r></w:p>'
    math = "<m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>"
    image = '<w:p><w:r><w:drawing><a:blip r:embed="{}"/></w:drawing></w:r></w:p>'
    table = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("wide")}</w:tc></w:tr><w:tr><w:tc>{p("l")}</w:tc><w:tc>{p("r")}</w:tc></w:tr></w:tbl>'
    flat = f"<w:tbl><w:tr><w:tc>{p('h')}</w:tc></w:tr><w:tr><w:tc>{p('a|b')}</w:tc></w:tr></w:tbl>"
    body = p("One", "C", '<w:outlineLvl w:val="0"/>') + p("Two", "A") + p("Contents", "B") + p("Text &amp; <![CDATA[<more>]]>") + f"<w:p><m:oMathPara>{math}</m:oMathPara></w:p><w:p>{math}</w:p>" + table + flat + image.format("i1") + image.format("i2")
    rels = '<Relationships><Relationship Id="i1" Target="media/a.png"/><Relationship Id="i2" Target="media/b.emf"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in {"word/styles.xml": styles, "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/media/a.png": "PNG", "word/media/b.emf": "EMF"}.items():
            z.writestr(name, data)
    return out.getvalue()


WORD = "# One\n\n### Two\n\nContents\n\nText & <more>\n\n$${x}^{2}$$\n\n${x}^{2}$\n\n"


def test_docx():
    parts = docx.parts(package())
    assert docx.count_images(parts) == 2 and docx.heading_levels(parts) == {"C": 1, "A": 3}
    shown, images, _ = docx.to_html(package())
    assert [i[:2] for i in images] == [("image-0001.png", "image/png"), ("image-0002.emf", "image/x-emf"), ("image-0002.png", "image/png")]
    text, _ = html.to_markdown(shown.split("<table>")[0])
    assert text + "\n\n" == WORD


def test_html():
    page = "<title>T</title><h2>A</h2><p>x <b>y</b> <a href='u'>z</a></p><ol><li>1<ul><li>in</li></ul></li><li>2</li></ol><pre>a\n b</pre><table><tr><th>h</th></tr><tr><td>c|d</td></tr></table><script>no</script>"
    text, title = html.to_markdown(page)
    assert title == "T" and "## A\n\nx **y** [z](u)" in text and "| c\\|d |" in text and "no" not in text and "1. 1" in text and "  * in" in text
    assert html.to_markdown(None) == ("", None)


def test_pdf_provider():
    assert pdf.parse(packages.pdf(1, "one (1)\ntwo\\"))[1][0][4][0]["spans"][0]["text"] == "one (1)"
    found, blocks = pdf.parse(packages.pdf(1, "\n".join(map(str, range(30)))))
    assert [p[0] for p in found] == [1, 2, 3] and len(blocks) == 30
    assert pdf.parse(b"nothing") == ([], [])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/My Doc.docx").write_bytes(package())
    (tmp_path / "in/a.PDF").write_bytes(packages.pdf(1, "1 Introduction The wind blows here\nsecond line of the text"))
    (tmp_path / "in/b.html").write_text("<h1>B</h1><p>b</p>")
    (tmp_path / "in/c.txt").write_text("plain")
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    (tmp_path / "in/other.xyz").write_bytes(b"?")
    return tmp_path


def test_convert(spark, folder):
    rows = {os.path.basename(r.doc_id): r for r in convert.convert(read_files(spark, f"{folder}/in/*")).collect()}
    assert sorted(rows) == ["My%20Doc.docx", "a.PDF", "b.html", "broken.docx", "c.txt"] or sorted(rows) == ["My Doc.docx", "a.PDF", "b.html", "broken.docx", "c.txt"]
    word = next(r for n, r in rows.items() if n.startswith("My"))
    assert word.markdown.startswith(WORD) and '<table><tr><td colspan="2">wide</td></tr>' in word.markdown and "| a\\|b |" in word.markdown and "![](image-0002.png)" in word.markdown
    assert rows["a.PDF"].markdown == "<!-- page 1 -->\n\n## 1. Introduction\n\nThe wind blows here\n\nsecond line of the text"
    assert rows["b.html"].markdown == "# B\n\nb" and rows["c.txt"].markdown == "plain"
    assert rows["broken.docx"].markdown is None and "BadZipFile" in rows["broken.docx"].error


def test_fallback(spark):
    full = spark.createDataFrame([("a", None, "boom"), ("b", "  ", None), ("c", "text", None)], "doc_id string, markdown string, error string")
    quick = spark.createDataFrame([("a", "fa"), ("b", "fb"), ("c", "fc")], "doc_id string, markdown string")
    got = {r.doc_id: r.markdown for r in pages.with_fallback(full, quick).collect()}
    assert got == {"a": "<!-- academic mode failed: boom -->\n\nfa", "b": "fb", "c": "text"}
    failing = spark.createDataFrame([("a", b"x")], "doc_id string, content binary")

    def provider(_):
        raise ValueError("no")

    assert "ValueError: no" in convert.pdf_markdown(failing, provider=provider).first().error


def test_translation(spark):
    df = spark.createDataFrame([("d", "# Title\n\nSome `code` here. More.\n\n123\n")], "doc_id string, markdown string")
    got = translate.translate(df, lambda text, a, b: text.upper()).first().markdown
    assert got == "# TITLE\n\nSOME `code` HERE. MORE.\n\n123\n"
    with pytest.raises(ValueError):
        translate.translate(df, service="none")


def test_files_and_stream(spark, folder, monkeypatch, capsys):
    docs = sinks.placed(spark.createDataFrame([("in/x y.pdf", "é")], "doc_id string, markdown string"))
    assert sinks.write_files(sinks.markdown_files(docs), str(folder)) == 1
    assert (folder / "output/x_y/x_y.md").read_text() == "é"
    from quirespark.streaming.ingest import watch

    watch(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state").awaitTermination()
    assert spark.read.parquet(f"{folder}/table").count() == 5
    monkeypatch.chdir(folder)
    assert cli.main([f"{folder}/in/*.docx", "-o", "done", "--progress"], spark) == 0
    assert any(p.endswith("My_Doc.md") or p.endswith("Doc.md") for p in capsys.readouterr().out.split("\n"))
    assert cli.main([], spark) == 0 and cli.with_command(["x"]) == ["convert", "x"] and cli.with_command(["-h"]) == ["-h"]


def test_style_levels(spark):
    names = spark.createDataFrame([("d", "A", "It's"), ("d", "B", "toc 2")], "doc_id string, style_id string, name string")
    levels = spark.createDataFrame([("d", "A", "3", 0), ("d", "A", "1", 1), ("d", "B", "0", 2), ("d", "X", "0", 3), ("d", "A", "bad", 4)], "doc_id string, style_id string, level string, ord int")
    assert style_map(names, levels).first().style_map == "p[style-name='It\\'s'] => h2:fresh"


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(queries.QUERIES) <= set(driver.queries())


def test_files_are_built_by_several_tasks(spark, sf):
    """A table of one row group is one task's: its rows are dealt out, each once, and handed on in small batches."""
    from quirespark import queries
    from quirespark.plans import packages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = queries.built(spark, sf, packages.pdf)
    assert docs.rdd.getNumPartitions() < made.rdd.getNumPartitions()
    want = {r.doc_id: packages.pdf(r.doc_id, r.text) for r in docs.collect()}
    rows = made.collect()
    assert len(rows) == len(want) and {r.doc_id: bytes(r.content) for r in rows} == want


def test_large_pages_are_handed_on_in_parts():
    from quirespark.sources import files

    row = {"blocks": [{}] * 12, "tables": [{"rows": [["a", "b", "c"]] * 4}]}
    assert files.weight(row) == 12 * 1024 + 4 * 3 * 64 and files.weight({"error": "e"}) == 0 and files.weight({"html": "abc"}) == 3


def test_plain_values_equal_other_ones():
    """Numbers, operators, hex and literal strings that are read at once are what they are otherwise."""
    from quirespark.sources import pdf

    data = b"1 -2.5 +3 .5 4. --5 1.2.3 T* ' \" true null BT[1(a)2]<</A 1>> <48656C> <4 8 6> <abc> (a\\)b) (a(b)c) (plain) % note\n/N#41 f*q 7"

    def every(references):
        reader, out = pdf.Reader(data, references=references), []
        while (found := reader.value()) is not pdf.END:
            out.append((type(found), found))
        return out

    assert every(True) == every(False)
    assert [v for _, v in every(False)][:5] == [1, -2.5, 3, 0.5, 4.0] and (bytes, b"plain") in every(False) and (bytes, b"\xab\xc0") in every(False)
