"""Rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quirespark.functions import files, geometry, headings, text
from quirespark.functions import markdown as md
from quirespark.operators import layout as L
from quirespark.operators.blocks import markdown_blocks
from quirespark.operators.progress import high_water


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "stem, short",
    [
        ("My Paper (final)", "My_Paper_(final)"),
        ("report_0123456789ab", "report"),
        ("report-123e4567-e89b-12d3-a456-426614174000", "report"),
        ("202401010101", "output"),
        ("deadbeefcafe", "output"),
        ("x" * 80, "x" * 63 + "-9a163175"),
        ("_".join(["alpha"] * 15), "_".join(["alpha"] * 10) + "-86356f01"),
    ],
)
def test_stems(spark, stem, short):
    assert one(spark, text.short_stem(F.lit(stem))) == short


@pytest.mark.parametrize(
    "source, target, suffix, output, assets",
    [
        ("in/My Doc.pdf", None, None, "output/My_Doc/My_Doc.md", "output/My_Doc/My_Doc_assets"),
        ("in/My Doc.pdf", "out", None, "out/My_Doc/My_Doc.md", "out/My_Doc/My_Doc_assets"),
        ("in/My Doc.pdf", "out/My_Doc", None, "out/My_Doc/My_Doc.md", "out/My_Doc/My_Doc_assets"),
        ("in/My Doc.pdf", "x/R 1.md", None, "x/R 1.md", "x/R_1_assets"),
        ("a.md", None, "_zh", "output/a_zh/a_zh.md", "output/a_zh/a_zh_assets"),
    ],
)
def test_layout(spark, source, target, suffix, output, assets):
    got = one(spark, text.output_layout(F.lit(source), F.lit(target).cast("string"), F.lit(suffix) if suffix else None))
    assert (got.output, got.assets_dir) == (output, assets)


@pytest.mark.parametrize("y0, y1, words, gone", [(10, 71, "x", True), (10, 72, "x", False), (753, 760, "x", True), (751, 760, "x", False), (725, 740, "see doi.org/1", True), (725, 740, "other", False)])
def test_margins(spark, y0, y1, words, gone):
    assert one(spark, geometry.is_margin(F.lit(words), F.lit(float(y0)), F.lit(float(y1)), F.lit(800.0))) is gone


HEADINGS = [
    ("a b s t r a c t", 10, False, 40, 240, "## Abstract"),
    ("1 Introduction The wind", 10, False, 40, 240, "## 1. Introduction\n\nThe wind"),
    ("2.1 Methods we use", 10, False, 40, 240, "### 2.1. Methods\n\nwe use"),
    ("Results", 10, False, 30, 120, "## Results"),
    ("results", 10, False, 30, 120, "results"),
    ("3.2.1 Setup", 10, True, 40, 240, "#### 3.2.1 Setup"),
    ("1 Introduction 2 Methods", 10, True, 40, 240, "## 1. Introduction\n\n## 2. Methods"),
    ("Figure 3 shows", 10, True, 40, 240, "Figure 3 shows"),
    ("第三章 结果", 10, False, 40, 240, "## 第三章 结果"),
]


@pytest.mark.parametrize("words, size, bold, x0, width, markdown", HEADINGS)
def test_headings(spark, words, size, bold, x0, width, markdown):
    c = [F.lit(words), F.lit(None).cast("string"), F.lit(float(size)), F.lit(bold), F.lit(False), F.lit(float(x0)), F.lit(float(x0 + width)), F.lit(float(width)), F.lit(10.0), F.lit(600.0)]
    assert one(spark, headings.heading_markdown(*c)) == markdown


def test_leading_span(spark):
    c = [F.lit("Abstract. The wind blows"), F.lit("Abstract."), F.lit(10.0), F.lit(False), F.lit(False), F.lit(40.0), F.lit(280.0), F.lit(240.0), F.lit(10.0), F.lit(600.0)]
    assert one(spark, headings.heading_markdown(*c)) == "## Abstract\n\nThe wind blows"


def boxes(spark, rows):
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], "doc_id string, page_no int, seq int, label string, confidence double, x0 int, y0 int, x1 int, y1 int")


@pytest.mark.parametrize(
    "rows",
    [
        [("table", 0.9, 0, 0, 100, 100), ("table", 0.8, 0, 0, 100, 81), ("figure", 0.7, 0, 0, 100, 100)],
        [("table", 0.9, 0, 0, 100, 50), ("table", 0.8, 10, 0, 110, 50), ("table", 0.7, 21, 0, 121, 50)],
    ],
)
def test_region_fold(spark, rows):
    assert {r.seq for r in L.deduplicated_regions(boxes(spark, rows)).collect()} == {0, 2}


def test_region_exclusion(spark):
    block = spark.createDataFrame([("d", 1, 0.0, 0.0, 100.0, 10.0)], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert L.outside_regions(block, boxes(spark, [("isolate_formula", 1.0, 0, 0, 9, 10)])).count() == 0
    assert L.outside_regions(block, boxes(spark, [("figure", 1.0, 0, 0, 9, 10)])).count() == 1


@pytest.mark.parametrize("low, order", [((130, 150), "T L1 L2 R1 R2"), ((150, 170), "T L1 R1 L2 R2")])
def test_columns(spark, low, order):
    rows = [("T", 40, 560, 50, 70), ("L1", 40, 280, 100, 120), ("R1", 320, 560, 100, 120), ("L2", 40, 280, *low), ("R2", 320, 560, *low)]
    items = spark.createDataFrame([("d", 1, i, float(a), float(c), float(b), float(e), float(b - a), t) for i, (t, a, b, c, e) in enumerate(rows)], "doc_id string, page_no int, item_no int, x0 double, y0 double, x1 double, y1 double, width double, text string")
    assert L.page_text(items, F.lit(600.0)).first().text == order.replace(" ", "\n\n")


@pytest.mark.parametrize("starts, split", [([40.0, 100.0], 70.0), ([40.0, 60.0], 300.0), ([40.0], 300.0), ([40.0, 320.0], 180.0)])
def test_split_point(spark, starts, split):
    assert one(spark, L.split_point(F.lit(starts), F.lit(300.0))) == split


def test_latex(spark):
    fence = "`" * 3
    assert one(spark, text.cleaned_latex(F.lit(f"{fence}latex\n$$x$$\n{fence}"))) == "x"
    assert one(spark, text.cleaned_latex(F.lit("$"))) is None
    assert one(spark, text.fixed_symbols(F.lit("a≤b"))) == "a\\le b"
    assert one(spark, text.unescaped_math(F.lit("a $x\\_1$ b\\_c"))) == "a $x_1$ b\\_c"


def test_tables(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit(None).cast("string"), F.lit("")), F.array(F.lit("1")))
    assert one(spark, text.pipe_table(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, text.style_line(F.lit("Custom"), F.lit(0))) == "p[style-name='Custom'] => h1:fresh"
    assert one(spark, text.style_line(F.lit("TOC 1"), F.lit(0))) is None and one(spark, text.style_line(F.lit("x"), F.lit(9))) is None
    html = '<table><tr><td rowspan="x">1</td></tr></table>'
    assert one(spark, text.has_merged_cells(F.lit(html))) is False and one(spark, text.has_merged_cells(F.lit(html.replace("x", "2")))) is True


def test_markdown_blocks(spark):
    fence = "`" * 3
    body = f"# T\nline\n\n{fence}\nx\n{fence}\n| a |\n123\n"
    rows = markdown_blocks(spark.createDataFrame([("d", body)], "doc_id string, markdown string")).orderBy("block_no").collect()
    assert len(rows) == 7 and [r.translatable for r in rows] == [True] + [False] * 6 and "".join(r.text for r in rows) == body


@pytest.mark.parametrize("line, prefix", [("## Title", "## "), ("  - item", "  - "), ("12) x", "12) "), ("#hash", "")])
def test_prefix(spark, line, prefix):
    assert one(spark, md.prefix_split(F.lit(line))).prefix == prefix == md.python_prefix(line)[0]


def test_protection(spark):
    raw = "`a` [b](c) $x$ <br> and \\$5 then [![i](j)](k) {V7}"
    p = one(spark, md.protect(F.lit(raw)))
    assert "`" not in p.text and "<br>" not in p.text
    assert one(spark, md.restore(md.protect(F.lit(raw))["text"], md.protect(F.lit(raw))["spans"])) == raw
    plain = one(spark, md.protect(F.lit("`a` [b](c) $x$ <br>")))
    assert plain.text == "{v1} {v0} {v2} {v3}"
    spaced = F.lit("{ V0 } x")
    assert one(spark, md.restore(spaced, md.protect(F.lit("`\\lambda$1`"))["spans"])) == "`\\lambda$1` x"


@pytest.mark.parametrize("words, limit, chunks", [("Aa bb. Cc dd. Ee", 10, ["Aa bb.", "Cc dd. Ee"]), ("abcdefghijklm", 5, ["abcde", "fghij", "klm"]), ("", 5, [""]), ("abcdefghij", 5, ["abcde", "fghij"])])
def test_chunks(spark, words, limit, chunks):
    assert one(spark, md.chunks(F.lit(words), limit)) == chunks


def test_progress(spark):
    events = spark.createDataFrame([("r", 1, "pages", 5, 10), ("r", 2, "docx", 1, 4)], "run_id string, seq long, stage string, current int, total int")
    assert [round(r.progress, 4) for r in high_water(events).orderBy("seq").collect()] == [0.425, 0.425]
    assert one(spark, files.stage_progress(F.lit("pages"), F.lit(5), F.lit(0))) == 0.05


def test_space_of_every_kind(spark):
    assert one(spark, text.squeeze(F.lit("  a　b c\x1cd\x85e "))) == "a b c d e"


def test_a_table_cleans_its_cells_once(spark):
    """What one row is drawn from must not be worked out anew for each row: that is quadratic in a table's rows."""
    drawn = spark.createDataFrame([([["h", "i"]] + [[str(i), None] for i in range(300)],)], "rows array<array<string>>").select(text.pipe_table(F.col("rows")).alias("t"))
    assert drawn.first().t.split("\n") == ["| h | i |", "| --- | --- |", *[f"| {i} |  |" for i in range(300)]]
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


@pytest.mark.parametrize("words, title", [("Case Study.", True), ("2 BacKground:", True), ("methods..", True), ("Methods, new", False), ("abstract" * 9, False), ("Ünlü", False)])
def test_titles_by_their_form(spark, words, title):
    assert one(spark, headings.academic_title(F.lit(words))) is title


@pytest.mark.parametrize("words", ["", " \t\n", "  \x1c", "　x", " a ", "."])
def test_what_is_visible_is_left(spark, words):
    assert one(spark, text.visible(F.lit(words))) == bool(one(spark, text.squeeze(F.lit(words))))
