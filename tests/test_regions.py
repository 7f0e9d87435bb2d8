"""Ruled tables, pictures of regions, and paddings and scales by label."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark import queries
from quirespark.plans import convert, packages
from quirespark.providers import Providers
from quirespark.sources import pdf, pictures, ruling

from .test_conversion import one_page


def grid(xs, ys, without=()):
    """The rules of a grid, a stretch at a time; ``without``: ``("h", column, line)`` and ``("v", line, row)`` that are missing."""
    out = [(xs[i], y, xs[i + 1], y) for j, y in enumerate(ys) for i in range(len(xs) - 1) if ("h", i, j) not in without]
    return out + [(x, ys[j], x, ys[j + 1]) for i, x in enumerate(xs) for j in range(len(ys) - 1) if ("v", i, j) not in without]


def boxes(table):
    return [[None if c is None else tuple(round(v) for v in c) for c in row] for row in table.rows]


def test_merged_lines():
    assert ruling.merged([(10, 0, 5), (11, 4, 9), (10.5, 11, 20), (30, 0, 2), (40, 5, 50)]) == [(10.5, 0, 20), (40.0, 5, 50)]


def test_grids():
    (t,) = ruling.tables(grid([10, 60, 110], [10, 30, 50]))
    assert boxes(t) == [[(10, 10, 60, 30), (60, 10, 110, 30)], [(10, 30, 60, 50), (60, 30, 110, 50)]] and t[:4] == (10, 10, 110, 50)
    (t,) = ruling.tables(grid([10, 60, 110], [10, 30, 50], {("v", 1, 0)}))  # a heading over both columns
    assert boxes(t) == [[(10, 10, 110, 30), None], [(10, 30, 60, 50), (60, 30, 110, 50)]]
    (t,) = ruling.tables(grid([10, 60, 110], [10, 30, 50], {("h", 1, 1)}))  # a cell over two rows
    assert boxes(t) == [[(10, 10, 60, 30), (60, 10, 110, 50)], [(10, 30, 60, 50), None]]
    assert ruling.tables(grid([10, 110], [10, 50])) == []  # a frame
    assert ruling.tables(grid([10, 60, 110], [10, 30], {("v", 2, 0)})) == []  # one enclosed cell, and an open one
    assert ruling.tables([(0, y, 500, y) for y in range(0, 100, 10)]) == [] == ruling.tables([])  # lines of a form


def test_tables_beside_and_below_each_other():
    rules = grid([10, 60, 110], [10, 30, 50]) + grid([200, 260, 310], [10, 30, 50]) + grid([10, 60, 110], [100, 130, 150, 170])
    assert [tuple(map(round, t[:4])) for t in ruling.tables(rules)] == [(10, 10, 110, 50), (200, 10, 310, 50), (10, 100, 110, 170)]


def test_crooked_and_broken_lines():
    rules = [(x0 + 0.8 * (i % 3), y0 - 0.7 * (i % 2), x1 + 0.4, y1) if abs(x1 - x0) > abs(y1 - y0) else (x0, y0 - 0.5, x0, y1 + 0.5) for i, (x0, y0, x1, y1) in enumerate(grid([10, 60, 110], [10, 30, 50]))]
    assert len(ruling.tables(rules)) == 1 and len(ruling.tables(rules)[0].rows) == 2


@pytest.mark.parametrize("pages", [1, 3])
def test_ruled_tables_of_files(pages):
    body = "\n".join(f"line {i} | of (text)" for i in range(10 * pages))
    found, blocks, failed, tables = pdf.read(packages.table_pdf(1, body))
    assert len(found) == pages and not failed and [len(t) for t in tables.values()] == [1] * pages
    rows = [r for t in tables.values() for r in t[0][4]]
    assert [r for r in rows if r[0].isdigit()] == [[str(i), f"line {i} | of (text)", str(len(f"line {i} | of (text)"))] for i in range(10 * pages)]
    assert (pages < 3) or ["title of page 3", "", ""] in rows


def docs(spark, content, assets="x_assets"):
    return spark.createDataFrame([("d", content)], "doc_id string, content binary").withColumn("assets", F.lit(assets))


def test_tables_need_no_provider(spark):
    content = packages.table_pdf(1, "first | line\nsecond")
    text = convert.pdf_markdown(docs(spark, content), table_text=True).first().markdown
    assert text == "<!-- page 1 -->\n\n| no | line | n |\n| --- | --- | --- |\n| 0 | first \\| line | 12 |\n| 1 | second | 6 |"
    plain = convert.pdf_markdown(docs(spark, content)).first().markdown  # without a picture the text stays
    assert "first | line" in plain and "---" not in plain
    made = convert.pdf_conversion(docs(spark, content), providers=Providers(render=lambda data, page, box: b"PNG"))
    assert made.documents.first().markdown == "<!-- page 1 -->\n\n![table page 1](x_assets/page-0001-01-table.png)"
    assert [(r.rel_path, bytes(r.content)) for r in made.assets.collect()] == [("page-0001-01-table.png", b"PNG")]


def test_paddings_and_scales(spark, tmp_path):
    """Tables 3 points at 3 pixels, figures 2 at 2, formulas 4 at 4; nothing beyond the page."""
    log = str(tmp_path / "log")

    def layout(content, page_no, width, height):
        return [("figure", 0.9, 100, 100, 200, 150), ("isolate_formula", 0.9, 100, 200, 200, 250), ("table", 0.9, 1, 300, 200, 350)]

    def seen(kind):
        def run(data, page, box, scale):
            with open(log, "a") as f:
                f.write(f"{kind} {box} {scale}\n")
            return b"PNG" if kind == "draw" else "x"

        return run

    content = one_page(b"BT /F1 12 Tf 1 0 0 1 50 50 Tm (text) Tj ET")
    made = convert.pdf_conversion(docs(spark, content), providers=Providers(layout=layout, render=seen("draw"), formula=seen("read")))
    made.documents.collect()
    assert set(open(log).read().splitlines()) == {"draw (98.0, 98.0, 202.0, 152.0) 2.0", "draw (0.0, 297.0, 203.0, 353.0) 3.0", "read (96.0, 196.0, 204.0, 254.0) 4.0"}


# --- pictures ------------------------------------------------------------------


def decoded(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    width, height, _, colour = struct.unpack(">IIBB", data[16:26])
    n, body = {0: 1, 2: 3}[colour], b""
    at = 33
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        body += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * n + 1)[:, 1:].reshape(height, width, n)


def with_image(samples, head, place=b"200 0 0 100 50 600", filters=b"/FlateDecode", packed=None):
    data = zlib.compress(samples) if packed is None else packed
    image = b"<</Type/XObject/Subtype/Image%s/Filter%s/Length %d>>\nstream\n%s\nendstream" % (head, filters, len(data), data)
    return one_page(b"q %s cm /Im Do Q" % place, page=b"/Resources<</XObject<</Im 9 0 R>>>>", more={9: image})


RGB = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 10, 20, 30])  # two rows of two pixels


def test_regions_over_images():
    content = with_image(RGB, b"/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8")
    whole = decoded(pictures.render(content, 1, (50, 100, 250, 200), 1.0))  # the page is 800 high
    assert whole.shape == (100, 200, 3) and [whole[y, x].tolist() for y in (0, 99) for x in (0, 199)] == [[255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 20, 30]]
    part = decoded(pictures.render(content, 1, (160, 160, 250, 200), 2.0))
    assert part.shape == (80, 180, 3) and (part == [10, 20, 30]).all()
    edge = decoded(pictures.render(content, 1, (40, 100, 140, 140), 1.0))
    assert (edge[:, :10] == 255).all() and edge[5, 15].tolist() == [255, 0, 0]
    assert pictures.render(content, 1, (300, 300, 400, 400), 1.0) is None and pictures.render(content, 2, (50, 100, 250, 200)) is None
    flipped = decoded(pictures.render(with_image(RGB, b"/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8", b"-200 0 0 -100 250 700"), 1, (50, 100, 250, 200), 1.0))
    assert flipped[0, 0].tolist() == [10, 20, 30] and flipped[99, 199].tolist() == [255, 0, 0]


@pytest.mark.parametrize(
    ("samples", "head", "want"),
    [
        (bytes([0, 255]), b"/Width 2/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8", [[0], [255]]),
        (bytes([0b01000000]), b"/Width 2/Height 1/ColorSpace/DeviceGray/BitsPerComponent 1", [[0], [255]]),
        (bytes([0b01000000]), b"/Width 2/Height 1/ImageMask true/Decode[1 0]", [[255], [0]]),
        (bytes([0b00011011, 0]), b"/Width 4/Height 1/ColorSpace/DeviceGray/BitsPerComponent 2", [[0], [85], [170], [255]]),
        (bytes([0, 9, 255, 9]), b"/Width 2/Height 1/ColorSpace/DeviceGray/BitsPerComponent 16", [[0], [255]]),
        (bytes([1, 0]), b"/Width 2/Height 1/ColorSpace[/Indexed/DeviceRGB 1 <010203FFFEFD>]/BitsPerComponent 8", [[255, 254, 253], [1, 2, 3]]),
        (bytes([0, 0, 0, 0, 255, 0, 0, 0]), b"/Width 2/Height 1/ColorSpace/DeviceCMYK/BitsPerComponent 8", [[255, 255, 255], [0, 255, 255]]),
    ],
)
def test_kinds_of_images(samples, head, want):
    n = len(want)
    got = decoded(pictures.render(with_image(samples, head), 1, (50, 100, 250, 200), n / 200))
    assert got[0].tolist() == want


def test_images_that_pass_through_or_are_left():
    jpeg = b"\xff\xd8\xff\xe0 a jpeg \xff\xd9"
    content = with_image(b"", b"/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8", filters=b"/DCTDecode", packed=jpeg)
    assert pictures.render(content, 1, (50, 100, 250, 200), 2.0) == jpeg and pictures.render(content, 1, (50, 100, 90, 120), 2.0) is None
    packed = with_image(b"", b"/Width 2/Height 2", filters=b"[/FlateDecode/DCTDecode]", packed=zlib.compress(jpeg))
    assert pictures.render(packed, 1, (50, 100, 250, 200), 2.0) == jpeg
    other = with_image(b"", b"/Width 2/Height 2", filters=b"/JPXDecode", packed=b"x")
    assert pictures.render(other, 1, (50, 100, 250, 200), 2.0) is None
    askew = with_image(RGB, b"/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8", b"100 100 -100 100 150 600")
    assert pictures.render(askew, 1, (50, 0, 250, 200), 2.0) is None
    short = with_image(RGB[:4], b"/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8")
    assert decoded(pictures.render(short, 1, (50, 100, 250, 200), 1.0))[99, 199].tolist() == [0, 0, 0]


def test_figures_get_their_pixels_without_a_provider(spark):
    content = with_image(RGB, b"/Width 2/Height 2/ColorSpace/DeviceRGB/BitsPerComponent 8")

    def layout(data, no, width, height):
        return [("figure", 0.9, 50, 100, 250, 200), ("figure", 0.8, 300, 300, 400, 400)]

    made = convert.pdf_conversion(docs(spark, content), providers=Providers(layout=layout))
    (asset,) = made.assets.collect()
    assert asset.rel_path == "page-0001-01-figure.png" and asset.mime == "image/png" and decoded(asset.content).shape == (208, 408, 3)
    assert made.documents.first().markdown == "<!-- page 1 -->\n\n![figure page 1](x_assets/page-0001-01-figure.png)"


def test_pages_join_on_executors(spark, sf):
    """Stored lists of regions take up a hundredth of their size in files: no plan may count on that and send them through the driver."""
    made = queries.pdf_regions(spark, sf)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 5
    assert made.count() == 200
