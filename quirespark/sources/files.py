"""Files in, tables out: listing, dispatch and the providers' tables.

Spark lists paths and sizes; content is no column. The rows of a listing are dealt out by bytes, and the task that parses a
file opens it, once. Documents may also come with a ``content`` column (tables of files, for instance): it
crosses over in Arrow batches and goes no further than its own stage. A provider runs once for each file. A file
that can't be opened or parsed is a row with an error, not a failed job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..providers import Providers, ready
from . import docx, html, pdf
from .listing import listing, reachable, store_of

DETECTED = T.ArrayType(
    T.StructType(
        [T.StructField("seq", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")]]
    )
)
FOUND = T.ArrayType(T.StructType([*DETECTED.elementType.fields, T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))
PLACED = T.ArrayType(T.StructType([T.StructField("block_no", T.IntegerType()), T.StructField("type", T.IntegerType()), T.StructField("bbox", schemas.BBOX), T.StructField("lines", schemas.LINES)]))
PDF = [
    T.StructField("assets", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("page_width", T.DoubleType()),
    T.StructField("page_height", T.DoubleType()),
    T.StructField("blocks", PLACED),
    T.StructField("regions", DETECTED),
    T.StructField("tables", FOUND),
    T.StructField("note", T.StringType()),
    T.StructField("error", T.StringType()),
]
IMAGES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("mime", T.StringType()), T.StructField("content", T.BinaryType())]))
DOCX = [T.StructField("assets", T.StringType()), T.StructField("html", T.StringType()), T.StructField("title", T.StringType()), T.StructField("images", IMAGES), T.StructField("error", T.StringType())]
MARKDOWN = "markdown string, title string"
#: Bytes of content whose rows are handed on together, or of what they take up by ``weight``.
BATCH_BYTES = 4 << 20


#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
#: Tasks whose files are dealt out together, by a running sum of their sizes.
TOGETHER = 64
TEXT = [T.StructField("assets", T.StringType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]


def read_files(spark: SparkSession, path: str, stream: bool = False, endings: Iterable[str] = ()) -> DataFrame:
    """``DOCS`` of a path or glob; the id is the path. Spark reads the content, of files with one of ``endings`` alone if there are any."""
    return described(_binary(spark, stream, endings).load(path), "content")


def list_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``DOCS`` with ``length`` in place of ``content``: nothing is opened.

    Of streams, and of stores that workers can't open, Spark's own source lists the files; it leaves out empty ones.
    """
    return described(_binary(spark, stream).load(path) if stream or not reachable(path) else listing(spark, path), "length")


def _binary(spark: SparkSession, stream: bool, endings: Iterable[str] = ()):
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings)
    return reader.format("binaryFile").option("pathGlobFilter", f"*{{{either}}}") if either else reader.format("binaryFile")


def described(files: DataFrame, kept: str = "content") -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)\z", 1))
    stem = F.regexp_replace(name, r"\.[^.]+\z", "")
    return files.select(F.col("path").alias("doc_id"), "path", ext.alias("ext"), F.lit(None).cast("string").alias("mime"), stem.alias("stem"), kept)


def read_path(path: str) -> bytes:
    store, name = store_of(path)
    with store.open_input_file(name) as f:
        return f.read()


def is_listing(docs: DataFrame) -> bool:
    return "content" not in docs.columns


def balanced(listed: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of a listing, about as many bytes in each partition; what is shuffled are paths.

    A running sum within groups of some ``TOGETHER`` tasks deals the files out, large ones first, so that no window spans the
    listing. A partition exceeds its share by one file at most.
    """
    size = F.coalesce(F.col("length"), F.lit(0)) + 4096  # opening a file costs something as well
    total, rows = listed.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    parts = max(1, math.ceil(total / task_bytes), min(rows, listed.sparkSession.sparkContext.defaultParallelism))
    groups = math.ceil(parts / TOGETHER)
    share = max(1.0, total / parts)
    own = Window.partitionBy("__group").orderBy(F.desc("length"), "path").rowsBetween(Window.unboundedPreceding, -1)
    grouped = listed.withColumn("__group", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int"))
    before = F.coalesce(F.sum(size).over(own), F.lit(0))
    dealt = grouped.withColumn("__part", F.pmod(F.col("__group") * F.lit(math.ceil(parts / groups)) + F.floor(before / F.lit(share)), F.lit(parts)).cast("int"))
    return dealt.repartitionById(parts, F.col("__part")).drop("__group", "__part")


def with_content(docs: DataFrame, opener: Callable[[str], bytes] = read_path) -> DataFrame:
    """A listing with a ``content`` column, for converters that want one; files that can't be opened have none."""
    if not is_listing(docs):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    data = opener(row.column("path")[0].as_py())
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*names, "content"])

    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField("content", T.BinaryType())])
    return balanced(docs).mapInArrow(run, schema)


def failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def weight(row: dict) -> int:
    """About the bytes of a row's text, blocks and tables in memory, at a low guess: 1 KB for each block."""
    return len(row.get("html") or "") + 1024 * len(row.get("blocks") or ()) + sum(64 * len(r) for t in row.get("tables") or () for r in t.get("rows") or ())


def each_file(docs: DataFrame, fields: list[T.StructField], parse: Callable[[bytes, str | None], Iterable[dict]], failed: dict | None = None, opener: Callable[[str], bytes] = read_path) -> DataFrame:
    """The rows ``(doc_id, *fields)`` that ``parse`` makes of ``(content, assets)``, which is called once for each file.

    ``docs`` is a listing, whose files are opened here, or has their content. A file that can't be opened or that ``parse`` fails on
    is one row of ``failed`` and its ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields])
    shape, listing = to_arrow_schema(schema), is_listing(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            for doc, given, assets in zip(*batch.columns, strict=True):
                key, folder, size = doc.as_py(), assets.as_py(), 0
                try:
                    data = opener(given.as_py()) if listing else given.as_buffer().to_pybytes() if given.is_valid else b""
                    size = len(data)
                    rows = list(parse(data, folder))
                except Exception as e:
                    rows = [{**(failed or {}), "error": failure(e)}]
                data = None
                size = max(size, sum(map(weight, rows)))  # packed files grow many times
                kept.extend({"doc_id": key, "assets": folder, **row} for row in rows)
                held += size
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(kept, schema=shape)
                    kept, held = [], 0
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema=shape)

    folder = F.col("assets") if "assets" in docs.columns else F.lit(None).cast("string")
    given = balanced(docs.select("doc_id", "path", "length", folder.alias("assets"))).select("doc_id", "path", "assets") if listing else docs.select("doc_id", F.col("content").cast("binary").alias("content"), folder.alias("assets"))
    return given.mapInArrow(run, schema)


def parsed_text(docs: DataFrame, opener: Callable[[str], bytes] = read_path) -> DataFrame:
    """``(doc_id, assets, text, error)`` of text files in UTF-8; bytes that are none become U+FFFD."""
    return each_file(docs, TEXT, lambda data, _: [{"text": data.decode("utf-8", "replace")}], opener=opener)


def parsed_pdf(docs: DataFrame, provider: Callable = pdf.read, providers: Providers | None = None, opener: Callable[[str], bytes] = read_path) -> DataFrame:
    """``(doc_id, assets, page_no, pages, page_width, page_height, blocks, regions, tables, note, error)``: a row for
    each page, and one without a page for a file that fails or has none. Where the layout of a page can't be
    detected, or a page read, ``note`` says why, and the page goes on without regions (or text). Found tables are the
    provider's, or else those that the page's ruling lines enclose, which have ``rows`` of text.
    """
    chosen = providers or Providers()

    def parse(data: bytes, _) -> list[dict]:
        pages, blocks, *rest = provider(data)
        failed, ruled = (*rest, {}, {})[:2]
        if not pages:
            return [{"error": "ValueError: no pages were found"}]
        by_page: dict[int, list] = {}
        for number, block_no, kind, bbox, lines in blocks:
            by_page.setdefault(number, []).append({"block_no": block_no, "type": kind, "bbox": bbox, "lines": lines})
        layout, tables = ready(chosen.layout, chosen.cache), ready(chosen.tables, chosen.cache)
        out = []
        for number, width, height in pages:
            note, regions, found = failed.get(number), [], []
            if layout is not None and note is None:
                try:
                    regions = [box_row(i, *r) for i, r in enumerate(layout(data, number, width, height))]
                except Exception as e:
                    note = failure(e)
            if tables is None:
                found = [{**box_row(i, "table", 1.0, *t[:4]), "rows": t[4]} for i, t in enumerate(ruled.get(number, []))]
            else:
                try:
                    found = [box_row(i, "table", 1.0, *t) for i, t in enumerate(tables(data, number, width, height))]
                except Exception:  # a page without found tables
                    found = []
            out.append({"page_no": number, "pages": len(pages), "page_width": float(width), "page_height": float(height), "blocks": by_page.get(number, []), "regions": regions, "tables": found, "note": note})
        return out

    return each_file(docs, PDF, parse, opener=opener)


def box_row(seq: int, label: str, confidence: float, x0: float, y0: float, x1: float, y1: float) -> dict:
    return {"seq": seq, "label": label, "confidence": float(confidence), "x0": int(x0), "y0": int(y0), "x1": int(x1), "y1": int(y1)}


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks with their page's size, boxes spread out."""
    each = pages.select("doc_id", "page_no", "page_width", "page_height", F.explode("blocks").alias("b"))
    return each.select("doc_id", "page_no", "page_width", "page_height", "b.block_no", F.col("b.block_no").alias("item_no"), "b.type", "b.bbox.*", "b.lines").withColumn("width", F.col("x1") - F.col("x0"))


def page_regions(pages: DataFrame, name: str) -> DataFrame:
    return pages.select("doc_id", "page_no", F.explode(name).alias("r")).select("doc_id", "page_no", "r.*")


def parsed_docx(docs: DataFrame, style_map: str | None = None, opener: Callable[[str], bytes] = read_path) -> DataFrame:
    """``(doc_id, assets, html, title, images, error)`` of Word packages; images are named below ``assets`` if that is given."""

    def parse(data: bytes, folder: str | None) -> list[dict]:
        text, images, title = docx.to_html(data, folder, style_map)
        return [{"html": text, "title": title, "images": [dict(zip(("name", "mime", "content"), i, strict=True)) for i in images]}]

    return each_file(docs, DOCX, parse, {"images": []}, opener)


def html_to_markdown(page: Column, escape: bool = False) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        made = [html.to_markdown(t.as_py(), escape) for t in texts]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["markdown", "title"])

    return F.arrow_udf(run, MARKDOWN)(page)
