"""Whole documents to Markdown: PDF, Word, HTML and text.

A listing of files is routed by names; the task that parses a file opens it. Each file is parsed once. What a parser finds is stored in the shared folder, so that documents, assets and
progress, which all read it, don't parse again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import render_box
from ..functions.text import cleaned_latex, merged_table_slots, pipe_table, refilled, sanitised, unescaped_math
from ..operators import layout as L
from ..providers import Providers, ready, scaled
from ..registry import CONVERTERS, Converter, register, routed
from ..schemas import ASSETS
from ..scratch import merged, stored
from ..shipping import ship
from ..sources import files, pdf, pictures
from . import pages

# Points around a region that are rendered with it, and pixels for a point, for pictures and for formulas that are read.
RENDERED = {"figure": (2.0, 2.0), "table": (3.0, 3.0), "isolate_formula": (4.0, 4.0)}


@dataclass
class Conversion:
    """``documents``: ``(doc_id, markdown, title, error)``; ``assets``: ``(doc_id, rel_path, mime, content)``; ``events``: ``(doc_id, seq, stage, current, total)``."""

    documents: DataFrame
    assets: DataFrame | None = None
    events: DataFrame | None = None


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# --- PDF -------------------------------------------------------------------


def known_blocks(parsed: DataFrame) -> DataFrame:
    return L.block_stats(files.page_blocks(parsed))


def region_table(parsed: DataFrame, table_text: bool = False) -> DataFrame:
    """Detected regions, and found tables that none of them covers; with ``table_text``, their text as a Markdown table."""
    detected = files.page_regions(parsed, "regions").where(F.col("label").isin(*L.RICH))
    tables = files.page_regions(parsed, "tables")
    if not table_text:
        return detected.unionByName(L.admitted_tables(tables.drop("rows"), detected))
    named = tables.withColumn("table_text", F.nullif(pipe_table(F.col("rows")), F.lit(""))).drop("rows")
    return detected.withColumn("table_text", none()).unionByName(L.admitted_tables(named, detected))


def rendered(docs: DataFrame, regions: DataFrame, sizes: DataFrame, providers: Providers, opener: Callable[[str], bytes] = files.read_path) -> DataFrame:
    """``(doc_id, page_no, region_no, label, png, latex)``: what the render and formula providers make of the regions.

    Only documents with regions are read again: their paths meet the regions, and the task that renders opens the file. Documents
    that come as content are joined as they are. A provider that fails leaves its region without a result.
    """
    full = [F.lit(0.0), F.lit(0.0), F.col("page_width"), F.col("page_height")]

    def boxed(r: Column) -> Column:
        box = [r[c].cast("double") for c in ("x0", "y0", "x1", "y1")]
        padded = F.coalesce(*[F.when(r["label"] == label, render_box(box, full, padding)) for label, (padding, _) in RENDERED.items()])
        return F.struct(r["region_no"].cast("int").alias("region_no"), r["label"].alias("label"), padded.alias("box"))

    each = regions.join(merged(sizes.select(*L.PAGE, "page_width", "page_height")), L.PAGE).select(*L.PAGE, F.transform("regions", boxed).alias("regions"))
    listed = each.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "regions")).alias("pages"))
    key, listing = docs.schema["doc_id"].dataType, files.is_listing(docs)
    render, formula, cache = providers.render, providers.formula, providers.cache

    def made(provider, *arguments):
        if provider is None:
            return None
        try:
            return provider(*arguments[:-1], **scaled(provider, arguments[-1]))
        except Exception:  # one region without a result
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, read = ready(render, cache), ready(formula, cache)
        for batch in batches:
            for doc, given, own in zip(*batch.columns, strict=True):
                rows = []
                try:
                    data = opener(given.as_py()) if listing else given.as_py() or b""
                except OSError:  # gone since it was parsed
                    continue
                for page in own.as_py():
                    for r in page["regions"]:
                        if r["box"] is not None:
                            box = tuple(r["box"][c] for c in ("x0", "y0", "x1", "y1"))
                            is_formula = r["label"] == "isolate_formula"
                            scale = RENDERED[r["label"]][1]
                            rows.append((doc.as_py(), page["page_no"], r["region_no"], r["label"], None if is_formula else made(draw, data, page["page_no"], box, scale), made(read, data, page["page_no"], box, scale) if is_formula else None))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [doc.type, pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "page_no", "region_no", "label", "png", "latex"])

    if listing:
        both = files.balanced(docs.select("doc_id", "path", "length").join(merged(listed), "doc_id")).select("doc_id", "path", "pages")
    else:
        both = docs.select("doc_id", F.col("content").cast("binary").alias("content")).join(merged(listed), "doc_id")
    found = both.mapInArrow(run, f"doc_id {key.simpleString()}, page_no int, region_no int, label string, png binary, latex string")
    return found.withColumn("latex", cleaned_latex(F.col("latex")))


def pdf_conversion(docs: DataFrame, mode: str = "academic", provider: Callable = pdf.read, regions: DataFrame | None = None, assets: str | None = None, providers: Providers | None = None, opener: Callable[[str], bytes] = files.read_path, table_text: bool = False) -> Conversion:
    """PDF files. Regions come from a table, from a layout provider, and from ruling lines (tables).

    Without a renderer a region gets the pixels of the image below it, if there is one. With ``table_text``, a ruled table without
    a picture becomes a Markdown table; else its text stays as it is.
    """
    if mode not in ("academic", "fast"):
        raise ValueError(f"unknown mode: {mode}")
    ship(docs.sparkSession)
    chosen = providers or Providers()
    drawing = chosen.render is not None  # else there are pictures of images only: none of ruled tables alone
    if not drawing:
        chosen = replace(chosen, render=pictures.render)
    if assets is not None:
        docs = docs.withColumn("assets", F.lit(assets))
    parsed = stored(files.parsed_pdf(docs, provider, chosen if mode == "academic" else None, opener))
    width, height = F.col("page_width"), F.col("page_height")
    failed, whole = parsed.where("page_no is null"), parsed.where("page_no is not null")
    events = whole.select("doc_id", F.lit("pages").alias("stage"), F.col("page_no").alias("current"), F.col("pages").alias("total"))
    errors = failed.select("doc_id", F.when(F.lit(mode == "academic"), F.concat(F.lit(pages.FAILED), F.col("error"), F.lit(" -->\n\n"))).alias("markdown"), "error")
    if mode == "fast":
        done = whole.select("doc_id").distinct().join(merged(pages.fast(known_blocks(whole), width, height, squeezed=True)), "doc_id", "left")
        return Conversion(done.withColumn("error", none()).unionByName(errors.withColumn("markdown", none())), None, events)
    lists = made = results = None
    linked = "assets" in docs.columns  # a picture needs a folder
    sought = chosen.layout is not None or chosen.tables is not None or drawing or table_text
    if regions is not None or sought and whole.where("size(regions) > 0 OR size(tables) > 0").take(1):
        found = region_table(whole, table_text)
        if regions is not None:
            own = regions if "table_text" in regions.columns else regions.withColumn("table_text", none())
            found = found.unionByName(own.where(F.col("label").isin(*L.RICH)).select(*found.columns))
        lists = L.region_lists(found)
        if linked or chosen.formula is not None:
            lists = stored(lists)
            made = stored(rendered(docs, lists, whole, chosen, opener))
            read = F.collect_list(F.when(F.col("latex").isNotNull(), F.struct("region_no", "latex")))
            results = made.groupBy(*L.PAGE).agg(F.map_from_entries(read).alias("latex"), F.collect_list(F.when(F.col("png").isNotNull(), F.col("region_no"))).alias("drawn"))
    links = F.col("assets")  # without a picture there is no link, and the text stays
    every = whole.select(*L.PAGE, "page_width", "note", "assets")
    spans = F.flatten(F.transform("lines", lambda line: line["spans"]))
    full = pages.academic(known_blocks(whole), F.transform(spans, lambda s: s["size"]), lists, width, height, links, results, every, squeezed=True)
    drawn = None
    if made is not None:
        folder = whole.select(*L.PAGE, "assets")
        name = L.asset_name(F.col("page_no"), F.col("region_no"), F.col("label"))
        drawn = made.where("png is not null").join(merged(folder), L.PAGE).where("assets is not null").select("doc_id", name.alias("rel_path"), F.when(F.hex(F.substring("png", 1, 2)) == "FFD8", "image/jpeg").otherwise("image/png").alias("mime"), F.col("png").alias("content"))
    return Conversion(full.withColumn("error", none()).unionByName(errors), drawn, events)


def pdf_markdown(docs: DataFrame, mode: str = "academic", provider: Callable = pdf.read, regions: DataFrame | None = None, assets: str | None = None, providers: Providers | None = None, **options) -> DataFrame:
    """``(doc_id, markdown, error)`` of PDF files."""
    return pdf_conversion(docs, mode, provider, regions, assets, providers, **options).documents


# --- HTML and Word ---------------------------------------------------------


def html_markdown(html: DataFrame, escape: bool = False) -> DataFrame:
    """``(doc_id, markdown, title)`` and ``error`` if there is one: tables with merged cells stay HTML, formulas lose their escapes.

    With ``escape``, as files are converted, asterisks and underscores of a text stay what they are.
    """
    shown, pairs = merged_table_slots(F.col("html"))
    slots = html.withColumn("slots", pairs).withColumn("shown", shown)
    done = slots.withColumn("m", files.html_to_markdown(F.col("shown"), escape))
    title = F.coalesce(*([F.col("title")] if "title" in html.columns else []), F.col("m.title"))
    text = unescaped_math(refilled(F.col("m.markdown"), F.col("slots")))
    if "error" in html.columns:
        return done.select("doc_id", F.when(F.col("error").isNull(), text).alias("markdown"), title.alias("title"), "error")
    return done.select("doc_id", text.alias("markdown"), title.alias("title"))


def docx_conversion(docs: DataFrame, style_map: str | None = None, opener: Callable[[str], bytes] = files.read_path) -> Conversion:
    """Word packages. Style names of ``style_map`` come after the headings that a package itself defines."""
    ship(docs.sparkSession)
    parsed = stored(files.parsed_docx(docs, style_map, opener))
    pictures = parsed.select("doc_id", F.explode("images").alias("i")).select("doc_id", F.col("i.name").alias("rel_path"), "i.mime", "i.content")
    steps = parsed.where("error is null").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("current")).select("doc_id", F.lit("docx").alias("stage"), "current", F.lit(4).alias("total"))
    shown = F.filter("images", lambda i: i["name"].rlike(r"^image-\d+\.(gif|jpg|png|svg)\z"))
    images = parsed.select("doc_id", F.size(shown).alias("total")).where("total > 0").select("doc_id", F.lit("images").alias("stage"), F.explode(F.sequence(F.lit(1), F.col("total"))).alias("current"), "total")
    return Conversion(html_markdown(parsed.drop("images"), escape=True), pictures, steps.unionByName(images))


def docx_markdown(docs: DataFrame, style_map: str | None = None) -> DataFrame:
    """``(doc_id, markdown, title, error)`` of Word packages."""
    ship(docs.sparkSession)
    return html_markdown(files.parsed_docx(docs, style_map).drop("images"))


def docx_assets(docs: DataFrame) -> DataFrame:
    """``(doc_id, rel_path, mime, content)`` of the images of Word packages."""
    return docx_conversion(docs).assets


# --- any file --------------------------------------------------------------


def _opener(options: dict) -> Callable[[str], bytes]:
    return options.get("opener") or files.read_path


def _pdf(docs: DataFrame, options: dict) -> Conversion:
    known = {k: options[k] for k in ("mode", "provider", "regions", "assets", "providers", "table_text") if options.get(k) is not None}
    return pdf_conversion(docs, **known, opener=_opener(options))


def _docx(docs: DataFrame, options: dict) -> Conversion:
    return docx_conversion(docs, options.get("style_map"), _opener(options))


def _html(docs: DataFrame, options: dict) -> Conversion:
    return Conversion(html_markdown(stored(files.parsed_text(docs, _opener(options))).select("doc_id", F.col("text").alias("html"), "error"), escape=True))


def _text(docs: DataFrame, options: dict) -> Conversion:
    return Conversion(stored(files.parsed_text(docs, _opener(options))).select("doc_id", F.col("text").alias("markdown"), "error"))


def _built_in() -> None:
    from ..functions.files import accepts_docx, accepts_pdf

    ending = lambda known: lambda ext, _: F.lower(F.coalesce(ext, F.lit(""))).isin(*known)
    kinds = (("pdf", accepts_pdf, _pdf, -1.0, (".pdf",)), ("docx", accepts_docx, _docx, -1.0, (".docx",)), ("html", None, _html, 0.0, (".html", ".htm")), ("text", None, _text, 0.0, (".md", ".txt")))
    for name, accepts, run, priority, endings in kinds:
        if name not in CONVERTERS:
            register(Converter(name, accepts or ending(endings), run, priority, True, endings))


_built_in()


def conversion(docs: DataFrame, **options) -> Conversion:
    """Files of any kind that a registered converter takes; all options go to each of them.

    ``docs`` is a listing of files, or has their ``content``. It may have ``assets``, the folder that a document's links to its assets begin
    with. Options of its own: ``opener`` (path to bytes, for a listing), and ``scan`` (endings to files with content, where
    workers can't open them).
    """
    ship(docs.sparkSession)
    names = {"doc_id": docs.schema["doc_id"].dataType}
    scan, listing = options.pop("scan", None), files.is_listing(docs)
    dealt = stored(routed(docs)) if listing and scan is None else routed(docs)  # a store is listed once
    columns = ("doc_id", "markdown", "title", "error")
    documents, assets, events = [], [], []
    for converter in CONVERTERS.values():
        own = dealt if scan is None else routed(scan(converter.endings))
        own = own.where(F.col("converter") == converter.name)
        made = converter.run(own if converter.opens else files.with_content(own, _opener(options)), options)
        whole = made.documents
        for c in ("title", "error"):
            whole = whole if c in whole.columns else whole.withColumn(c, none())
        documents.append(whole.select(*columns))
        assets += [made.assets] if made.assets is not None else []
        events += [made.events] if made.events is not None else []
        last = whole.select("doc_id", F.lit("markdown").alias("stage"), F.lit(1).alias("current"), F.lit(1).alias("total"))
        events.append(last)

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    whole = union(documents).withColumn("markdown", sanitised(F.col("markdown")))
    key = names["doc_id"].simpleString()
    none_yet = docs.sparkSession.createDataFrame([], ", ".join([f"doc_id {key}", *[f"{f.name} {f.dataType.simpleString()}" for f in ASSETS.fields[1:]]]))
    rank = F.when(F.col("stage") == "markdown", 3).when(F.col("stage") == "images", 2).otherwise(1)
    return Conversion(whole, union([none_yet, *assets]), union(events).withColumn("seq", rank * F.lit(1 << 32) + F.col("current")))


def convert(docs: DataFrame, mode: str = "academic", provider: Callable = pdf.read, **options) -> DataFrame:
    """``(doc_id, markdown, title, error)`` of files of any kind that a converter takes."""
    return conversion(docs, mode=mode, provider=provider, **options).documents


def path_conversion(spark: SparkSession, path: str, prepared: Callable[[DataFrame], DataFrame] = lambda docs: docs, **options) -> Conversion:
    """The files of a path or glob. ``prepared`` may add columns to a listing (``assets``).

    Where workers can't open the store by themselves, Spark reads each converter's files, by their endings.
    """
    listing = prepared(files.list_files(spark, path))
    if options.get("opener") or files.reachable(path):
        return conversion(listing, **options)
    return conversion(listing, scan=lambda endings: prepared(files.read_files(spark, path, endings=endings)), **options)


def convert_path(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(doc_id, markdown, title, error)`` of the files of a path or glob."""
    return path_conversion(spark, path, **options).documents
