"""From layout tables to Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_margin, overlap_ratio
from ..functions.headings import heading_markdown
from ..functions.text import squeeze
from ..operators import layout as L
from ..scratch import merged

MARK = "<!-- page %d -->"
FAILED = "<!-- academic mode failed: "
SKIPPED = "<!-- layout detection skipped on page "


def fast(blocks: DataFrame, width: Column, height: Column, squeezed: bool = False) -> DataFrame:
    """``(doc_id, markdown)``: text blocks in reading order; pages without text are left out. Blocks that are ``squeezed`` have texts of that form, none blank."""
    kept = L.without_margins(blocks if squeezed else blocks.withColumn("text", squeeze(F.col("text"))).where("text <> ''"), height)
    pages = L.page_text(kept, width).where(F.trim("text") != "")
    return joined(pages.withColumn("text", F.concat(F.format_string(MARK, "page_no"), F.lit("\n\n"), F.trim("text"))))


def joined(pages: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n\n").alias("markdown"))


def page_lists(blocks: DataFrame, sizes: Column, width: Column, height: Column, squeezed: bool = False) -> DataFrame:
    """A row for each page: its items as an array, its width, and the median size of its body text.

    Everything up to the document then runs on pages that lie together: this is the one exchange of the blocks.
    """
    text = F.col("text") if squeezed else squeeze(F.col("text"))
    counts = (F.length("text") >= 12) & ~is_margin(F.lit(""), F.col("y0"), F.col("y1"), height)
    stays = (text != "") & ~is_margin(text, F.col("y0"), F.col("y1"), height)
    style = ("first_span", "font_size", "is_bold", "is_italic")
    item = F.struct("item_no", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width")], text.alias("text"), *style, stays.alias("stays"), F.when(counts, sizes).alias("sizes"))
    rows = blocks.select(*L.PAGE, width.cast("double").alias("page_width"), item.alias("item")).groupBy(*L.PAGE).agg(F.first("page_width").alias("page_width"), F.collect_list("item").alias("items"))
    known = F.array_sort(F.filter(F.flatten(F.transform(F.filter("items", lambda i: i["sizes"].isNotNull()), lambda i: i["sizes"])), lambda x: x.isNotNull()))
    n = F.size("known")
    middle = (F.element_at("known", F.floor((n + 1) / 2).cast("int")) + F.element_at("known", F.floor(n / 2).cast("int") + 1)) / 2
    return rows.withColumn("known", known).withColumn("body_size", F.when(n > 0, middle).otherwise(L.BODY_SIZE)).drop("known")


def academic(blocks: DataFrame, sizes: Column, regions: DataFrame | None, width: Column, height: Column, assets: Column, results: DataFrame | None = None, every: DataFrame | None = None, squeezed: bool = False) -> DataFrame:
    """``(doc_id, markdown)``: headings, regions in place of the text they cover, a mark for every page.

    ``blocks`` has ``font_size, is_bold, is_italic, first_span``; ``sizes`` are the sizes of a block's spans. ``regions``
    are those of :func:`region_lists`; ``results`` has ``(doc_id, page_no, latex map<int, string>, drawn array<int>)``: formulas
    that were read, and pictures that were drawn; others have no link then. ``every`` has all pages
    ``(doc_id, page_no, page_width, note)``, those without a block too; without it a page is known by its blocks.
    """
    pages = page_lists(blocks, sizes, width, height, squeezed)
    if every is not None:
        pages = every.join(merged(pages.drop("page_width")), L.PAGE, "left").withColumn("body_size", F.coalesce("body_size", F.lit(L.BODY_SIZE)))
    else:
        pages = pages.withColumn("note", F.lit(None).cast("string"))
    plain = F.col("items")
    if regions is not None:
        region_fields = regions.schema["regions"].dataType.elementType.names
        pages = pages.join(merged(regions), L.PAGE, "left")
        if results is not None:
            pages = pages.join(merged(results), L.PAGE, "left")

        def as_item(r: Column) -> Column:
            latex = F.try_element_at(F.col("latex"), r["region_no"]) if results is not None else F.lit(None).cast("string")
            text = L.region_markdown(r["label"], F.col("page_no"), r["region_no"], assets, latex)
            if results is not None:
                text = F.when((r["label"] == "isolate_formula") | F.array_contains("drawn", r["region_no"]), text)
            if "table_text" in region_fields:  # of a table without a picture
                text = F.coalesce(text, r["table_text"])
            box = [r[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
            none = F.lit(None)
            return F.struct(
                (F.lit(1_000_000) + r["region_no"]).alias("item_no"), *box, (r["x1"] - r["x0"]).cast("double").alias("width"), text.alias("text"),
                none.cast("string").alias("first_span"), none.cast("double").alias("font_size"), none.cast("boolean").alias("is_bold"), none.cast("boolean").alias("is_italic"), r["label"].alias("label"),
            )

        shown = F.filter(F.transform(F.coalesce("regions", F.array()), as_item), lambda r: r["text"].isNotNull())
        pages = pages.withColumn("shown", shown)

        def covered(i: Column) -> Column:
            mine = [i[c] for c in ("x0", "y0", "x1", "y1")]
            return F.exists("shown", lambda r: overlap_ratio(mine, [r[c] for c in ("x0", "y0", "x1", "y1")]) > F.when(r["label"] == "isolate_formula", 0.08).otherwise(0.35))

        plain = F.filter("items", lambda i: ~covered(i))
    fields = ("item_no", "x0", "y0", "x1", "y1", "width", "text", "first_span", "font_size", "is_bold", "is_italic")

    def bare(items: Column, is_region: bool) -> Column:
        return F.transform(items, lambda i: F.struct(*[i[c].cast("int").alias(c) if c == "item_no" else i[c].alias(c) for c in fields], F.lit(is_region).alias("is_region")))

    kept = bare(F.filter(plain, lambda i: i["stays"]), False)
    every_item = F.coalesce(kept, F.slice(kept, 1, 0)) if regions is None else F.concat(F.coalesce(kept, F.filter(bare(F.col("shown"), True), lambda _: F.lit(False))), bare(F.col("shown"), True))
    items = pages.select(*L.PAGE, "page_width", "note", "body_size", F.explode_outer(every_item).alias("i")).select(*L.PAGE, "page_width", "note", "body_size", "i.*")
    headed = heading_markdown(*[F.col(c) for c in ("text", "first_span", "font_size", "is_bold", "is_italic", "x0", "x1", "width", "body_size")], F.col("page_width"), squeezed=True)
    done = items.withColumn("text", F.when(F.col("is_region"), F.col("text")).otherwise(headed))
    note = F.concat(F.lit(SKIPPED), F.col("page_no").cast("string"), F.lit(": "), F.col("note"), F.lit(" -->"))
    pages = L.page_text(done, F.col("page_width"), F.first("note").alias("note"))
    marked = pages.withColumn("text", F.concat_ws("\n\n", F.format_string(MARK, "page_no"), note, F.nullif(F.trim("text"), F.lit(""))))
    return joined(marked)


def with_fallback(academic_docs: DataFrame, fast_docs: DataFrame) -> DataFrame:
    """Per document: the fast text where the academic one failed (``error``) or is blank."""
    both = academic_docs.join(merged(fast_docs.withColumnRenamed("markdown", "fast")), "doc_id", "left")
    failed = F.col("error").isNotNull()
    note = F.concat(F.lit(FAILED), F.col("error"), F.lit(" -->\n\n"), F.coalesce("fast", F.lit("")))
    return both.select("doc_id", F.when(failed, note).when(F.trim(F.coalesce("markdown", F.lit(""))) == "", F.col("fast")).otherwise(F.col("markdown")).alias("markdown"), "error")
