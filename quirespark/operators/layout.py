"""Page layout: margins, body size, regions, reading order. Windows are per page, never per corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, is_margin, overlap_ratio
from ..functions.text import squeeze, visible
from ..scratch import merged

PAGE = ["doc_id", "page_no"]
RICH = ("figure", "table", "isolate_formula")
BODY_SIZE = 10.5
GAP, WIDE, APART = 24, 0.68, 36


def block_stats(blocks: DataFrame) -> DataFrame:
    """Text and font statistics of blocks with ``lines`` of spans; others than text blocks and blank ones go."""
    spans = F.flatten(F.transform("lines", lambda line: line["spans"]))
    sizes = F.array_sort(F.transform(F.filter(spans, lambda s: s["size"].isNotNull()), lambda s: s["size"]))
    n = F.size(sizes)
    middle = (F.element_at(sizes, F.floor((n + 1) / 2).cast("int")) + F.element_at(sizes, F.floor(n / 2).cast("int") + 1)) / 2
    text = squeeze(F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")), " "))
    fonts = F.array_join(F.transform(spans, lambda s: s["font"]), " ")
    any_flag = lambda bit: F.exists(spans, lambda s: s["flags"].bitwiseAND(bit) != 0)
    kept = blocks.where(F.col("type") == 0) if "type" in blocks.columns else blocks
    return (
        kept.where(F.exists(spans, lambda s: visible(s["text"])))  # before the text is put together: a filter on it would do so again
        .withColumn("text", text)
        .withColumn("font_size", F.when(n > 0, middle).otherwise(0.0))
        .withColumn("max_font_size", F.coalesce(F.array_max(sizes), F.lit(0.0)))
        .withColumn("is_bold", fonts.rlike("(?iu)bold|hei|simhei|黑体") | any_flag(16))
        .withColumn("is_italic", fonts.rlike("(?iu)italic|ital|oblique") | any_flag(2))
        .withColumn("first_span", F.when(F.size(spans) >= 2, F.get(spans, 0)["text"]))
    )


def without_margins(blocks: DataFrame, height: Column) -> DataFrame:
    return blocks.where(~is_margin(F.col("text"), F.col("y0"), F.col("y1"), height))


def body_sizes(samples: DataFrame, height: Column) -> DataFrame:
    """Median span size of each page, of blocks with 12 or more characters outside the margins; ``samples`` has a row for each span."""
    counts = (F.length("text") >= 12) & ~is_margin(F.lit(""), F.col("y0"), F.col("y1"), height)
    return samples.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(counts, F.col("size"))), F.lit(BODY_SIZE)).alias("body_size"))


def outside_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks that no region covers: over 0.08 of a block for formulas, over 0.35 for the others."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "label", "x0", "y0", "x1", "y1")])
    covered = overlap_ratio(box(), box("r_")) > F.when(F.col("r_label") == "isolate_formula", 0.08).otherwise(0.35)
    return blocks.join(merged(r), (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_no") == F.col("r_page_no")) & covered, "left_anti")


def admitted_tables(tables: DataFrame, regions: DataFrame) -> DataFrame:
    """Found tables that no rich region covers by more than 0.6; they come with confidence 1."""
    r = regions.where(F.col("label").isin(*RICH)).select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_no") == F.col("r_page_no"))
    return tables.join(merged(r), same & (overlap_ratio(box(), box("r_")) > 0.6), "left_anti").withColumn("confidence", F.lit(1.0))


def region_lists(regions: DataFrame) -> DataFrame:
    """``(doc_id, page_no, regions)``: the regions of a page that stay, in order of (y0, x0) and numbered from 1 as ``region_no``.

    Regions come by falling confidence; one that overlaps a kept one of its label by more than 0.8 goes. The fold
    runs over the regions of one page.
    """
    fields = [c for c in regions.columns if c not in PAGE]
    entry = F.struct((-F.col("confidence")).alias("rank"), F.col("seq").alias("tie"), F.struct(*fields).alias("r"))
    listed = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry)).alias("all"))

    def overlaps(a: Column, b: Column) -> Column:
        x, y = [a[c] for c in ("x0", "y0", "x1", "y1")], [b[c] for c in ("x0", "y0", "x1", "y1")]
        return (a["label"] == b["label"]) & ((overlap_ratio(x, y) > 0.8) | (overlap_ratio(y, x) > 0.8))

    every = F.transform("all", lambda e: e["r"])
    kept = F.aggregate(every, F.slice(every, 1, 0), lambda acc, r: F.when(F.exists(acc, lambda k: overlaps(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
    ordered = F.array_sort(F.transform(kept, lambda r: F.struct(r["y0"].alias("y"), r["x0"].alias("x"), (-r["confidence"]).alias("c"), r["seq"].alias("s"), r.alias("r"))))
    return listed.select(*PAGE, F.transform(ordered, lambda o, i: F.struct(*[o["r"][c].alias(c) for c in fields], (i + 1).alias("region_no"))).alias("regions"))


def deduplicated_regions(regions: DataFrame) -> DataFrame:
    """The regions of :func:`region_lists`, a row for each."""
    return region_lists(regions).select(*PAGE, F.explode("regions").alias("r")).select(*PAGE, "r.*")


def asset_name(page_no: Column, number: Column, label: Column) -> Column:
    return F.format_string("page-%04d-%02d-%s.png", page_no, number, label)


def region_markdown(label: Column, page_no: Column, number: Column, assets: Column, formula: Column | None = None) -> Column:
    """A region as Markdown; null where there is no folder for assets."""
    latex = formula if formula is not None else F.lit(None).cast("string")
    image = F.concat(F.lit("!["), label, F.lit(" page "), page_no.cast("string"), F.lit("]("), assets, F.lit("/"), asset_name(page_no, number, label), F.lit(")"))
    return F.when(label == "isolate_formula", F.coalesce(F.concat(F.lit("$$\n"), latex, F.lit("\n$$")), F.lit("<!-- formula OCR unavailable -->"))).otherwise(image)


def split_point(starts: Column, centre: Column) -> Column:
    """Where two columns part, from the ascending distinct left edges of a segment."""
    left = F.array_max(F.filter(starts, lambda x: x < centre))
    right = F.array_min(F.filter(starts, lambda x: x > centre))
    nexts = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
    gaps = F.filter(F.zip_with(starts, nexts, lambda a, b: F.struct((a - b).alias("minus"), a.alias("at"), ((a + b) / 2).alias("middle"))), lambda g: g["minus"].isNotNull())
    widest = F.array_min(gaps)  # the first of the widest: the least negative width, then the least edge
    return F.when(F.size(starts) < 2, centre).when(left.isNotNull() & right.isNotNull(), (left + right) / 2).when(-widest["minus"] >= APART, widest["middle"]).otherwise(centre)


def reading_keys(items: DataFrame, page_width: Column) -> DataFrame:
    """Adds ``band, bar, segment, split_x, col``: the order of a one- or two-column page.

    All windows part by the page, or by more than the page, so that one exchange serves them.
    """
    page = Window.partitionBy(*PAGE)
    before = page.orderBy("y0", "x0", "item_no").rowsBetween(Window.unboundedPreceding, -1)
    centre = page_width / 2
    bar = ((F.col("x0") < centre) & (F.col("x1") > centre) & (F.col("width") >= page_width * WIDE)).cast("int")
    banded = items.withColumn("bar", bar).withColumn("narrow", F.count_if(F.col("width") < page_width * WIDE).over(page)).withColumn("band", F.coalesce(F.sum("bar").over(before), F.lit(0)))
    inside = Window.partitionBy(*PAGE, "band", "bar").orderBy("y0", "x0", "item_no")
    reach = F.max("y1").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    broken = banded.withColumn("breaks", F.coalesce((F.col("y0") - reach > GAP).cast("int"), F.lit(0)))
    cut = broken.withColumn("segment", F.sum("breaks").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    starts = F.array_sort(F.collect_set(F.round("x0", 1)).over(Window.partitionBy(*PAGE, "band", "bar", "segment")))
    split = cut.withColumn("split_x", split_point(starts, centre))
    two = F.col("narrow") >= 4
    col = F.when(two & (F.col("bar") == 0) & (F.col("x0") >= F.col("split_x")), 1).otherwise(0)
    return (
        split.withColumn("col", col)
        .withColumn("band", F.when(two, F.col("band")).otherwise(0))
        .withColumn("segment", F.when(two, F.col("segment")).otherwise(0))
        .withColumn("bar", F.when(two, F.col("bar")).otherwise(0))
        .drop("breaks", "narrow")
    )


ORDER = ("band", "bar", "segment", "col", "y0", "x0", "item_no")


def reading_order(items: DataFrame, page_width: Column) -> DataFrame:
    """Adds ``position``, from 1 on each page."""
    return reading_keys(items, page_width).withColumn("position", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*ORDER)))


def page_text(items: DataFrame, page_width: Column, *more: Column) -> DataFrame:
    """``(doc_id, page_no, text, *more)``: a page's items in reading order, blank lines between; ``more`` are aggregates of a page."""
    entries = F.array_sort(F.collect_list(F.struct(*ORDER, "text")))
    return reading_keys(items, page_width).groupBy(*PAGE).agg(F.array_join(F.transform(entries, lambda e: e["text"]), "\n\n").alias("text"), *more)
