"""Registered queries on the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import files, geometry, headings, text
from .functions import markdown as md
from .operators import layout as L
from .operators import progress as P
from .operators import styles
from .operators.blocks import joined_blocks, markdown_blocks
from .plans import convert, packages, pages, translate, views
from .providers import Providers
from .scratch import merged
from .shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def W() -> Column:
    return F.lit(float(views.WIDTH))


def H() -> Column:
    return F.lit(float(views.HEIGHT))



def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- SQL parts -------------------------------------------------------------

B, R = views.BLOCKS, views.REGIONS
MARGIN = """(y1 < 842*0.09 OR (y1 < 842*0.18 AND (text = 'Renewable Energy' OR starts_with(text, 'Contents lists') OR starts_with(text, 'journal homepage:') OR contains(text, ' / Renewable Energy ')))
  OR y0 > 842*0.94 OR (y0 > 842*0.90 AND (starts_with(text, 'Please cite this article') OR contains(text, 'doi.org/') OR contains(text, 'All rights reserved'))) OR (y0 > 842*0.86 AND starts_with(text, '* Corresponding author.')))"""
SQUEEZED = "trim(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"
SQUEEZED_BLOCKS = f"sq AS (SELECT * REPLACE ({SQUEEZED} AS text) FROM blocks WHERE {SQUEEZED} <> '')"


def order_sql(items: str, page: str = "doc_id, page_no") -> str:
    """CTEs ``o1`` to ``keys``: reading keys of the relation ``items``."""
    s = "doc_id, page_no, band, bar, segment"
    return f"""o1 AS (SELECT *, CASE WHEN x0 < 300 AND x1 > 300 AND width >= 600*0.68 THEN 1 ELSE 0 END AS bar, count(*) FILTER (WHERE width < 600*0.68) OVER (PARTITION BY {page}) AS narrow FROM {items}),
o2 AS (SELECT *, coalesce(sum(bar) OVER (PARTITION BY {page} ORDER BY y0, x0, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM o1),
o3 AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY {page}, band, bar ORDER BY y0, x0, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 24 THEN 1 ELSE 0 END AS brk FROM o2),
o4 AS (SELECT *, sum(brk) OVER (PARTITION BY {page}, band, bar ORDER BY y0, x0, item_no ROWS UNBOUNDED PRECEDING) AS segment FROM o3),
ds AS (SELECT DISTINCT {s}, round(x0, 1) AS s FROM o4),
st AS (SELECT {s}, count(*) AS n, max(s) FILTER (WHERE s < 300) AS l, min(s) FILTER (WHERE s > 300) AS r FROM ds GROUP BY ALL),
gp AS (SELECT *, lead(s) OVER (PARTITION BY {s} ORDER BY s) AS nx FROM ds),
gw AS (SELECT {s}, nx - s AS gap, (nx + s) / 2 AS mid FROM gp WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {s} ORDER BY nx - s DESC, s) = 1),
sp AS (SELECT st.*, CASE WHEN n < 2 THEN 300.0 WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 WHEN gap >= 36 THEN mid ELSE 300.0 END AS split_x FROM st LEFT JOIN gw USING ({s})),
keys AS (SELECT o4.* EXCLUDE (bar, band, segment), split_x, CASE WHEN narrow >= 4 THEN o4.bar ELSE 0 END AS bar, CASE WHEN narrow >= 4 THEN o4.band ELSE 0 END AS band, CASE WHEN narrow >= 4 THEN o4.segment ELSE 0 END AS segment,
  CASE WHEN narrow >= 4 AND o4.bar = 0 AND x0 >= split_x THEN 1 ELSE 0 END AS col FROM o4 JOIN sp USING ({s}))"""


KEPT = f"kept AS (SELECT * FROM blocks WHERE NOT {MARGIN})"
KEYS = f"WITH {B}, {KEPT}, {order_sql('kept')}"
IN_ORDER = "ORDER BY band, bar, segment, col, y0, x0, item_no"


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_margins(views.blocks(spark, sf_dir), H())


# --- margins and reading order ---------------------------------------------


@query(f"WITH {B} SELECT doc_id, line_no, {MARGIN} AS is_margin FROM blocks")
def margin_filter(spark, sf_dir):
    return views.blocks(spark, sf_dir).select("doc_id", "line_no", geometry.is_margin(F.col("text"), F.col("y0"), F.col("y1"), H()).alias("is_margin"))


@query(f"{KEYS} SELECT doc_id, line_no, CAST(segment AS BIGINT) AS segment FROM keys")
def vertical_segments(spark, sf_dir):
    return L.reading_keys(kept(spark, sf_dir), W()).select("doc_id", "line_no", F.col("segment").cast("long").alias("segment"))


@query(f"{KEYS} SELECT doc_id, line_no, CAST(band AS BIGINT) AS band, CAST(bar AS BIGINT) AS bar FROM keys")
def column_bands(spark, sf_dir):
    return L.reading_keys(kept(spark, sf_dir), W()).select("doc_id", "line_no", F.col("band").cast("long").alias("band"), F.col("bar").cast("long").alias("bar"))


@query(f"{KEYS} SELECT doc_id, line_no, split_x, CAST(col AS BIGINT) AS col FROM keys")
def column_split_x(spark, sf_dir):
    return L.reading_keys(kept(spark, sf_dir), W()).select("doc_id", "line_no", "split_x", F.col("col").cast("long").alias("col"))


@query(f"{KEYS} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, page_no {IN_ORDER}) AS position FROM keys")
def reading_order(spark, sf_dir):
    return L.reading_order(kept(spark, sf_dir), W()).select("doc_id", "line_no", F.col("position").cast("long").alias("position"))


@query(
    f"""WITH {B}, {SQUEEZED_BLOCKS}, kept AS (SELECT * FROM sq WHERE NOT {MARGIN}), {order_sql("kept")},
pg AS (SELECT doc_id, page_no, trim(string_agg(text, chr(10) || chr(10) {IN_ORDER})) AS text FROM keys GROUP BY ALL)
SELECT doc_id, string_agg('<!-- page ' || page_no || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM pg WHERE text <> '' GROUP BY doc_id"""
)
def page_markdown_fast(spark, sf_dir):
    return pages.fast(views.blocks(spark, sf_dir), W(), H())


# --- body size and block statistics ----------------------------------------

BODY = "body AS (SELECT doc_id, page_no, coalesce(median(size) FILTER (WHERE length(text) >= 12 AND NOT (y1 < 842*0.09 OR y0 > 842*0.94)), 10.5) AS body_size FROM blocks GROUP BY ALL)"


@query(f"WITH {B}, {BODY} SELECT * FROM body")
def body_font_size(spark, sf_dir):
    return L.body_sizes(views.blocks(spark, sf_dir), H()).select("doc_id", F.col("page_no").cast("int").alias("page_no"), "body_size")


def spanned(spark, sf_dir):
    """Blocks of one line whose spans are words, with fonts, sizes and flags by number."""
    words = F.split("text", " ")

    def span(w, i):
        font = F.when((F.col("doc_id") + i) % 11 == 0, "Times-Bold").when((F.col("doc_id") + i) % 13 == 0, "Arial-ItalicMT").otherwise("Times")
        flags = F.when((F.col("line_no") + i) % 17 == 0, 16).when((F.col("line_no") + i) % 19 == 0, 2).otherwise(0)
        return F.struct(F.concat(w, F.lit(" ")).alias("text"), font.alias("font"), (9 + (F.col("doc_id") * 3 + F.col("line_no") * 7 + i) % 5).cast("double").alias("size"), flags.alias("flags"))

    return views.lines(spark, sf_dir).select("doc_id", "line_no", F.lit(0).alias("type"), F.array(F.struct(F.transform(words, span).alias("spans"))).alias("lines"))


@query(
    f"""WITH {views.LINES}, sp AS (SELECT doc_id, line_no, i - 1 AS i, w[i] AS word FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM lines), unnest(range(1, len(w) + 1)) AS t(i)),
f AS (SELECT *, CASE WHEN (doc_id + i) % 11 = 0 THEN 'Times-Bold' WHEN (doc_id + i) % 13 = 0 THEN 'Arial-ItalicMT' ELSE 'Times' END AS font, CAST(9 + (doc_id*3 + line_no*7 + i) % 5 AS DOUBLE) AS size, CASE WHEN (line_no + i) % 17 = 0 THEN 16 WHEN (line_no + i) % 19 = 0 THEN 2 ELSE 0 END AS flags FROM sp),
g AS (SELECT doc_id, line_no, trim(regexp_replace(string_agg(word || ' ', '' ORDER BY i), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS text, median(size) AS font_size, max(size) AS max_font_size,
  bool_or(font = 'Times-Bold' OR flags = 16) AS is_bold, bool_or(font = 'Arial-ItalicMT' OR flags = 2) AS is_italic FROM f GROUP BY ALL)
SELECT * FROM g WHERE text <> ''"""
)
def block_text_stats(spark, sf_dir):
    return L.block_stats(spanned(spark, sf_dir)).select("doc_id", "line_no", "text", "font_size", "max_font_size", "is_bold", "is_italic")


# --- regions ---------------------------------------------------------------


def ratio_sql(a: str, b: str) -> str:
    w, h = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN CAST({w} * {h} AS DOUBLE) / greatest(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), 1) ELSE 0 END)"


EXCLUDED = f"EXISTS (SELECT 1 FROM {{regions}} r WHERE r.doc_id = b.doc_id AND r.page_no = b.page_no AND {ratio_sql('b', 'r')} > CASE WHEN r.label = 'isolate_formula' THEN 0.08 ELSE 0.35 END)"
DEDUPED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY confidence DESC, seq) AS rk FROM regions),
fold AS (SELECT doc_id, page_no, 1 AS rk, [{{'label': label, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'seq': seq, 'confidence': confidence}}] AS kept FROM ranked WHERE rk = 1
  UNION ALL SELECT f.doc_id, f.page_no, f.rk + 1, CASE WHEN len(list_filter(f.kept, lambda k: k.label = r.label AND ({ratio_sql("k", "r")} > 0.8 OR {ratio_sql("r", "k")} > 0.8))) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'label': r.label, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'seq': r.seq, 'confidence': r.confidence}}) END FROM fold f JOIN ranked r ON r.doc_id = f.doc_id AND r.page_no = f.page_no AND r.rk = f.rk + 1),
lastf AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY rk DESC) = 1),
rich AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, confidence DESC, seq) AS region_no FROM (SELECT doc_id, page_no, unnest(kept, recursive := true) FROM lastf))"""
REGION_MD = "CASE WHEN label = 'isolate_formula' THEN '<!-- formula OCR unavailable -->' ELSE '![' || label || ' page ' || page_no || '](' || doc_id || '_assets/' || printf('page-%04d-%02d-', page_no, region_no) || label || '.png)' END"
RB = f"WITH RECURSIVE {B}, {R}, {DEDUPED}"


@query(f"WITH {B}, {R} SELECT doc_id, line_no FROM blocks b WHERE NOT {EXCLUDED.format(regions='regions')}")
def overlap_exclusion(spark, sf_dir):
    return L.outside_regions(views.blocks(spark, sf_dir), views.regions(spark, sf_dir)).select("doc_id", "line_no")


@query(f"{RB} SELECT doc_id, page_no, seq, region_no FROM rich")
def region_dedupe(spark, sf_dir):
    return L.deduplicated_regions(views.regions(spark, sf_dir)).select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("seq").cast("long").alias("seq"), F.col("region_no").cast("long").alias("region_no"))


TABLES = "found AS (SELECT doc_id, page_no, k, 45 AS x0, 100 + 65*((doc_id*2 + k) % 9) AS y0, 300 AS x1, 160 + 65*((doc_id*2 + k) % 9) + 20*k AS y1 FROM (SELECT DISTINCT doc_id, page_no FROM blocks) p, unnest(range(0, 3)) AS t(k))"


@query(f"WITH {B}, {R}, {TABLES} SELECT doc_id, page_no, k, 1.0::DOUBLE AS confidence FROM found b WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = b.doc_id AND r.page_no = b.page_no AND {ratio_sql('b', 'r')} > 0.6)")
def table_admission(spark, sf_dir):
    found = views.blocks(spark, sf_dir).select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    found = found.select("*", F.lit(45).alias("x0"), F.expr("100 + 65 * ((doc_id * 2 + k) % 9)").alias("y0"), F.lit(300).alias("x1"), F.expr("160 + 65 * ((doc_id * 2 + k) % 9) + 20 * k").alias("y1"))
    return L.admitted_tables(found, views.regions(spark, sf_dir)).select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("k").cast("long").alias("k"), F.col("confidence").cast("double").alias("confidence"))


@query(f"{RB} SELECT doc_id, page_no, region_no, {REGION_MD} AS markdown, printf('page-%04d-%02d-', page_no, region_no) || label || '.png' AS asset FROM rich")
def region_markdown(spark, sf_dir):
    rich = L.deduplicated_regions(views.regions(spark, sf_dir).where(F.col("label").isin(*L.RICH)))
    assets = F.concat(F.col("doc_id").cast("string"), F.lit("_assets"))
    c = [F.col("label"), F.col("page_no"), F.col("region_no")]
    return rich.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("region_no").cast("long").alias("region_no"), L.region_markdown(*c, assets).alias("markdown"), L.asset_name(c[1], c[2], c[0]).alias("asset"))


@query(
    f"""WITH {B}, {R}, c AS (SELECT doc_id, page_no, seq, least(greatest(x0 - 300, 0), 600) AS x0, least(greatest(y0 - 300, 0), 842) AS y0, least(greatest(x1 - 300, 0), 600) AS x1, least(greatest(y1 - 300, 0), 842) AS y1 FROM regions),
p AS (SELECT *, greatest(x0 - 3.0, 0) AS px0, greatest(y0 - 3.0, 0) AS py0, least(x1 + 3.0, 600) AS px1, least(y1 + 3.0, 842) AS py1 FROM c)
SELECT doc_id, page_no, seq, x0, y0, x1, y1, CASE WHEN px1 - px0 >= 2 AND py1 - py0 >= 2 THEN (px1 - px0) * (py1 - py0) END::DOUBLE AS padded_area FROM p"""
)
def region_boxes(spark, sf_dir):
    r = views.regions(spark, sf_dir)
    most = {"x0": 600, "y0": 842, "x1": 600, "y1": 842}
    cut = r.select("doc_id", "page_no", "seq", *[geometry.clamped((F.col(c) - 300).cast("double"), F.lit(m)).alias(c) for c, m in most.items()])
    page = [F.lit(0.0), F.lit(0.0), W(), H()]
    padded = cut.withColumn("b", geometry.render_box([F.col(c).cast("double") for c in most], page, 3.0))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    return padded.select("doc_id", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("int").alias(c) for c in ("page_no", *most)], area.alias("padded_area"))


# --- headings --------------------------------------------------------------

# Lines of every kind, besides those of the documents: text, size, flags, x0, width.
GOLDEN = [
    ("Results", 10.0, 0, 30.0, 120.0), ("results", 10.0, 0, 30.0, 120.0), ("1 Introduction The wind", 10.0, 0, 40.0, 240.0),
    ("2.1 Methods we use", 10.0, 0, 40.0, 240.0), ("3.2.1 Setup", 10.0, 16, 40.0, 240.0), ("Figure 3 shows", 10.0, 16, 40.0, 240.0),
    ("a b s t r a c t", 10.0, 0, 40.0, 240.0), ("4 Discussion: With care", 12.0, 0, 40.0, 240.0), ("5 Wind speed", 12.0, 0, 40.0, 240.0),
    ("2.3.4.5.6.7 Deep", 12.0, 2, 40.0, 240.0), ("12 Contents .... 7", 12.0, 16, 40.0, 240.0), ("Copyright holders", 12.0, 16, 40.0, 240.0),
    ("A long title for a bold line", 13.0, 16, 40.0, 500.0), ("see https://example.org", 13.0, 16, 40.0, 240.0), ("123 Main", 13.0, 16, 40.0, 240.0),
    ("第三章 结果", 10.0, 0, 40.0, 240.0), ("附件1：说明", 12.0, 0, 40.0, 240.0), ("3 管理员 列表", 12.0, 0, 40.0, 240.0), ("B2 panel", 12.0, 16, 40.0, 240.0),
    ("Wide line with a number 12", 10.0, 0, 40.0, 520.0), ("Conclusions.", 10.0, 2, 40.0, 520.0),
]
GOLDEN_SQL = "VALUES " + ", ".join(f"('{t}', CAST({s} AS DOUBLE), {f}, CAST({x} AS DOUBLE), CAST({w} AS DOUBLE), {i})" for i, (t, s, f, x, w) in enumerate(GOLDEN))
HEAD_IN = f"""hin AS (SELECT b.doc_id, b.line_no, {SQUEEZED} AS text, size AS font_size, flags, x0, width, body_size FROM blocks b JOIN body USING (doc_id, page_no)
  UNION ALL SELECT -1, i, t, s, f, x, w, CAST(10 AS DOUBLE) FROM ({GOLDEN_SQL}) AS g(t, s, f, x, w, i))"""
REJECT_SQL = r"""((width >= 600*0.68 AND regexp_matches(text, '\s\d{1,3}$')) OR regexp_matches(text, '\.{4}') OR regexp_matches(text, '^[a-z]{3,20}$') OR regexp_matches(text, '(?i)^(Figure|Fig\.|Table)\s+\d+')
  OR regexp_matches(text, '(?i)^PAPER\s+•\s+OPEN\s+ACCESS$') OR regexp_matches(text, '^(Citation|Received|Revised|Accepted|Published|Copyright)\b') OR regexp_matches(text, '^\d{3,}\s+')
  OR regexp_matches(' ' || text || ' ', '[^\p{L}\p{N}_][NSWE][^\p{L}\p{N}_]') OR regexp_matches(text, '°[NSEW]|XXXXX') OR regexp_matches(text, '^\d{1,2}\s+.*[。；;]$') OR regexp_matches(text, 'https?://|\\\\|/|OA\+|\.cn\b')
  OR regexp_matches(text, '^[A-Z]\d?\s+') OR length(text) > 90 OR (regexp_matches(text, '^\d+[.、]\s*[\x{4e00}-\x{9fff}].*[。；;]?$') AND length(text) > 36))"""
TITLES_SQL = "[" + ", ".join(f"'{t}'" for t in sorted(headings.TITLES, key=lambda t: (-len(t), t))) + "]"
LEVEL_SQL = rf"""lv AS (SELECT *, flags <> 0 AS styled, font_size >= body_size + 1 OR (flags <> 0 AND font_size >= body_size - 0.2) AS prom,
  (x0 <= 600*0.22 OR (x0 >= 600*0.42 AND x0 <= 600*0.64)) AND length(text) <= 48 AND width <= 600*0.42 AND font_size >= body_size - 0.2 AS short,
  regexp_extract(text, '^(\d{{1,2}}(?:\.\d{{1,2}})+)\.?\s+\S+', 1) AS num, {REJECT_SQL} AS rejected,
  list_contains({TITLES_SQL}, rtrim(lower(trim(regexp_replace(text, '^\d+(?:\.\d+)*\.?\s+', ''))), '.:')) AS academic FROM hin),
lev AS (SELECT *, CASE WHEN rejected THEN NULL WHEN font_size < body_size - 0.2 AND NOT prom THEN NULL
  WHEN regexp_matches(text, '^第[一二三四五六七八九十百\d]+[章节篇部分]\S*') THEN CASE WHEN prom OR length(text) <= 32 THEN 2 END
  WHEN regexp_matches(text, '^附件\d+[：:]\s*\S+') THEN CASE WHEN prom AND length(text) <= 40 THEN 2 END
  WHEN regexp_matches(text, '^\d{{1,2}}\s+[\x{{4e00}}-\x{{9fff}}A-Za-z]') THEN CASE WHEN NOT regexp_matches(text, '(?i)(地址|账号|权限|密码|管理员|平台|联系|邮箱|OA|http|www|\\\\|\.cn\b)') AND (prom OR short) THEN 2 END
  WHEN num <> '' AND (prom OR short) THEN least(2 + length(num) - length(replace(num, '.', '')), 6)
  WHEN regexp_matches(text, '^\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z].*') THEN CASE WHEN prom OR short THEN 2 END
  WHEN academic THEN CASE WHEN prom OR short OR styled THEN 2 END
  WHEN flags = 16 AND font_size >= body_size + 2 AND length(text) <= 40 THEN 2 END AS level FROM lv)"""
HEADS = f"WITH {B}, {BODY}, {HEAD_IN}, {LEVEL_SQL}"
PREFIX_SQL = rf"""pre AS (SELECT *, rtrim(regexp_extract(text, '^(\d{{1,2}}(?:\.\d{{1,2}})*\.?)\s+(.+)$', 1), '.') AS pnum, trim(regexp_extract(text, '^(\d{{1,2}}(?:\.\d{{1,2}})*\.?)\s+(.+)$', 2)) AS rem FROM lev),
pt AS (SELECT *, list_filter({TITLES_SQL}, lambda t: starts_with(lower(rem), t) AND NOT regexp_matches(substr(rem, length(t) + 1), '^\p{{L}}')
  AND regexp_matches(trim(substr(rem, length(t) + 1)), '^(?:{"|".join(headings.STARTERS)})\b|^[a-z]'))[1] AS title FROM pre),
hm AS (SELECT *, CASE WHEN text = 'a b s t r a c t' THEN '## Abstract' WHEN text = 'a r t i c l e i n f o' THEN '## Article info'
  WHEN pnum <> '' AND title IS NOT NULL THEN repeat('#', CAST(least(2 + length(pnum) - length(replace(pnum, '.', '')), 6) AS INT)) || ' ' || pnum || '. ' || trim(substr(rem, 1, length(title))) || chr(10) || chr(10) || trim(substr(rem, length(title) + 1))
  WHEN level IS NOT NULL THEN repeat('#', CAST(level AS INT)) || ' ' || text ELSE text END AS markdown FROM pt)"""


def heading_input(spark, sf_dir):
    b = views.blocks(spark, sf_dir)
    known = b.join(L.body_sizes(b, H()), L.PAGE).select("doc_id", "line_no", text.squeeze(F.col("text")).alias("text"), F.col("size").alias("font_size"), "flags", "x0", "width", "body_size")
    rows = [(-1, i, t, s, f, x, w, 10.0) for i, (t, s, f, x, w) in enumerate(GOLDEN)]
    golden = spark.createDataFrame(rows, known.schema)
    return known.unionByName(golden).withColumn("x1", F.col("x0") + F.col("width")).withColumn("is_bold", F.col("flags") == 16).withColumn("is_italic", F.col("flags") == 2).withColumn("first_span", F.lit(None).cast("string"))


@query(f"{HEADS} SELECT doc_id, line_no, rejected, academic FROM lev")
def heading_rejects(spark, sf_dir):
    t = F.col("text")
    return heading_input(spark, sf_dir).select("doc_id", "line_no", headings.rejected(t, F.col("width"), W()).alias("rejected"), headings.academic_title(t).alias("academic"))


@query(f"{HEADS} SELECT doc_id, line_no, CAST(level AS BIGINT) AS level FROM lev")
def heading_levels(spark, sf_dir):
    c = [F.col(x) for x in ("text", "font_size", "is_bold", "is_italic", "x0", "width", "body_size")]
    return heading_input(spark, sf_dir).select("doc_id", "line_no", headings.heading_level(*c, W()).cast("long").alias("level"))


@query(f"{HEADS}, {PREFIX_SQL} SELECT doc_id, line_no, markdown FROM hm")
def heading_markdown(spark, sf_dir):
    c = [F.col(x) for x in ("text", "first_span", "font_size", "is_bold", "is_italic", "x0", "x1", "width", "body_size")]
    return heading_input(spark, sf_dir).select("doc_id", "line_no", headings.heading_markdown(*c, W()).alias("markdown"))


@query(f"{HEADS}, {PREFIX_SQL} SELECT doc_id, line_no, pnum || '. ' || trim(substr(rem, 1, length(title))) AS heading, trim(substr(rem, length(title) + 1)) AS rest FROM pt WHERE pnum <> '' AND title IS NOT NULL")
def numbered_prefix_split(spark, sf_dir):
    found = heading_input(spark, sf_dir).select("doc_id", "line_no", headings.numbered_prefix(F.col("text")).alias("p")).where("p is not null")
    return found.select("doc_id", "line_no", "p.heading", "p.rest")


ACADEMIC = f"""WITH RECURSIVE {B}, {BODY}, {R}, {DEDUPED}, {SQUEEZED_BLOCKS},
txt AS (SELECT * FROM sq b WHERE NOT {MARGIN} AND NOT {EXCLUDED.format(regions="rich")}),
hin AS (SELECT t.*, size AS font_size, coalesce(body_size, 10.5) AS body_size FROM txt t LEFT JOIN body USING (doc_id, page_no)), {LEVEL_SQL}, {PREFIX_SQL},
items AS (SELECT doc_id, page_no, item_no, x0, y0, x1, y1, width, markdown AS text FROM hm UNION ALL SELECT doc_id, page_no, 1000000 + region_no, x0, y0, x1, y1, x1 - x0, {REGION_MD} FROM rich), {order_sql("items")},
pg AS (SELECT doc_id, page_no, trim(string_agg(text, chr(10) || chr(10) {IN_ORDER})) AS text FROM keys GROUP BY ALL),
pm AS (SELECT doc_id, page_no, '<!-- page ' || page_no || ' -->' || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || chr(10) || text ELSE '' END AS text FROM (SELECT DISTINCT doc_id, page_no FROM blocks) LEFT JOIN pg USING (doc_id, page_no))
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM pm GROUP BY doc_id"""


@query(ACADEMIC)
def document_markdown_academic(spark, sf_dir):
    b = views.blocks(spark, sf_dir).withColumn("font_size", F.col("size")).withColumn("is_bold", F.col("flags") == 16).withColumn("is_italic", F.col("flags") == 2).withColumn("first_span", F.lit(None).cast("string"))
    regions = L.region_lists(views.regions(spark, sf_dir).where(F.col("label").isin(*L.RICH)))
    return pages.academic(b, F.array("size"), regions, W(), H(), F.concat(F.col("doc_id").cast("string"), F.lit("_assets")))


# --- Markdown blocks, protection, chunks, translation ----------------------

NL = "chr(10)"
# the derived Markdown has no fences or formulas, but every one of its other line kinds
MD_LINES = rf"""{views.MARKDOWN}, ml AS (SELECT doc_id, i - 1 AS line_no, parts[i] || CASE WHEN i < len(parts) THEN {NL} ELSE '' END AS line FROM (SELECT doc_id, string_split(markdown, {NL}) AS parts FROM md), unnest(range(1, len(parts) + 1)) AS t(i) WHERE i < len(parts) OR parts[i] <> ''),
m1 AS (SELECT *, CASE WHEN starts_with(ltrim(line), repeat('`', 3)) THEN 1 ELSE 0 END AS fence, trim(line, ' ' || {NL}) AS s FROM ml),
m2 AS (SELECT *, CASE WHEN fence = 0 AND starts_with(s, '$$') THEN 1 ELSE 0 END AS math FROM m1),
m3 AS (SELECT *, CASE WHEN math = 1 AND ((length(line) - length(replace(line, '$$', ''))) // 2) % 2 = 1 THEN 1 ELSE 0 END AS odd FROM m2),
m4 AS (SELECT *, coalesce(sum(fence) OVER w, 0) % 2 AS in_fence, coalesce(sum(odd) OVER w, 0) % 2 AS in_math FROM m3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m5 AS (SELECT *, CASE WHEN fence = 0 AND math = 0 AND in_fence = 0 AND s <> '' AND in_math = 0 AND NOT (starts_with(s, '<') OR starts_with(s, '![') OR starts_with(s, '|') OR regexp_matches(s, '^[-*_]{{3,}}$')) THEN 1 ELSE 0 END AS plain FROM m4),
m6 AS (SELECT *, CASE WHEN plain = 1 AND coalesce(lag(plain) OVER (PARTITION BY doc_id ORDER BY line_no), 0) = 1 THEN 0 ELSE 1 END AS opens FROM m5),
m7 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS block_no FROM m6),
mb AS (SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, string_agg(line, '' ORDER BY line_no) AS text, max(plain) = 1 AND regexp_matches(string_agg(line, '' ORDER BY line_no), '[A-Za-z]') AS translatable FROM m7 GROUP BY ALL)"""


@query(f"WITH {MD_LINES} SELECT * FROM mb")
def markdown_blocks_of_conversations(spark, sf_dir):
    return markdown_blocks(views.markdown(spark, sf_dir)).withColumn("block_no", F.col("block_no").cast("long"))


@query(f"WITH {MD_LINES} SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE translatable) AS translatable FROM mb GROUP BY doc_id")
def translatable_counts(spark, sf_dir):
    return markdown_blocks(views.markdown(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("translatable").alias("translatable"))


@query(f"WITH {MD_LINES.replace(views.MARKDOWN, views.FENCED)} SELECT * FROM mb")
def markdown_blocks_with_fences(spark, sf_dir):
    return markdown_blocks(views.fenced(spark, sf_dir)).withColumn("block_no", F.col("block_no").cast("long"))


@query(f"WITH {MD_LINES} SELECT doc_id, string_agg(text, '' ORDER BY block_no) AS markdown FROM mb GROUP BY doc_id")
def markdown_round_trip(spark, sf_dir):
    return joined_blocks(markdown_blocks(views.markdown(spark, sf_dir)))


PREFIX_RE = r"'(?s)^(\s*(?:#{1,6}\s+|>\s+|[-*+]\s+|\d+[.)]\s+)?)(.*)$'"
MARKS = ["", "# ", "  - ", "12) ", "> ", "#", "* ", "3. "]
MARKS_SQL = "(" + "[" + ", ".join(f"'{m}'" for m in MARKS) + "]" + ")[CAST((doc_id + line_no) % 8 AS INT) + 1]"


@query(f"WITH {views.LINES}, d AS (SELECT doc_id, line_no, {MARKS_SQL} || text AS text FROM lines) SELECT doc_id, line_no, regexp_extract(text, {PREFIX_RE}, 1) AS prefix, regexp_extract(text, {PREFIX_RE}, 2) AS body FROM d")
def prefix_split(spark, sf_dir):
    mark = F.element_at(F.lit(MARKS), ((F.col("doc_id") + F.col("line_no")) % 8 + 1).cast("int"))
    d = views.lines(spark, sf_dir).select("doc_id", "line_no", md.prefix_split(F.concat(mark, F.col("text"))).alias("p"))
    return d.select("doc_id", "line_no", "p.prefix", "p.body")


@query(
    """SELECT p_partkey, 'see {v1} and ' || '{v0}' || ' with {v2} and {v3}, {v4}' AS protected, 5 AS n_spans, t AS restored
FROM (SELECT p_partkey, 'see [' || p_name || '](u' || p_partkey || ') and ' || '![' || p_brand || '](i.png)' || ' with `' || p_type || '` and $$a\\lambda' || p_size || '$$, <br>' AS t FROM part)"""
)
def protect_spans(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    t = F.concat(F.lit("see ["), F.col("p_name"), F.lit("](u"), F.col("p_partkey").cast("string"), F.lit(") and !["), F.col("p_brand"), F.lit("](i.png) with `"), F.col("p_type"), F.lit("` and $$a\\lambda"), F.col("p_size").cast("string"), F.lit("$$, <br>"))
    p = part.select("p_partkey", md.protect(t).alias("p"))
    return p.select("p_partkey", F.col("p.text").alias("protected"), F.size("p.spans").alias("n_spans"), md.restore(F.col("p.text"), F.col("p.spans")).alias("restored"))


def chunk_sql(limit: int) -> str:
    slices = f"list_transform(range(0, greatest(CAST(ceil(length(p) / {limit}.0) AS INT) - 1, 0)), lambda i: substr(p, i * {limit} + 1, {limit}))"
    fits = f"length(CASE WHEN cur = '' THEN p ELSE cur || ' ' || p END) <= {limit}"
    return f"""WITH RECURSIVE fl AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS f FROM documents),
sp AS (SELECT doc_id, f, string_split(regexp_replace(f, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM fl WHERE length(f) > {limit}),
st AS (SELECT doc_id, parts, 0 AS i, CAST([] AS VARCHAR[]) AS ch, '' AS cur FROM sp
  UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN {fits} THEN ch ELSE list_concat(list_concat(ch, CASE WHEN cur <> '' THEN [cur] ELSE [] END), CASE WHEN length(p) > {limit} THEN {slices} ELSE [] END) END,
    CASE WHEN {fits} THEN CASE WHEN cur = '' THEN p ELSE cur || ' ' || p END WHEN length(p) > {limit} THEN substr(p, (CAST(ceil(length(p) / {limit}.0) AS INT) - 1) * {limit} + 1, {limit}) ELSE p END
    FROM (SELECT *, parts[i + 1] AS p FROM st WHERE i < len(parts))),
done AS (SELECT doc_id, list_concat(ch, CASE WHEN cur <> '' THEN [cur] ELSE [] END) AS ch FROM st WHERE i = len(parts) UNION ALL SELECT doc_id, [f] FROM fl WHERE length(f) <= {limit})
SELECT doc_id, k AS chunk_no, ch[k + 1] AS text FROM done, unnest(range(0, len(ch))) AS t(k)"""


@query(chunk_sql(900))
def chunk_text(spark, sf_dir):
    chunks = views.table(spark, sf_dir, "documents").select("doc_id", md.chunks(F.coalesce("text", F.lit("")), md.LIMITS["bing"]).alias("c"))
    return chunks.select("doc_id", F.posexplode("c").alias("chunk_no", "text")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(
    f"""WITH {MD_LINES}, tr AS (SELECT *, regexp_extract(rtrim(text, {NL}), {PREFIX_RE}, 1) AS prefix, regexp_extract(rtrim(text, {NL}), {PREFIX_RE}, 2) AS body FROM mb)
SELECT doc_id, string_agg(CASE WHEN translatable AND trim(body) <> '' THEN prefix || trim(regexp_replace(body, '\\s+', ' ', 'g')) || {NL} ELSE text END, '' ORDER BY block_no) AS markdown FROM tr GROUP BY doc_id"""
)
def translate_identity(spark, sf_dir):
    return translate.translate(views.markdown(spark, sf_dir))


# --- names -----------------------------------------------------------------

STEM_SQL = rf"""n1 AS (SELECT key, regexp_replace(regexp_replace(regexp_replace(trim(stem), '\s+', '_', 'g'), '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), '(?i)[_-]?(?:[0-9a-f]{{12,}}|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$', '') AS s FROM stems),
n2 AS (SELECT key, trim(regexp_replace(s, '_+', '_', 'g'), '._- ') AS s FROM n1), n3 AS (SELECT key, CASE WHEN s = '' THEN 'output' ELSE s END AS s FROM n2),
tk AS (SELECT key, s, list_filter(regexp_split_to_array(s, '[_\-—–（）()\[\]【】,，、]+'), lambda t: t <> '') AS parts FROM n3 WHERE NOT (length(s) <= 72 AND octet_length(encode(s)) <= 120)),
pk AS (SELECT key, s, parts, 0 AS i, '' AS o, false AS full_ FROM tk
  UNION ALL SELECT key, s, parts, i + 1, CASE WHEN full_ OR NOT (length(c) <= 63 AND octet_length(encode(c)) <= 111) THEN o ELSE c END, full_ OR NOT (length(c) <= 63 AND octet_length(encode(c)) <= 111)
  FROM (SELECT *, CASE WHEN o = '' THEN parts[i + 1] ELSE o || '_' || parts[i + 1] END AS c FROM pk WHERE i < len(parts))),
short AS (SELECT key, s AS stem FROM n3 WHERE length(s) <= 72 AND octet_length(encode(s)) <= 120
  UNION ALL SELECT key, CASE WHEN o <> '' THEN o ELSE rtrim(left(s, 63), '._- ') END || '-' || left(sha1(s), 8) FROM pk WHERE i = len(parts))"""


@query(f"WITH RECURSIVE {views.STEMS}, {STEM_SQL} SELECT * FROM short")
def output_stem(spark, sf_dir):
    return views.stems(spark, sf_dir).select("key", text.short_stem(F.col("stem")).alias("stem"))


@query(
    """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS stem, p_partkey % 4 AS k FROM part), d AS (SELECT *, CASE k WHEN 0 THEN 'output/' || stem WHEN 1 THEN 'out/' || stem WHEN 2 THEN 'out/' || stem ELSE 'x' END AS output_dir, CASE k WHEN 3 THEN 'R_' || p_partkey ELSE stem END AS own FROM s)
SELECT p_partkey, CASE k WHEN 3 THEN 'x/R ' || p_partkey || '.md' ELSE output_dir || '/' || own || '.md' END AS output, output_dir, own AS stem, output_dir || '/' || own || '_assets' AS assets_dir FROM d"""
)
def output_layout(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    k, name = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit("_"))
    target = F.when(k == 1, "out").when(k == 2, F.concat(F.lit("out/"), name)).when(k == 3, F.concat(F.lit("x/R "), F.col("p_partkey").cast("string"), F.lit(".md")))
    o = part.select("p_partkey", text.output_layout(F.concat(F.lit("in/"), F.col("p_name"), F.lit(".pdf")), target).alias("o"))
    return o.select("p_partkey", "o.output", "o.output_dir", "o.stem", "o.assets_dir")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 3) THEN 'pdf' WHEN p_partkey % 5 IN (1, 4) THEN 'docx' END AS converter,
CASE p_partkey % 4 WHEN 0 THEN printf('image-%04d', p_size) || '.png' WHEN 1 THEN printf('image-%04d', p_size) || '.tiff' WHEN 2 THEN printf('image-%04d', p_size) || '.bin' ELSE printf('image-%04d', p_size) || '.jpg' END AS saved,
CASE p_partkey % 4 WHEN 3 THEN printf('image-%04d', p_size) || '.jpg' ELSE printf('image-%04d', p_size) || '.png' END AS shown, 'a/' || p_partkey || '.png' AS rel FROM part"""
)
def file_dispatch(spark, sf_dir):
    k, m = F.col("p_partkey") % 5, F.col("p_partkey") % 4
    ext = F.when(k == 0, ".PDF").when(k == 1, ".docx").when(k == 2, ".xyz")
    mime = F.when(k == 3, "application/X-PDF; v=1").when(k == 4, files.DOCX_MIME[0])
    image = files.image_asset(F.col("p_size"), F.when(m == 0, "image/png").when(m == 1, "image/tiff").when(m == 2, "image/unknown").otherwise("image/jpeg"))
    rel = text.relative_path(F.concat(F.lit("out/x/a/"), F.col("p_partkey").cast("string"), F.lit(".png")), F.lit("out/x"))
    d = views.table(spark, sf_dir, "part").select("p_partkey", files.converter(ext, mime).alias("converter"), image.alias("image"), rel.alias("rel"))
    return d.select("p_partkey", "converter", "image.saved", "image.shown", "rel")


# --- tables, mathematics, styles -------------------------------------------


@query(
    f"""SELECT p_partkey, '| ' || p_name || ' | a\\|b |  |' || {NL} || '| --- | --- | --- |' || {NL} || '| ' || p_brand || ' | ' || p_type || ' | ' || p_size || ' |' || {NL} || '| 1 |  |  |' AS markdown FROM part"""
)
def rows_to_pipe_table(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = F.array(F.array(F.col("p_name"), F.lit(" a|b ")), F.array(none, F.lit("")), F.array(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")), F.array(F.lit("1")))
    return views.table(spark, sf_dir, "part").select("p_partkey", text.pipe_table(rows).alias("markdown"))


@query(
    f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || {NL} || 'y' WHEN 2 THEN NULL ELSE '$' || p_name END AS cleaned, 'a\\le ' || p_size || '\\times \\mu b' AS symbols FROM part"""
)
def latex_cleanup(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    fence = "`" * 3
    raw = F.when(k == 0, F.concat(F.lit(fence + "latex\n$$ "), n, F.lit(" $$\n" + fence))).when(k == 1, F.concat(F.lit(" $"), n, F.lit("\n$$\ny$ "))).when(k == 2, F.lit("$ $")).otherwise(F.concat(F.lit("$"), n))
    return views.table(spark, sf_dir, "part").select("p_partkey", text.cleaned_latex(raw).alias("cleaned"), text.fixed_symbols(F.concat(F.lit(" a≤"), F.col("p_size").cast("string"), F.lit("×\\m b "))).alias("symbols"))


@query(
    """SELECT p_partkey, '<h1>' || p_name || '</h1><table><tr><td>1</td></tr></table>' || CASE WHEN p_size % 2 = 0 THEN '<p>MERGEDTABLESLOT0002</p>' ELSE '<table><tr><td colspan="1">' || p_type || '</td></tr></table>' END || '<p>end</p>' AS html,
CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS slots, '<h1>' || p_name || '</h1><table><tr><td>1</td></tr></table>' || CASE WHEN p_size % 2 = 0 THEN '<p><table><tr><td colspan="2">' || p_type || '</td></tr></table></p>' ELSE '<table><tr><td colspan="1">' || p_type || '</td></tr></table>' END || '<p>end</p>' AS refilled FROM part"""
)
def merged_tables(spark, sf_dir):
    second = F.concat(F.lit('<table><tr><td colspan="'), F.when(F.col("p_size") % 2 == 0, "2").otherwise("1"), F.lit('">'), F.col("p_type"), F.lit("</td></tr></table>"))
    html = F.concat(F.lit("<h1>"), F.col("p_name"), F.lit("</h1><table><tr><td>1</td></tr></table>"), second, F.lit("<p>end</p>"))
    shown, pairs = text.merged_table_slots(html)
    return views.table(spark, sf_dir, "part").select("p_partkey", shown.alias("html"), F.size(pairs).alias("slots"), text.refilled(shown, pairs).alias("refilled"))


@query("""SELECT p_partkey, 'a\\_b $x_' || p_size || '$ c\\*d $$[' || p_name || ']$$ $open\\_' AS markdown FROM part""")
def math_unescape(spark, sf_dir):
    raw = F.concat(F.lit("a\\_b $x\\_"), F.col("p_size").cast("string"), F.lit("$ c\\*d $$\\["), F.col("p_name"), F.lit("\\]$$ $open\\_"))
    return views.table(spark, sf_dir, "part").select("p_partkey", text.unescaped_math(raw).alias("markdown"))


@query(
    f"""WITH l AS (SELECT p_brand AS doc_id, p_type AS style_id, min(p_size % 11) AS level, min(p_partkey) AS ord FROM part GROUP BY ALL),
s AS (SELECT doc_id, level, ord, 'p[style-name=''' || CASE WHEN length(style_id) % 2 = 0 THEN style_id || '\\''s' ELSE style_id END || '''] => h' || least(level + 1, 6) || ':fresh' AS line FROM l WHERE level BETWEEN 0 AND 8 AND length(style_id) % 7 <> 0)
SELECT doc_id, string_agg(line, {NL} ORDER BY level, ord) || {NL} || 'b => strong' AS style_map FROM s GROUP BY doc_id"""
)
def heading_style_map(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    n = F.length("p_type")
    names = part.select(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("style_id"), F.when(n % 7 == 0, F.concat(F.lit("TOC "), F.col("p_type"))).when(n % 2 == 0, F.concat(F.col("p_type"), F.lit("'s"))).otherwise(F.col("p_type")).alias("name")).distinct()
    levels = part.select(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("style_id"), (F.col("p_size") % 11).cast("string").alias("level"), F.col("p_partkey").alias("ord"))
    return styles.style_map(names, levels, "b => strong")


def html_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in ("script", "style", "head", "nav", "footer"):
        out = f"regexp_replace({out}, '(?is)<{name}\\b.*?</{name}\\s*>', '', 'g')"
    for level in range(1, 7):
        out = f"regexp_replace({out}, '(?is)<h{level}\\b[^>]*>(.*?)</h{level}\\s*>', {NL} || {NL} || '{'#' * level} \\1' || {NL} || {NL}, 'g')"
    out = f"""regexp_replace({out}, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', '[\\2](\\1)', 'g')"""
    out = f"regexp_replace({out}, '(?is)<b\\b[^>]*>(.*?)</b\\s*>', '**\\1**', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>', {NL}, 'g')"
    out = f"regexp_replace({out}, '(?i)<li\\b[^>]*>', {NL} || '* ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:p|div|article|ul|section)\\b[^>]*>', {NL} || {NL}, 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', '', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    out = f"regexp_replace({out}, '[ \\t]*\\n[ \\t]*', {NL}, 'g')"
    return f"trim(regexp_replace({out}, '\\n{{3,}}', {NL} || {NL}, 'g'), ' ' || {NL})"


@query(f"SELECT page_id, {html_sql()} AS markdown FROM pages")
def html_markdown(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", md.html_subset(F.col("html")).alias("markdown"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '<< /Resources << /ExtGState << /GS1 7 0 R /GS2 8 0 R >> >> >>' WHEN p_size % 3 = 1 THEN '<< /Resources << /ExtGState << /GS1 7 0 R /GS2 8 0 R >>  /Font 1 >> >>' ELSE '<< /ExtGState 3 /Resources << /Font 1 >> >>' END AS obj FROM part"""
)
def pdf_resource_repair(spark, sf_dir):
    k = F.col("p_size") % 3
    obj = F.when(k == 0, "<< /Resources <<  >> >>").when(k == 1, "<< /Resources << /Font 1 >> >>").otherwise("<< /ExtGState 3 /Resources << /Font 1 >> >>")
    states = files.used_resources(F.lit("<< /GS1 7 0 R /GS2 8 0 R /GS3 9 0 R >>"), F.concat(F.lit("q /GS2 gs /GS1 gs /GS2 gs /GS9 gs "), F.col("p_name")))
    return views.table(spark, sf_dir, "part").select("p_partkey", files.with_resources(obj, states).alias("obj"))


# --- progress --------------------------------------------------------------

STAGE_SQL = "CASE stage WHEN 'pages' THEN 0.05::DOUBLE + 0.75::DOUBLE * (current / 10.0::DOUBLE) WHEN 'docx' THEN 0.05::DOUBLE + 0.35::DOUBLE * (current / 10.0::DOUBLE) WHEN 'images' THEN 0.4::DOUBLE + 0.35::DOUBLE * (current / 10.0::DOUBLE) WHEN 'translation' THEN 0.05::DOUBLE + 0.85::DOUBLE * (current / 10.0::DOUBLE) ELSE 0.88::DOUBLE END"


@query(f"WITH {views.PROGRESS} SELECT run_id, seq, max({STAGE_SQL}) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS progress FROM progress")
def progress_high_water(spark, sf_dir):
    return P.high_water(views.progress(spark, sf_dir)).select("run_id", "seq", "progress")


@query(f"WITH {views.PROGRESS} SELECT run_id, seq, '@progress ' || '{{\"stage\":\"' || stage || '\",\"current\":' || current || ',\"total\":' || total || '}}' AS line FROM progress".replace("{{", "{").replace("}}", "}"))
def progress_lines(spark, sf_dir):
    return views.progress(spark, sf_dir).select("run_id", "seq", files.progress_line("@progress ", "stage", "current", "total").alias("line"))


@query("SELECT user_id AS run_id, arg_max('out/' || event_id || '.md', event_id) AS path FROM events WHERE event_type <> 'view' GROUP BY user_id")
def last_output_path(spark, sf_dir):
    ending = F.when(F.col("event_type") == "view", ".log").otherwise(".md ")
    log = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("out/"), F.col("event_id").cast("string"), ending).alias("line"))
    return P.last_output(log)


# --- files built from the documents, and converted again -------------------


#: Documents of a task that builds and parses files, about, and bytes of built files that are handed on together.
TASK_ROWS, BUILT_BYTES = 2000, 1 << 20


def built(spark, sf_dir, make) -> DataFrame:
    """``(doc_id, content)``: a file of each document. Rows are dealt out first: a table of few row groups would keep few tasks busy for long."""
    ship(spark)
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.count()  # known from the files' footers
    parts = max(1, -(-rows // TASK_ROWS), min(3 * spark.sparkContext.defaultParallelism, rows // 50))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            first, made, held = 0, [], 0
            for i in range(batch.num_rows):
                made.append(make(ids[i].as_py(), texts[i].as_py()))
                held += len(made[-1])
                if held >= BUILT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(made)), pa.array(made, pa.binary())], names=["doc_id", "content"])
                    first, made, held = i + 1, [], 0

    return docs.repartition(parts, "doc_id").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("content", T.BinaryType())]))


@query(
    f"""WITH {views.LINES}, l AS (SELECT doc_id, line_no, {SQUEEZED} AS text FROM lines)
SELECT doc_id, '# Document ' || doc_id || {NL} || {NL} || coalesce(string_agg(text, {NL} || {NL} ORDER BY line_no) FILTER (WHERE text <> '') || {NL} || {NL}, '') || '$\\frac{{a\\le b}}{{2}}$' || {NL} || {NL} || '<table><tr><td colspan="2">wide</td></tr><tr><td>l</td><td>r</td></tr></table>' AS markdown FROM l GROUP BY doc_id"""
)
def docx_convert(spark, sf_dir):
    return convert.docx_markdown(built(spark, sf_dir, packages.docx)).select("doc_id", "markdown")


@query(
    f"""WITH {views.LINES}, l AS (SELECT doc_id, line_no, {SQUEEZED} AS text FROM lines),
p AS (SELECT doc_id, line_no // 12 + 1 AS page_no, string_agg(text, {NL} || {NL} ORDER BY line_no) AS text FROM l WHERE text <> '' GROUP BY ALL)
SELECT doc_id, string_agg('<!-- page ' || page_no || ' -->' || {NL} || {NL} || text, {NL} || {NL} ORDER BY page_no) AS markdown FROM p GROUP BY doc_id"""
)
def pdf_convert(spark, sf_dir):
    return convert.pdf_markdown(built(spark, sf_dir, packages.pdf), mode="fast").where("markdown is not null").select("doc_id", "markdown")


@query(ORACLES["pdf_convert"])
def pdf_convert_packed(spark, sf_dir):
    """Object streams, a cross-reference stream, inherited and indirect entries, a two-byte font, forms."""
    return convert.pdf_markdown(built(spark, sf_dir, packages.packed_pdf), mode="fast").where("markdown is not null").select("doc_id", "markdown")


@query(ORACLES["pdf_convert"])
def pdf_convert_fonts(spark, sf_dir):
    """Embedded TrueType, CFF and Type 1 programs and predefined character maps, none with a ToUnicode map."""
    return convert.pdf_markdown(built(spark, sf_dir, packages.font_pdf), mode="fast").where("markdown is not null").select("doc_id", "markdown")


@query(
    f"""WITH {views.LINES}, l AS (SELECT doc_id, line_no, line_no // 10 + 1 AS page_no, replace({SQUEEZED}, '|', '\\|') AS cell, length(text) AS n FROM lines),
p AS (SELECT doc_id, page_no, string_agg('| ' || line_no || ' | ' || cell || ' | ' || n || ' |', {NL} ORDER BY line_no) AS body FROM l GROUP BY ALL),
t AS (SELECT *, '| no | line | n |' AS heads, '| --- | --- | --- |' AS bar FROM p)
SELECT doc_id, string_agg('<!-- page ' || page_no || ' -->' || {NL} || {NL} || CASE WHEN page_no % 3 = 0 THEN '| title of page ' || page_no || ' |  |  |' || {NL} || bar || {NL} || heads ELSE heads || {NL} || bar END || {NL} || body, {NL} || {NL} ORDER BY page_no) AS markdown FROM t GROUP BY doc_id"""
)
def pdf_ruled_tables(spark, sf_dir):
    """Academic mode, without a provider: tables that ruling lines enclose, as Markdown."""
    made = convert.pdf_markdown(built(spark, sf_dir, packages.table_pdf), table_text=True)
    return made.where("error is null").select("doc_id", "markdown")


@query(
    f"""WITH {views.LINES}, l AS (SELECT doc_id, line_no, {SQUEEZED} AS text FROM lines)
SELECT doc_id, '# Document ' || doc_id || {NL} || {NL} || coalesce(string_agg(text, {NL} || {NL} ORDER BY line_no) FILTER (WHERE text <> '') || {NL} || {NL}, '') || '1. one' || {NL} || '  * *in* it' || {NL} || '2. [two](u)' || {NL} || {NL} || '| n | **v** |' || {NL} || '| --- | --- |' || {NL} || '| ' || doc_id || ' | a\\|b |' AS markdown FROM l GROUP BY doc_id"""
)
def html_convert(spark, sf_dir):
    pages = built(spark, sf_dir, packages.html).select("doc_id", F.decode("content", "UTF-8").alias("html"))
    return convert.html_markdown(pages).select("doc_id", "markdown")


@query(
    f"""WITH {views.LINES}, p AS (SELECT doc_id, max(line_no) // 12 + 1 AS pages FROM lines GROUP BY doc_id),
e AS (SELECT doc_id, i FROM p, unnest(range(1, pages + 1)) AS t(i) WHERE i <> 2),
a AS (SELECT doc_id, string_agg('page-' || lpad(i::VARCHAR, 4, '0') || '-01-figure.png=' || i || ' 98.0 98.0 202.0 152.0 2.0;page-' || lpad(i::VARCHAR, 4, '0') || '-03-table.png=' || i || ' 0.0 297.0 203.0 353.0 3.0', ';' ORDER BY i) AS pictures, count(*) AS formulas FROM e GROUP BY doc_id)
SELECT doc_id, pictures, formulas::INT AS formulas, formulas::INT * 2 AS links, (pages > 1)::INT AS skipped FROM p JOIN a USING (doc_id)"""
)
def pdf_regions(spark, sf_dir):
    """Academic mode with regions on every page but the second, where detection fails: paddings and scales by label, names, links, formulas."""
    chosen = Providers(layout=packages.layout, render=packages.picture, formula=packages.formula)
    made = convert.pdf_conversion(built(spark, sf_dir, packages.pdf), assets="x", providers=chosen)
    shown = F.array_sort(F.collect_list(F.concat("rel_path", F.lit("="), F.decode("content", "UTF-8"))))
    pictures = made.assets.groupBy("doc_id").agg(F.array_join(shown, ";").alias("pictures"))
    count = lambda pattern: F.regexp_count("markdown", F.lit(pattern))
    texts = made.documents.where("error is null").select(
        "doc_id",
        count(r"\$\$\ny = \d+\n\$\$").alias("formulas"),
        count(r"!\[(?:figure|table) page \d+\]\(x/page-\d{4}-0[13]-(?:figure|table)\.png\)").alias("links"),
        count(r"<!-- layout detection skipped on page 2: RuntimeError: no model -->").alias("skipped"),
    )
    return texts.join(merged(pictures), "doc_id").select("doc_id", "pictures", "formulas", "links", "skipped")


@query(
    f"""WITH {views.LINES}, l AS (SELECT doc_id, line_no, replace(replace(replace({SQUEEZED}, '$', 'S'), '*', '\\*'), '_', '\\_') AS text FROM lines),
g AS (SELECT doc_id, string_agg(CASE WHEN text = '' THEN '*' ELSE '* ' || text END, {NL} ORDER BY line_no) FILTER (WHERE line_no % 3 = 0) AS items,
  string_agg('| ' || line_no // 3 || ' | ' || replace(text, '|', '\\|') || CASE WHEN text = '' THEN '' ELSE ' ' END || 'in |', {NL} ORDER BY line_no) FILTER (WHERE line_no % 3 = 1) AS rows,
  string_agg('> ' || text, {NL} || '>' || {NL} ORDER BY line_no) FILTER (WHERE line_no % 3 = 2 AND text <> '') AS quoted FROM l GROUP BY doc_id)
SELECT doc_id, 'Items of *' || doc_id || '*' || {NL} || {NL} || '* none' || {NL} || items || {NL} || {NL} || '| k | v |' || {NL} || '| --- | --- |' || coalesce({NL} || rows, '') || {NL} || {NL} || '> quoted' || coalesce({NL} || '>' || {NL} || quoted, '') || {NL} || {NL} || 'end' AS markdown, 'd' || doc_id AS title FROM g"""
)
def html_tree(spark, sf_dir):
    """Pages that leave end tags out, as files are converted: with escapes, block quotes and tables in cells."""
    pages = built(spark, sf_dir, packages.loose_html).select("doc_id", F.decode("content", "UTF-8").alias("html"))
    return convert.html_markdown(pages, escape=True).select("doc_id", "markdown", "title")


# --- headings that are split off -------------------------------------------

A_NAME = "upper(left(p_name, 1)) || substr(p_name, 2)"


@query(
    f"""SELECT p_partkey,
  '## ' || p_size || '. ' || {A_NAME} || {NL} || {NL} || '### ' || p_size || '.' || (p_partkey % 9 + 1) || '. Then ' || p_name AS combined,
  CASE WHEN p_partkey % 3 = 0 THEN '## Abstract' ELSE '### 2.' || p_size || '. ' || {A_NAME} END || {NL} || {NL} || 'the body of it' AS led,
  CASE WHEN p_partkey % 4 = 0 THEN '#### 3.' || (p_size % 20) || ' 海洋模型' || {NL} || {NL} || '本文' || p_name END AS han FROM part"""
)
def heading_splits(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    name = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)))
    number = F.col("p_size").cast("string")
    combined = F.concat(number, F.lit(" "), name, F.lit("  "), number, F.lit("."), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(". Then "), F.col("p_name"))
    span = F.when(F.col("p_partkey") % 3 == 0, "ABSTRACT").otherwise(F.concat(F.lit("2."), number, F.lit("  "), name))
    han = F.concat(F.lit("3."), (F.col("p_size") % 20).cast("string"), F.lit(" 海洋模型 "), F.when(F.col("p_partkey") % 4 == 0, "本文").otherwise("无"), F.col("p_name"))
    led = headings.leading_span(F.concat(text.squeeze(span), F.lit(" the body of it")), span, F.lit(200.0), F.lit(600.0))
    return part.select("p_partkey", headings.combined_numbered(combined).alias("combined"), led.alias("led"), headings.han_prefix(han, F.lit(4)).alias("han"))
