"""Inputs derived from the driver's tables by integer arithmetic, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 600, 842


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.expr("(doc_id * 31 + line_no * 17) % 5 = 0")
    base = lines(spark, sf_dir).withColumn("full", full)
    return base.select(
        "doc_id",
        F.expr("CAST(line_no div 12 + 1 AS INT)").alias("page_no"),
        F.expr("CAST(line_no % 12 AS INT)").alias("block_no"),
        F.expr("CAST(line_no % 12 AS INT)").alias("item_no"),
        "line_no",
        F.when(F.col("full"), 40).otherwise(F.expr("40 + 270 * (line_no % 2) + (doc_id + line_no) % 3")).cast("double").alias("x0"),
        F.when(F.col("full"), 520).otherwise(240).cast("double").alias("width"),
        F.expr("40 + 70 * (line_no % 12)").cast("double").alias("y0"),
        F.expr("40 + 70 * (line_no % 12) + 20 + (doc_id * 7 + line_no * 11) % 60").cast("double").alias("y1"),
        F.expr("9 + (doc_id * 3 + line_no * 7) % 5").cast("double").alias("size"),
        F.expr("CASE WHEN (doc_id + line_no) % 4 = 0 THEN 16 WHEN (doc_id + line_no) % 6 = 0 THEN 2 ELSE 0 END").alias("flags"),
        "text",
    ).withColumn("x1", F.col("x0") + F.col("width"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = blocks(spark, sf_dir).select("doc_id", "page_no").distinct()
    each = pages.select("doc_id", "page_no", F.explode(F.sequence(F.lit(0), F.expr("CAST(doc_id % 4 AS INT)"))).alias("seq"))
    label = F.element_at(F.array(F.lit("figure"), F.lit("table"), F.lit("isolate_formula")), F.expr("CAST((seq + doc_id + page_no) % 3 AS INT) + 1"))
    return each.select(
        "doc_id",
        "page_no",
        "seq",
        label.alias("label"),
        F.expr("((doc_id * 37 + page_no * 13 + seq * 29) % 100) / 100.0D").alias("confidence"),
        F.expr("CAST(40 + 270 * (doc_id % 2) AS INT)").alias("x0"),
        F.expr("CAST(100 + 65 * ((doc_id + (seq % 3) * 2) % 9) + (seq div 3) * 5 * (doc_id % 5) AS INT)").alias("y0"),
        F.expr("CAST(280 + 270 * (doc_id % 2) AS INT)").alias("x1"),
        F.expr("CAST(160 + 65 * ((doc_id + (seq % 3) * 2) % 9) + (seq div 3) * 5 * (doc_id % 5) AS INT)").alias("y1"),
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    part = F.transform("turns", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"], F.lit("\n\n")))
    return turns.select(F.col("conv_id").alias("doc_id"), F.array_join(part, "").alias("markdown"))


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown with code fences, formulas over several lines and rules between their lines."""
    n = F.expr("CAST((doc_id * 5 + line_no) % 13 AS INT)")
    shown = F.when(n.isin(2, 5), "```").when(n == 7, F.concat(F.lit("$$ "), F.col("text"))).when(n == 9, "x $$").when(n == 10, "$$ a $$").when(n == 11, "---").when(n == 12, "").otherwise(F.col("text"))
    each = lines(spark, sf_dir).withColumn("text", shown)
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("markdown"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.expr("CASE event_type WHEN 'view' THEN 'pages' WHEN 'click' THEN 'docx' WHEN 'signup' THEN 'images' WHEN 'purchase' THEN 'translation' ELSE 'markdown' END")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), stage.alias("stage"), F.expr("CAST(floor(value) AS INT) % 10").alias("current"), F.lit(10).alias("total"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("stem"))
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.array_join(F.array_repeat(F.col("p_name"), F.expr("p_size % 12 + 1")), "_").alias("stem"))
    return urls.unionByName(names)


# --- the same in DuckDB ----------------------------------------------------

LINES = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line_no, parts[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i))"""
BLOCKS = (
    LINES
    + """, blocks AS (
  SELECT *, x0 + width AS x1 FROM (
    SELECT doc_id, line_no // 12 + 1 AS page_no, line_no % 12 AS item_no, line_no,
      CAST(CASE WHEN (doc_id*31 + line_no*17) % 5 = 0 THEN 40 ELSE 40 + 270*(line_no % 2) + (doc_id + line_no) % 3 END AS DOUBLE) AS x0,
      CAST(CASE WHEN (doc_id*31 + line_no*17) % 5 = 0 THEN 520 ELSE 240 END AS DOUBLE) AS width,
      CAST(40 + 70*(line_no % 12) AS DOUBLE) AS y0,
      CAST(40 + 70*(line_no % 12) + 20 + (doc_id*7 + line_no*11) % 60 AS DOUBLE) AS y1,
      CAST(9 + (doc_id*3 + line_no*7) % 5 AS DOUBLE) AS size,
      CASE WHEN (doc_id + line_no) % 4 = 0 THEN 16 WHEN (doc_id + line_no) % 6 = 0 THEN 2 ELSE 0 END AS flags, text
    FROM lines))"""
)
REGIONS = """regions AS (
  SELECT doc_id, page_no, seq, (['figure','table','isolate_formula'])[CAST((seq + doc_id + page_no) % 3 AS INT) + 1] AS label,
    ((doc_id*37 + page_no*13 + seq*29) % 100) / 100.0 AS confidence,
    CAST(40 + 270*(doc_id % 2) AS INT) AS x0, CAST(100 + 65*((doc_id + (seq % 3)*2) % 9) + (seq // 3)*5*(doc_id % 5) AS INT) AS y0,
    CAST(280 + 270*(doc_id % 2) AS INT) AS x1, CAST(160 + 65*((doc_id + (seq % 3)*2) % 9) + (seq // 3)*5*(doc_id % 5) AS INT) AS y1
  FROM (SELECT DISTINCT doc_id, page_no FROM blocks) p, unnest(range(0, CAST(doc_id % 4 AS INT) + 1)) AS t(seq))"""
MARKDOWN = """md AS (
  SELECT conv_id AS doc_id, string_agg('## ' || role || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id)"""
FENCED = (
    LINES
    + """, fl AS (SELECT doc_id, line_no, CAST((doc_id * 5 + line_no) % 13 AS INT) AS n, text FROM lines),
md AS (SELECT doc_id, string_agg(CASE WHEN n IN (2, 5) THEN repeat('`', 3) WHEN n = 7 THEN '$$ ' || text WHEN n = 9 THEN 'x $$' WHEN n = 10 THEN '$$ a $$' WHEN n = 11 THEN '---' WHEN n = 12 THEN '' ELSE text END, chr(10) ORDER BY line_no) AS markdown FROM fl GROUP BY doc_id)"""
)
PROGRESS = """progress AS (
  SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'pages' WHEN 'click' THEN 'docx' WHEN 'signup' THEN 'images' WHEN 'purchase' THEN 'translation' ELSE 'markdown' END AS stage,
    CAST(floor(value) AS INT) % 10 AS current, 10 AS total FROM events)"""
STEMS = """stems AS (
  SELECT 'u' || page_id AS key, url AS stem FROM pages
  UNION ALL SELECT 'p' || p_partkey, rtrim(repeat(p_name || '_', p_size % 12 + 1), '_') FROM part)"""
