"""Markdown as blocks: which lines are translated, and which are left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import FENCE, structural, text_lines, translatable
from ..functions.text import strip


def markdown_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """``(id, line_no, line)``, terminators kept."""
    return df.select(id_col, F.posexplode(text_lines(F.col(text_col))).alias("line_no", "line"))


def markdown_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """``(id, block_no, text, translatable)``: paragraphs, and every other line by itself.

    Fences and formulas toggle two states, which are parities over the lines before; runs of
    ordinary lines are islands. All windows part by document alone.
    """
    lines = markdown_lines(df, id_col, text_col)
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = strip(F.col("line"))
    fence = F.regexp_replace(F.col("line"), r"^(?U)[\s\x1c-\x1f]+", "").startswith(FENCE)
    math = ~fence & s.startswith("$$")
    odd = F.size(F.split(F.col("line"), r"\$\$", -1)) % 2 == 0
    marked = lines.withColumn("fence", fence.cast("int")).withColumn("math", math.cast("int")).withColumn("odd", (math & odd).cast("int"))
    state = marked.withColumn("in_fence", F.coalesce(F.sum("fence").over(before), F.lit(0)) % 2).withColumn("in_math", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    plain = (F.col("fence") == 0) & (F.col("math") == 0) & (F.col("in_fence") == 0) & (s != "") & (F.col("in_math") == 0) & ~structural(F.col("line"))
    ordinary = state.withColumn("plain", plain.cast("int"))
    opens = F.when((F.col("plain") == 1) & (F.coalesce(F.lag("plain").over(Window.partitionBy(id_col).orderBy("line_no")), F.lit(0)) == 1), 0).otherwise(1)
    islands = ordinary.withColumn("opens", opens).withColumn("block_no", F.sum("opens").over(upto) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return islands.groupBy(id_col, "block_no").agg(text.alias("text"), F.max("plain").alias("plain")).select(id_col, F.col("block_no").cast("int").alias("block_no"), "text", ((F.col("plain") == 1) & translatable(F.col("text"))).alias("translatable"))


def joined_blocks(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks in order as one text again."""
    return blocks.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "").alias("markdown"))
