"""Heading styles of word-processor documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import style_line


def style_map(names: DataFrame, levels: DataFrame, user: str = "") -> DataFrame:
    """``(doc_id, style_map)`` from ``names(doc_id, style_id, name)`` and ``levels(doc_id, style_id, level, ord)``.

    The least level of a style counts, wherever it was set. Lines stand in order of level, then of first mention.
    """
    least = levels.withColumn("level", F.col("level").try_cast("int")).where("level is not null").groupBy("doc_id", "style_id").agg(F.min("level").alias("level"), F.min("ord").alias("ord"))
    named = least.join(names, ["doc_id", "style_id"], "left").withColumn("line", style_line(F.coalesce("name", F.lit("")), F.col("level"))).where("line is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("level", "ord", "line"))), lambda x: x["line"])
    return named.groupBy("doc_id").agg(F.array_join(F.concat(lines, F.filter(F.array(F.lit(user)), lambda u: u != "")), "\n").alias("style_map"))
