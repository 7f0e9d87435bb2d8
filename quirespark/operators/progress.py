"""Progress events as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import stage_progress


def high_water(events: DataFrame) -> DataFrame:
    """Adds ``progress``: the most that a run has reached so far."""
    own = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("progress", F.max(stage_progress(F.col("stage"), F.col("current"), F.col("total"))).over(own))


def last_output(log: DataFrame) -> DataFrame:
    """``(run_id, path)``: the last log line of a run that ends with ``.md``."""
    line = F.trim("line")
    return log.where(line.endswith(".md")).groupBy("run_id").agg(F.max_by(line, F.col("seq")).alias("path"))
