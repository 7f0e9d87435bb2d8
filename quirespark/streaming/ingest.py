"""Files that arrive in a folder, converted micro-batch by micro-batch.

No operator spans documents, so that no watermark and no state is needed; a batch that
is repeated writes the same partition again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import convert
from ..scratch import scratch
from ..sources.files import list_files, reachable, read_files


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Converts the files of ``folder`` into the Parquet table ``table``, and their progress into ``<table>_progress``."""

    def batch(files: DataFrame, number: int) -> None:
        with scratch(spark):  # parsed pages go with their batch
            convert(files, **options).write.mode("overwrite").parquet(f"{table}/batch={number}")
        written = spark.read.parquet(f"{table}/batch={number}")
        events = written.select(F.lit(str(number)).alias("run_id"), F.xxhash64("doc_id").alias("seq"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("stage"), F.lit(1).alias("current"), F.lit(1).alias("total"), F.col("error").alias("message"))
        events.write.mode("overwrite").parquet(f"{table}_progress/batch={number}")

    arriving = list_files if options.get("opener") or reachable(folder) else read_files  # the task that parses a file opens it
    writer = arriving(spark, folder, stream=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
