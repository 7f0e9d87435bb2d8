"""Markdown translation: split, protect, chunk, ask a provider about each distinct chunk once, put together again.

Equal chunks of any documents meet in one row before the calls, counted in parts. With a ``memory``, a folder of answers by digest, chunks that
were answered in an earlier run aren't asked about again; answers are added to it by Spark's own commit, errors never. Calls run
in as many tasks as ``calls`` says, one after the other in each, so that a service sees no more of them at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import LIMITS, chunks, prefix_split, protect, restore
from ..operators.blocks import markdown_blocks
from ..scratch import stored

ATTEMPTS, PAUSE = 3, 0.5


def translate(df: DataFrame, provider: Callable[[str, str, str], str] | None = None, service: str = "google", lang_in: str = "en", lang_out: str = "zh", id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """``(id, markdown)``. ``provider(text, lang_in, lang_out)`` gets a chunk at a time; without one the text stays as it is."""
    return translated(df, provider, service, lang_in, lang_out, id_col, text_col).select(id_col, "markdown")


def digest(chunk, service: str, lang_in: str, lang_out: str):
    return F.sha2(F.concat_ws("\x00", F.lit(service), F.lit(lang_in), F.lit(lang_out), chunk), 256)


def remembered(spark, memory: str | None) -> DataFrame:
    """``(digest, answer)`` of earlier runs."""
    schema = "digest string, answer string"
    if memory is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(memory)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(memory).groupBy("digest").agg(F.min("answer").alias("answer"))  # two runs at once may both have asked
    return spark.createDataFrame([], schema)


def answered(chunks: DataFrame, provider: Callable[[str, str, str], str], service: str, lang_in: str, lang_out: str, pause: float = PAUSE, memory: str | None = None, calls: int | None = None) -> DataFrame:
    """``(digest, answer, error)`` of every distinct ``chunk``; those that the memory doesn't know are asked about, once each."""
    spark = chunks.sparkSession

    def one(text: str) -> tuple[str | None, str | None]:
        for attempt in range(ATTEMPTS):
            try:
                return provider(text, lang_in, lang_out), None
            except Exception as e:  # the next attempt, or the text as it is
                failed = f"{type(e).__name__}: {e}"
                if attempt + 1 < ATTEMPTS:
                    time.sleep(pause * 2**attempt)
        return None, failed

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # answers are handed on while later ones are waited for
                keys, texts = (c.to_pylist() for c in batch.slice(i, 64).columns)
                made = [one(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["digest", "answer", "error"])

    key = digest(F.col("chunk"), service, lang_in, lang_out)
    wanted = chunks.select(key.alias("digest"), "chunk").groupBy("digest").agg(F.min("chunk").alias("chunk"))
    known = remembered(spark, memory)
    new = wanted.join(known.select("digest"), "digest", "left_anti") if memory is not None else wanted
    said = stored(new.repartition(calls or spark.sparkContext.defaultParallelism).mapInArrow(ask, "digest string, answer string, error string"))
    if memory is not None:
        known = stored(known.join(wanted.select("digest"), "digest", "left_semi"))
        said.where("error is null").select("digest", "answer").write.mode("append").parquet(memory)
    return said.unionByName(known.withColumn("error", F.lit(None).cast("string")))


def translated(df: DataFrame, provider: Callable[[str, str, str], str] | None = None, service: str = "google", lang_in: str = "en", lang_out: str = "zh", id_col: str = "doc_id", text_col: str = "markdown", pause: float = PAUSE, memory: str | None = None, calls: int | None = None) -> DataFrame:
    """``(id, markdown, blocks, translation_error)``: :func:`translate` with the number of translated blocks and the first error.

    A chunk that the provider fails on is tried again, ``ATTEMPTS`` times in all with growing pauses; then it stays as it is.
    Equal chunks are asked about once, and not at all if ``memory`` has their answer.
    """
    if service not in LIMITS:
        raise ValueError(f"unsupported translation service: {service}")
    blocks = markdown_blocks(df, id_col, text_col)
    ends = F.col("text").endswith("\n")
    bare = F.when(ends, F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    parts = blocks.withColumn("ends", ends).withColumn("split", prefix_split(bare)).withColumn("safe", protect(F.col("split.body"))).withColumn("chunks", chunks(F.col("safe.text"), LIMITS[service]))
    error = F.lit(None).cast("string")
    if provider is not None:
        parts = stored(parts)
        each = parts.where("translatable").select(F.col(id_col).alias("__id"), F.col("block_no").alias("__no"), F.posexplode("chunks").alias("at", "chunk"))
        said = answered(each.select("chunk"), provider, service, lang_in, lang_out, pause, memory, calls)
        both = each.withColumn("digest", digest(F.col("chunk"), service, lang_in, lang_out)).join(said, "digest")
        ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("answer", "chunk").alias("text"), "error")))
        answers = both.groupBy("__id", "__no").agg(ordered.alias("said"))
        parts = parts.join(answers, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("block_no") == F.col("__no")), "left")
        parts = parts.withColumn("chunks", F.coalesce(F.transform("said", lambda x: x["text"]), "chunks"))
        error = F.get(F.filter(F.transform("said", lambda x: x["error"]), lambda e: e.isNotNull()), 0)
    done = F.concat(F.col("split.prefix"), restore(F.array_join("chunks", " "), F.col("safe.spans")), F.when(F.col("ends"), "\n").otherwise(""))
    counts = F.col("translatable") & (F.trim("split.body") != "")
    whole = parts.select(id_col, "block_no", F.when(counts, done).otherwise(F.col("text")).alias("text"), counts.cast("int").alias("counts"), error.alias("failed"))
    listed = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    text = F.array_join(F.transform(listed, lambda b: b["text"]), "")
    return whole.groupBy(id_col).agg(text.alias("markdown"), F.sum("counts").cast("int").alias("blocks"), F.min_by("failed", F.when(F.col("failed").isNotNull(), F.col("block_no"))).alias("translation_error"))
