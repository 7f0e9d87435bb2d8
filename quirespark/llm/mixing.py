"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose documents stand in a shuffled order, by a hash of id, text
and pass; a document's virtual finish time is the number of its source's words up
to and with it, divided by the source's target. All flows are served in proportion
to their targets, so that the whole budget is spent at virtual time 1: the mix is
the global order of the finish times, cut there. A document that is in service at
that moment is taken up to the words that it was served. A source whose target
exceeds its size goes through its documents again, in another order.

Cumulative words of a source are summed in two steps, within buckets of the
shuffled order and over buckets, so that no source lies in one task. Targets come
from repeated sums over the table of sources; the driver sees one level at a time.

Edge cases. A null text has size 0 and is taken 0 times; so is every document of a
source without words. The null source comes last. Each row stands for itself, also
when it repeats another. Documents of one source with equal hashes stand in order
of id, then row. An empty table gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_points, offsets, pick, range_of, shuffle_partitions, stored

#: Documents of a bucket of the shuffled order, on average.
BUCKET_ROWS = 8192
BITS = 31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, n_docs, target)``: weights repeat over sources in order of code points, null last."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    parts = shuffle_partitions(spark)
    ranged = stored(totals.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = offsets(ranged, "part", F.count("*"), parts)
    rank = pick(before, F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.lit(list(weights))
    flows = stored(ranged.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).cast("long")).withColumn("most", F.col("source_size") * F.lit(most)))
    whole, heavy = flows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, above = share * (whole or 0), 0.0, -1
    free, fixed = heavy or 0, 0.0
    while free:
        level = (budget - fixed) / free
        over = F.col("weight") * F.lit(level) > F.col("most")
        count, fixed, free = flows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if count == above:
            break
        above = count
    return flows.select("source", "source_size", "n_docs", F.least(F.col("most"), F.col("weight") * F.lit(level)).cast("double").alias("target"))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The rows, and the mix.

    Rows: ``(row, doc_id, text_hash, source, size, source_size, target)``. Mix: ``(row, pass, taken, finish, at)``,
    where ``at`` counts the words that stand before a document in the mix.
    """
    sizes = stored(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
        )
    )
    targets = source_targets(sizes, weights, share, most)
    rows = sizes.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.n_docs", "b.target")
    passes = F.ceil(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("int")
    again = rows.where("size > 0").select("row", "doc_id", "text_hash", "source", "size", "source_size", "n_docs", "target", F.explode(F.filter(F.sequence(F.lit(0), F.lit(int(most))), lambda k: k < passes)).alias("pass"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("pass"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash")), 64 - BITS)  # the text tells rows without an id apart
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    flow = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    queued = again.withColumn("place", place).withColumn("bucket", F.floor(F.col("place") * buckets / F.lit(float(1 << BITS)))).withColumn("flow", flow)
    sums = queued.groupBy("flow", "pass", "bucket").agg(F.sum("size").alias("words"))
    earlier = sums.withColumn("earlier", F.coalesce(F.sum("words").over(Window.partitionBy("flow").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("flow", "pass", "bucket").orderBy("place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    served = queued.join(earlier, ["flow", "pass", "bucket"]).withColumn("before", F.col("earlier") + inside)
    timed = served.select(
        "row",
        "doc_id",
        "pass",
        F.least(F.col("size"), F.floor("target") - F.col("before")).alias("taken"),
        F.least(F.lit(1.0), (F.col("before") + F.col("size")) / F.col("target")).alias("finish"),
    ).where("taken > 0")
    timed = stored(timed)
    cuts = cut_points(timed, "finish", shuffle_partitions(df.sparkSession))
    ranged = timed.withColumn("part", range_of(F.col("finish"), cuts))
    before = offsets(ranged, "part", F.sum("taken"), len(cuts) + 1)
    running = F.sum("taken").over(Window.partitionBy("part").orderBy("finish", "doc_id", "pass", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("taken")
    whole = sizes.agg(F.sum("size")).first()[0] or 0
    ordered = ranged.withColumn("at", pick(before, F.col("part")) + running)
    return rows.drop("n_docs"), ordered.select("row", "pass", F.least(F.col("taken"), F.lit(int(share * whole)) - F.col("at")).alias("taken"), "finish", "at").where("taken > 0")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words taken of it."""
    rows, mixed = mix(df, **options)
    taken = mixed.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("at").alias("mix_start"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).alias("taken"), "mix_start")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with all their columns, as often as the mix takes them: a pass counts from half a document."""
    rows, mixed = mix(df, id_col=id_col, text_col=text_col, **options)
    copies = mixed.join(rows.select("row", "doc_id", "text_hash", "size"), "row").where("2 * taken >= size").groupBy("doc_id", "text_hash", "row").agg(F.count("*").alias("copies")).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("__quire_copies"))
    keyed = copies.select(F.col("doc_id").alias("__quire_id"), F.col("text_hash").alias("__quire_hash"), "__quire_copies")
    match = F.col(id_col).eqNullSafe(F.col("__quire_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__quire_hash"))
    return df.join(keyed, match).withColumn("__quire_copies", F.explode(F.sequence(F.lit(1), F.col("__quire_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])
