"""Marks over shuffled micro-batches and a restart, and answers that are asked for once."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirespark.operators.progress import high_water
from quirespark.plans.translate import translated
from quirespark.streaming.progress import high_water_stream, marks

SCHEMA = "run_id string, seq long, stage string, current int, total int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=12), st.randoms(), st.integers(1, 4))
def test_marks_in_any_order(values, rng, size):
    events = list(enumerate(values))
    rng.shuffle(events)
    seqs, stated, last = [], [], {}
    for at in range(0, len(events), size):
        last |= marks(seqs, stated, events[at : at + size])
    high, want = 0.0, {}
    for seq, value in enumerate(values):
        high = max(high, value)
        want[seq] = high
    assert last == want


def events():
    out = []
    for run in range(6):
        n = 5 + run
        steps = [("prepare", 0, 0), *[("pages", i, n) for i in range(1, n + 1)], ("images", 1, 2), ("markdown", 1, 1), ("write", 1, 1)] + ([("done", 1, 1)] if run % 2 else [])
        out += [(f"r{run}", seq, *step) for seq, step in enumerate(steps)]
    return out


def test_shuffled_batches_and_a_restart(spark, tmp_path):
    rows = events()
    random.Random(5).shuffle(rows)
    source, table, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def drain():
        def batch(df, number):
            df.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = high_water_stream(stream, expiry_ms=None).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
        assert query.awaitTermination(100) and query.exception() is None

    third = len(rows) // 3
    spark.createDataFrame(rows[:third], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame(rows[third : 2 * third], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    drain()
    spark.createDataFrame(rows[2 * third :], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    drain()  # another query, from the checkpoint
    newest = Window.partitionBy("run_id", "seq").orderBy(F.desc("batch"))
    got = spark.read.parquet(table).withColumn("n", F.row_number().over(newest)).where("n = 1").select("run_id", "seq", "progress").collect()
    want = high_water(spark.createDataFrame(rows, SCHEMA)).select("run_id", "seq", "progress").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == len(rows)


def test_equal_chunks_are_asked_about_once(spark, tmp_path):
    log, memory = str(tmp_path / "calls"), str(tmp_path / "memory")

    def provider(text, lang_in, lang_out):
        with open(log, "a") as f:
            f.write(text.replace("\n", " ") + "\n")
        if "bad" in text:
            raise TimeoutError("too slow")
        return f"{lang_out} {text}"

    def asked():
        with open(log) as f:
            return f.read().splitlines()

    docs = [(i, f"the same license\n\nown text {i % 3}\n\n`code`") for i in range(40)] + [(None, "the same license"), (99, "bad text"), (100, None)]
    df = spark.createDataFrame(docs, "doc_id long, markdown string").repartition(5)
    run = lambda: {r.doc_id: r for r in translated(df, provider, pause=0.0, memory=memory, calls=2).collect()}
    first = run()
    assert sorted(asked()) == sorted(["the same license", "own text 0", "own text 1", "own text 2", "{v0}", "bad text", "bad text", "bad text"])
    assert first[5].markdown == "zh the same license\n\nzh own text 2\n\nzh `code`" and first[None].markdown == "zh the same license"
    assert first[99].markdown == "bad text" and first[99].translation_error == "TimeoutError: too slow" and first[5].translation_error is None
    open(log, "w").close()
    again = run()
    assert asked() == ["bad text"] * 3  # errors aren't remembered
    assert {k: tuple(r) for k, r in again.items()} == {k: tuple(r) for k, r in first.items()}
    other = translated(df.where("doc_id = 5"), provider, lang_out="de", pause=0.0, memory=memory).first()
    assert other.markdown.startswith("de the same")  # another language is another question


def test_runs_that_go_silent_are_forgotten(spark, tmp_path):
    import time

    source, check, seen = str(tmp_path / "in"), str(tmp_path / "check"), []

    def batch(df, number):
        seen.extend(tuple(r) for r in df.collect())

    def send(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def until(done):
        end = time.time() + 90
        while not done() and time.time() < end:
            time.sleep(0.5)
        assert done()

    send(("r", 5, "pages", 9, 10))
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = high_water_stream(stream, expiry_ms=2000).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        until(lambda: len(seen) == 1)
        until(lambda: any(op.numRowsTotal == 0 for p in query.recentProgress for op in p.stateOperators))  # its state is gone
        send(("r", 6, "pages", 1, 10))
        until(lambda: len(seen) == 2)
    finally:
        query.stop()
    assert [(s, round(p, 3)) for _, s, p in seen] == [(5, 0.725), (6, 0.125)]
