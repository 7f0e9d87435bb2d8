"""Listings whose files are opened once, by the task that parses them; output that comes whole or not at all."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quirespark import cli, registry
from quirespark.plans import convert, packages, sinks
from quirespark.providers import Providers
from quirespark.sources import files
from quirespark.streaming.ingest import watch

from .test_sources import package


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    (top / "deep").mkdir(parents=True)
    for i in range(5):
        (top / f"a {i}.pdf").write_bytes(packages.packed_pdf(i, "\n".join(f"text of {i}, line {k}" for k in range(20))))
    (top / "B.PDF").write_bytes(packages.pdf(9, "upper case ending"))
    (top / "w.docx").write_bytes(package())
    (top / "p.html").write_bytes(packages.html(3, "a line"))
    (top / "t.md").write_text("# title\n\ntext")
    (top / "bad.pdf").write_bytes(b"junk")
    (top / "empty.txt").write_bytes(b"")
    (top / "big.bin").write_bytes(os.urandom(1 << 20))  # nothing takes it
    return top


def opener(log):
    def run(path):
        data = files.read_path(path)
        with open(log, "a") as f:
            f.write(f"{os.path.basename(path)} {len(data)}\n")
        return data

    return run


def opened(log):
    return sorted(tuple(x.rsplit(" ", 1)) for x in open(log).read().splitlines())


def accepted(top):
    return sorted((p.name, str(p.stat().st_size)) for p in top.iterdir() if p.is_file() and p.suffix != ".bin")


def test_files_are_opened_once_and_only_accepted_ones(spark, folder, tmp_path):
    log = tmp_path / "opened"
    made = convert.path_conversion(spark, f"{folder}/*", mode="fast", opener=opener(log))
    rows = {os.path.basename(r.doc_id): r for r in made.documents.collect()}
    assert made.documents.count() == 11 and made.events.count() > 0 and made.assets.count() > 0
    assert opened(log) == accepted(folder)  # bytes read are those of the accepted files, once each, whatever is asked for
    assert "text of 3, line 19" in rows["a 3.pdf"].markdown and "upper case" in rows["B.PDF"].markdown and rows["empty.txt"].markdown == "" and rows["t.md"].markdown.startswith("# title")
    assert rows["bad.pdf"].error.startswith("ValueError") and rows["p.html"].markdown.startswith("# Document 3")


def test_listings_equal_content(spark, folder):
    paths = {r.doc_id: (r.markdown, r.title, r.error) for r in convert.convert_path(spark, f"{folder}/*", mode="fast").collect()}
    content = {r.doc_id: (r.markdown, r.title, r.error) for r in convert.convert(files.read_files(spark, f"{folder}/*"), mode="fast").collect()}
    empty = paths.pop(f"file:{folder}/empty.txt")  # which Spark's own scan leaves out
    assert paths == content and len(paths) == 10 and empty == ("", None, None)


def test_no_exchange_holds_content(spark, folder, monkeypatch):
    plans, was = [], convert.stored

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return was(df)

    monkeypatch.setattr(convert, "stored", watched)
    providers = Providers(layout=lambda data, no, width, height: [("figure", 0.9, 30, 90, 300, 125)], render=lambda data, page, box, scale: b"PNG")
    made = convert.path_conversion(spark, f"{folder}/*", lambda d: d.withColumn("assets", F.lit("x")), providers=providers)
    plans.append(made.documents._jdf.queryExecution().executedPlan().toString())
    assert made.assets.count() > 0
    assert not any(re.search(r"\bcontent#", line) for plan in plans for line in plan.split("\n") if "Assets" not in line)
    exchanges = [line for plan in plans for line in plan.split("\n") if "Exchange" in line]
    assert exchanges and not any("content" in line for line in exchanges)


def test_files_are_dealt_out_by_bytes(spark):
    sizes = [(f"/x/{i}", (i % 97) * 1000 + (5_000_000 if i % 500 == 0 else 0)) for i in range(4000)]
    listing = spark.createDataFrame(sizes, "path string, length long").withColumn("doc_id", F.col("path"))
    dealt = files.balanced(listing, 1 << 20).groupBy(F.spark_partition_id()).agg(F.sum("length"), F.max("length"), F.count("*")).collect()
    total = sum(s for _, s in sizes) + 4096 * len(sizes)
    assert sum(r[3] for r in dealt) == 4000 and total / (1 << 20) * 0.7 < len(dealt)
    assert all(r[1] <= 3 * (1 << 20) + r[2] for r in dealt)
    assert files.balanced(listing.limit(0)).count() == 0


def test_files_that_go_missing(spark, folder):
    listing = files.list_files(spark, f"{folder}/*").cache()
    assert listing.count() == 12
    (folder / "a 1.pdf").unlink()
    (folder / "w.docx").unlink()
    rows = {os.path.basename(r.doc_id): r for r in convert.convert(listing, mode="fast").collect()}
    assert rows["a 1.pdf"].error.startswith("FileNotFoundError") and rows["w.docx"].error.startswith("FileNotFoundError") and rows["a 2.pdf"].error is None
    listing.unpersist()


def test_stores_that_only_spark_can_open(spark, folder, monkeypatch):
    """Each converter's files are read by their endings."""
    want = {r.doc_id: r.markdown for r in convert.convert_path(spark, f"{folder}/*", mode="fast").collect() if r.markdown != ""}
    monkeypatch.setattr(files, "reachable", lambda path: False)
    asked, was = [], files.read_files
    monkeypatch.setattr(files, "read_files", lambda *a, endings=(), **k: asked.append(endings) or was(*a, endings=endings, **k))
    assert {r.doc_id: r.markdown for r in convert.convert_path(spark, f"{folder}/*", mode="fast").collect()} == want
    assert set(asked) == {(".pdf",), (".docx",), (".html", ".htm"), (".md", ".txt")}
    assert sorted(os.path.basename(r.path) for r in was(spark, f"{folder}/*", endings=(".pdf",)).select("path").collect()) == ["B.PDF", *[f"a {i}.pdf" for i in range(5)], "bad.pdf"]


def test_converters_that_want_content(spark, folder):
    own = registry.Converter("bytes", lambda ext, mime: ext == ".bin", lambda docs, options: convert.Conversion(docs.select("doc_id", F.length("content").cast("string").alias("markdown"))))
    was = dict(registry.CONVERTERS)
    registry.register(own)
    try:
        assert {os.path.basename(r.doc_id): r.markdown for r in convert.convert_path(spark, f"{folder}/*", mode="fast").collect()}["big.bin"] == str(1 << 20)
    finally:
        registry.CONVERTERS.clear()
        registry.CONVERTERS.update(was)


@pytest.mark.parametrize("glob", ["*", "a *", "[aB]*", "{w,p}.*", "t.md", "", "de*", "d?ep", "*.p[!x]f", "none*", "deep/x.txt"])
def test_listings_are_those_of_spark(spark, folder, glob):
    """But for empty files, which Spark's scan leaves out."""
    (folder / "deep/x.txt").write_text("x")
    (folder / ".hidden.txt").write_text("x")
    (folder / "_hidden.txt").write_text("x")
    (folder / "deep/deeper").mkdir()
    (folder / "deep/deeper/y.txt").write_text("y")
    for path in (f"{folder}/{glob}", f"{folder.parent}/i?/{glob}"):
        got = {(r.path, r.length) for r in files.list_files(spark, path).collect()}
        try:
            want = {(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()}
        except Exception:  # no such path
            want = set()
        assert {x for x in got if x[1]} == want
        assert any(x[0].endswith("empty.txt") for x in got) == (glob in ("*", ""))


def test_stores():
    store, name = files.store_of("file:/a b/%c.pdf")
    assert name == "/a b/%c.pdf" and files.store_of("file:///x")[1] == files.store_of("/x")[1] == "/x"
    assert not files.reachable("viewfs://store/in/x") and files.reachable("/x")


def test_streams_open_files_in_their_parser_and_leave_no_tables(spark, folder, tmp_path):
    log, base = tmp_path / "opened", spark.conf.get("spark.checkpoint.dir")
    before = {d for d, _, _ in os.walk(base)}
    query = watch(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "check"), mode="fast", opener=opener(log))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 10 and opened(log) == [x for x in accepted(folder) if x[1] != "0"]
    left = {d for d, _, _ in os.walk(base)} - before
    assert not any(re.fullmatch(r"[0-9a-f]{32}", os.path.basename(d)) for d in left)


# --- output ------------------------------------------------------------------


def tree(top):
    return sorted(os.path.relpath(os.path.join(d, n), top) for d, _, names in os.walk(top) for n in names if not n.endswith(".crc"))


def rows(spark, n):
    return spark.range(n).select(F.format_string("d%d/f%d.md", F.col("id") % 3, "id").alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))


def test_written_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "d0").mkdir()
    (out / "d0/old.png").write_bytes(b"old")
    fails = F.udf(lambda i: 1 // (70 - i), "long")
    bad = rows(spark, 100).repartition(8).withColumn("content", F.when(fails(F.decode("content", "UTF-8").cast("long")) >= -99, F.col("content")))
    with pytest.raises(Exception, match="ZeroDivision"):
        sinks.write_files(bad, str(out), spark.createDataFrame([("d0",)], "folder string"))
    assert tree(out) == ["d0/old.png"]  # neither files, nor a staging folder, and nothing emptied
    assert sinks.write_files(rows(spark, 100).repartition(8), str(out), spark.createDataFrame([("d0",)], "folder string")) == 100
    assert tree(out) == sorted(f"d{i % 3}/f{i}.md" for i in range(100)) and (out / "d1/f97.md").read_bytes() == b"97"
    assert sinks.write_files(rows(spark, 100).unionByName(rows(spark, 10)), str(out)) == 100  # again, with repeated rows: the same files
    assert len(tree(out)) == 100
    assert sinks.write_files(rows(spark, 0), str(out)) == 0


def test_sources_are_copied_by_path(spark, tmp_path):
    big = os.urandom(3_000_000)
    (tmp_path / "a b.pdf").write_bytes(big)
    files_ = spark.createDataFrame([("out/x.pdf", None, f"file:{tmp_path}/a b.pdf"), ("out/x.md", b"text", None)], "path string, content binary, source string")
    assert sinks.write_files(files_, str(tmp_path)) == 2
    assert (tmp_path / "out/x.pdf").read_bytes() == big and (tmp_path / "out/x.md").read_bytes() == b"text"


def test_command_line_roots(spark, folder, tmp_path, capsys):
    assert cli.main([f"{folder}/t.md", "-o", "res", "--root", f"file://{tmp_path}/shared"], spark) == 0
    assert capsys.readouterr().out.strip().endswith("t.md") and any(x.endswith("t.md") for x in tree(tmp_path / "shared"))
