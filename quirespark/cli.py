"""``python -m quirespark.cli convert INPUT`` and ``translate INPUT``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

COMMANDS = ("convert", "translate")


def with_command(argv: list[str]) -> list[str]:
    """A bare path is converted."""
    return ["convert", *argv] if argv and argv[0] and not argv[0].startswith("-") and argv[0] not in COMMANDS else argv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quirespark")
    sub = top.add_subparsers(dest="command")
    convert = sub.add_parser("convert", help="documents to Markdown")
    convert.add_argument("input", help="a path or glob")
    convert.add_argument("-o", "--output")
    convert.add_argument("--root", help="folder or URI below which output lies; on a cluster, one that all executors share")
    convert.add_argument("--pdf-mode", choices=("academic", "fast"), default="academic")
    convert.add_argument("--pdf-formula-ocr", action=argparse.BooleanOptionalAction, default=True, help="formulas need a provider; without one they are marked")
    convert.add_argument("--assets-dir")
    convert.add_argument("--translate", action="store_true")
    convert.add_argument("--translation-service", choices=("google", "bing"), default="google")
    convert.add_argument("--progress", action="store_true")
    translate = sub.add_parser("translate", help="Markdown to another language")
    translate.add_argument("input")
    translate.add_argument("-o", "--output")
    translate.add_argument("--root", help="folder or URI below which output lies; on a cluster, one that all executors share")
    translate.add_argument("--service", choices=("google", "bing"), default="google")
    translate.add_argument("--lang-in", default="en")
    translate.add_argument("--lang-out", default="zh")
    translate.add_argument("--progress", action="store_true")
    return top


def main(argv: list[str] | None = None, spark=None, provider=None, providers=None) -> int:
    args = parser().parse_args(with_command(sys.argv[1:] if argv is None else argv))
    if not args.command:
        parser().print_help()
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.text import relative_path
    from .plans import sinks
    from .plans.convert import path_conversion
    from .plans.translate import translated
    from .providers import Providers
    from .scratch import stored
    from .sources import files

    spark = spark or SparkSession.builder.appName("quirespark").getOrCreate()
    if not args.root and not spark.sparkContext.master.startswith("local"):
        print("on a cluster, --root names the shared folder that output goes to", file=sys.stderr)
        return 2
    root = args.root if args.root and "://" in args.root else os.path.abspath(args.root or ".")
    tell(args.progress, stage="prepare")
    target = os.path.relpath(args.output, root) if args.output and os.path.isabs(args.output) else args.output
    assets = events = None
    if args.command == "convert":

        def folders(df):
            """Where a document's assets lie, from its id alone."""
            own = sinks.placed(df, target=target)
            folder = F.lit(args.assets_dir) if args.assets_dir else F.col("assets_dir")
            return own.withColumn("folder", folder).withColumn("assets", relative_path(folder, F.col("output_dir"))).drop("output", "output_dir", "stem", "assets_dir")

        chosen = providers or Providers()
        if not args.pdf_formula_ocr:
            chosen = replace(chosen, formula=None)
        made = path_conversion(spark, args.input, lambda listing: folders(listing).drop("folder"), mode=args.pdf_mode, providers=chosen)
        done, assets, events = stored(made.documents), folders(made.assets), made.events
        suffix = None
        if args.translate:
            done = stored(translated(done, provider, args.translation_service).join(done.drop("markdown"), "doc_id"))
            events = events.unionByName(done.select("doc_id", F.lit("translation").alias("stage"), F.col("blocks").alias("current"), F.col("blocks").alias("total"), (F.lit(4) * F.lit(1 << 32)).alias("seq")))
    else:
        text = stored(files.parsed_text(files.list_files(spark, args.input))).select("doc_id", F.col("text").alias("markdown"))
        done, suffix = stored(translated(text, provider, args.service, args.lang_in, args.lang_out)), f"_{args.lang_out}"
        events = done.select("doc_id", F.lit("translation").alias("stage"), F.col("blocks").alias("current"), F.col("blocks").alias("total"), F.lit(0).alias("seq"))
    placed = sinks.placed(done, target=target, suffix=suffix)
    if args.progress and events is not None:
        for row in events.orderBy("doc_id", "seq").toLocalIterator():
            tell(True, stage=row.stage, current=row.current, total=row.total)
    tell(args.progress, stage="write")
    written, emptied = sinks.markdown_files(placed).withColumn("source", F.lit(None).cast("string")), None
    if assets is not None:
        pictures = assets.select(F.concat("folder", F.lit("/"), "rel_path").alias("path"), "content", F.lit(None).cast("string").alias("source"))
        written = written.unionByName(sinks.source_copies(placed)).unionByName(pictures)
        emptied = None if args.assets_dir else placed.select("assets_dir")
    sinks.write_files(written, root, emptied)
    for row in placed.select("output").toLocalIterator():
        print(f"{root.rstrip('/')}/{row.output}")
    if "translation_error" in done.columns:
        for row in done.where("translation_error is not null").select("doc_id", "translation_error").toLocalIterator():
            print(f"{row.doc_id}: {row.translation_error}", file=sys.stderr)
    tell(args.progress, stage="done")
    return 0


def tell(on: bool, **event) -> None:
    if on:
        import json

        print("@progress " + json.dumps(event, ensure_ascii=False), file=sys.stderr, flush=True)


if __name__ == "__main__":
    sys.exit(main())
