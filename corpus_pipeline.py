"""From raw documents to token ids, in five stages.

1. Language ID drops documents whose language can't be told.
2. Line dedup takes out lines that an equal line of any length, or a near line, stands before.
3. The n-gram Jaccard join (five words, 0.8) keeps one document of each group.
4. Mixing repeats or drops documents so that sources meet their target weights.
5. Byte-level BPE encodes every text that is left and decodes it again.

Each stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept. All but the
last return the columns of ``docs``, whichever they are.

Edge cases, by stage (the operators' docstrings have the rest). Null and empty texts, and those without a letter, go in
stage 1. A text whose lines all go becomes empty in stage 2, stays in stage 3 (a text without words links with
nothing) and is taken 0 times in stage 4. Repeated rows (equal id and text) are one document in stages 2 and 3, and
one of them stays; rows with equal ids and other texts are documents of their own, in order of a hash of the
text. A null id stands before all others in stage 2 and after them in stage 3. Texts are taken whole, however long.
An empty table gives empty tables. Columns with other names are carried along, or dropped by the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import bpe, jaccard, langid, lines, mixing
from quirespark.llm.common import deleted, documents, python_path, scratch, stored
from quirespark.llm.queries import tokenizer
from quirespark.scratch import recorded

#: Language ID, line dedup and mixing have stages that a model or a cut decides: no SQL.
ORACLE_SQL = None


_kept: dict[str, dict[int, list[str]]] = {}


def numbered(number: int) -> Callable:
    """A stage of the pipeline, before which the tables that earlier ones of its run stored for themselves go: what they returned has been
    written by then. Tables that ``docs`` still reads stay, and so do those of runs over other inputs: a run is known by its ``sf_dir``.
    """

    def wrap(stage: Callable) -> Callable:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            own = _kept.setdefault(sf_dir, {})
            earlier = [path for k, paths in own.items() if k < number for path in paths]
            read = docs.inputFiles() if earlier else []
            free = [path for path in earlier if not any(path.split(":", 1)[-1].lstrip("/") in name for name in read)]
            deleted(spark, free)
            for k, paths in own.items():
                own[k] = [path for path in paths if path not in free]
            with recorded() as made:
                out = stage(spark, docs, sf_dir)
            own[number] = own.get(number, []) + made
            return out

        return run

    return wrap


@numbered(1)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the model that is learnt from them can tell."""
    python_path(spark)
    return langid.accepted(docs)


@numbered(2)
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an equal or near line stands before."""
    return lines.deduplicated(docs, lines.GROWING, short=True)


@numbered(3)
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    python_path(spark)
    return jaccard.one_of_each(docs, contract=jaccard.NEAR)


@numbered(4)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: 0, 1 or 2 times."""
    return mixing.mixed_rows(docs)


@numbered(5)
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` of every document."""
    import public_tokenizers

    python_path(spark)
    ranks = bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has stored goes once its result is stored, and that once the next one's is."""
    docs, last = documents(spark, sf_dir), []
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir))
            kept = made.pop()
        deleted(spark, last)
        last = [kept]
    return docs
