"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the whole text in lower
case; a feature weighs (1 + log count) times its inverse document frequency, and a
text's vector has length 1. Document frequencies and the numbers of rows for each
language are counted over every row that may be learnt from. The weights are fitted
by follow-the-regularised-leader steps with an elastic-net penalty (its L1 part
leaves most of them 0) on a bounded sample of those rows: in expectation at most
``PER_LANGUAGE`` of each language, drawn by a hash of the id. A fifth of the sample
is kept out of the fit and gives the temperature that calibrates the scores.

Edge cases. A null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing can be learnt. Rows with a null language are predicted but
not learnt from; a null id counts as the empty text. More than ``LANGUAGES`` languages are refused. Repeated rows have equal results.
Language, source and id are no inputs of a prediction. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emit, give_back, records, tidy

#: Buckets of hashed n-grams; rows of each language in the sample (in expectation, at most); passes over it.
BUCKETS, PER_LANGUAGE, EPOCHS = 1 << 14, 1000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Languages that a model may have: its weights are dense, 128 kB for each.
LANGUAGES = 1000
UNKNOWN = "und"
#: Characters of a text that are counted at a time; the counts are those of the whole text.
SLICE = 1 << 20

_word = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _word.finditer(text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the text, ascending, and how often."""
    total = np.zeros(BUCKETS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(points), SLICE):
            part = points[at : at + SLICE + 2]  # n-grams that begin in this slice
            gram = part * np.uint32(0x9E3779B1)
            for n in (1, 2, 3):
                if n > 1:
                    gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[n - 1 :] * np.uint32(0x9E3779B1)
                total += np.bincount((gram[:SLICE] ^ (gram[:SLICE] >> np.uint32(16))) * np.uint32(0xC2B2AE35) >> np.uint32(18), minlength=BUCKETS)
    there = np.flatnonzero(total)
    return there, total[there]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, number = counts(text)
    value = (1 + np.log(number)) * idf[at]
    norm = float(np.sqrt((value * value).sum()))
    return at, value / norm if norm else value


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, value = vector(text, self.idf)
        p = softmax((self.weights[:, at] @ value + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, a row at a time; returns weights and biases."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(at):
        part = z[:, at]
        return np.where(np.abs(part) <= L1, 0.0, -(part - np.sign(part) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, at, value = rows[i]
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            p = softmax(w @ value)
            p[label] -= 1
            g = p[:, None] * value
            was = n[:, at]
            now = was + g * g
            z[:, at] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[:, at] = now
    w = weights(np.arange(BUCKETS + 1))
    return w[:, :-1], w[:, -1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fixed grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 120))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits a model on the rows that are not held out and have a language."""
    learnt = df.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("key"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), {}
        for lang, text in records(batches):
            total[counts(text)[0]] += 1
            rows[lang] = rows.get(lang, 0) + 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.nulls(len(rows), pa.int64()), pa.array(list(rows.values()), pa.int64())], names=["lang", "bucket", "n"])

    found = learnt.select("lang", "text").mapInArrow(tidy(document_frequencies), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    by_language = {r.lang: r.n for r in found if r.lang is not None}
    languages, whole = sorted(by_language), sum(by_language.values())
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} values of {lang_col}; a model has {LANGUAGES} languages at most")
    df_counts = np.zeros(BUCKETS)
    for r in found:
        if r.bucket is not None:
            df_counts[r.bucket] = r.n
    idf = np.log((1 + whole) / (1 + df_counts)) + 1
    if not languages:
        return Model([], idf, np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, PER_LANGUAGE / by_language[lang])))])
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.coalesce("key", F.lit(""))), 33) / F.lit(float(1 << 31))
    schema = pa.schema([("lang", pa.string()), ("key", pa.string()), ("at", pa.list_(pa.int32())), ("number", pa.list_(pa.int32()))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for lang, key, text in records(batches):
                at, number = counts(text)
                yield lang, key, at.astype(np.int32), np.minimum(number, 1 << 30).astype(np.int32)

        yield from emit(rows(), schema, lambda row: 8 * len(row[2]))

    sample = learnt.where(place < F.element_at(share, F.col("lang"))).select("lang", "key", "text").mapInArrow(tidy(vectors), "lang string, key string, at array<int>, number array<int>").toArrow()
    rows = []
    order = sorted(zip(sample["key"].to_pylist(), sample["lang"].to_pylist(), range(sample.num_rows), strict=True), key=lambda r: (r[0] or "", r[1]))
    for _, lang, i in order:
        at = sample["at"][i].values.to_numpy().astype(np.int64)
        value = (1 + np.log(sample["number"][i].values.to_numpy())) * idf[at]
        norm = float(np.sqrt((value * value).sum()))
        rows.append((languages.index(lang), at.astype(np.int32), value / norm if norm else value))
    kept, calibration = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    weights, bias = fit(kept or rows, len(languages))
    logits = np.array([weights[:, at] @ value + bias for _, at, value in calibration]).reshape(-1, len(languages))
    labels = np.array([r[0] for r in calibration], int)
    del sample, order, rows, kept, calibration
    give_back()  # the driver's too: the sample is the largest that it holds
    return Model(languages, idf, weights, bias, temperature(logits, labels))


def prediction(model: Model, text_col: Column, spark) -> Column:
    """``struct<lang_pred, score>`` of a text column. The model is broadcast: its size is languages times ``BUCKETS``."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        try:
            for batch in texts:
                found = [own.predict(t.as_py()) for t in batch]
                yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])
        finally:
            give_back()

    return F.arrow_udf(run, "lang_pred string, score double")(text_col)


def predicted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` of every row, by a model learnt from ``df``."""
    model = train(df, id_col, text_col, lang_col)
    rows = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), prediction(model, F.col(text_col), df.sparkSession).alias("found"))
    return rows.select(id_col, "held_out", "found.lang_pred", "found.score")


def accepted(df: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language can be told: not ``und``, and with a score of ``least`` or more."""
    model = train(df, id_col, text_col, lang_col)
    found = df.withColumn("__quire_found", prediction(model, F.col(text_col), df.sparkSession))
    return found.where((F.col("__quire_found.lang_pred") != UNKNOWN) & (F.col("__quire_found.score") >= least)).select(*[F.col(f"`{c}`") for c in df.columns])
