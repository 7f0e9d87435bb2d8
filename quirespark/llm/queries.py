"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, debruijn, decontaminate, fim, fingerprints, guesscost, jaccard, langid, lines, media, mixing, tokenfiles
from .common import documents, python_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(documents(spark, sf_dir))


def op2_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(documents(spark, sf_dir))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removal_digests(debruijn.without_repeats(documents(spark, sf_dir)))


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, sf_dir))


def op5_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guesscost.span_digests(guesscost.scan(documents(spark, sf_dir)))


def op6_shingle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.document_groups(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(documents(spark, sf_dir))


def op8_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digests(documents(spark, sf_dir), _text(tokenizer("word_bpe_49k.json")), 2)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN))


def op11_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.hit_digests(decontaminate.scanned(documents(spark, sf_dir).select("doc_id", "text"), benchmark))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    with open(model, "rb") as f:
        pieces = f.read()
    size = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    return alignment.alignment_digests(documents(spark, sf_dir), _text(tokenizer("byte_bpe_50k.json")), pieces, size)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.form_digests(fim.transformed(documents(spark, sf_dir)))


QUERIES = {
    "op1_edit_fingerprints": op1_edit_fingerprints,
    "op2_media_archives": op2_media_archives,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_fair_mix": op4_fair_mix,
    "op5_guess_cost_secrets": op5_guess_cost_secrets,
    "op6_shingle_groups": op6_shingle_groups,
    "op7_language": op7_language,
    "op8_near_lines": op8_near_lines,
    "op9_token_files": op9_token_files,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_benchmark_hits": op11_benchmark_hits,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}
#: The same in DuckDB's SQL, over all rows; the other queries depend on hashes, models, files or tokenizers.
ORACLES: dict[str, str] = {
    "op3_repeated_passages": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i+19], ' ') END AS gram FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
d AS (SELECT *, gram IS NOT NULL AND row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT *, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 19, false) AS gone FROM d),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op6_shingle_groups": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op8_near_lines": r"""
WITH l AS (SELECT doc_id, i - 1 AS ln, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i)),
f AS (SELECT line, min({'d': doc_id, 'a': ln}) AS pos FROM l WHERE length(line) >= 20 GROUP BY line),
near AS (SELECT a.line FROM f a JOIN f b ON left(a.line, 9) = left(b.line, 9) AND a.pos > b.pos AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1
  UNION SELECT a.line FROM f a JOIN f b ON right(a.line, 9) = right(b.line, 9) AND a.pos > b.pos AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
g AS (SELECT l.*, f.line IS NOT NULL AND ({'d': doc_id, 'a': ln} > f.pos OR near.line IS NOT NULL) AS gone FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)""",
    "op11_benchmark_hits": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') AS gram FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
p AS (SELECT doc_id, i, s.n, array_to_string(ws[i:i+s.n-1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM g) s, unnest(range(1, len(ws) + 1)) AS t(i) WHERE i + s.n - 1 <= len(ws)),
h AS (SELECT DISTINCT doc_id, i, p.n, item FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
w AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h), unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, w.n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN w USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, sha256('42:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (SELECT *, len(ts)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
f AS (SELECT *, array_to_string(ts[1:a], '') AS p, array_to_string(ts[a+1:b], '') AS m, array_to_string(ts[b+1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
}


def registered() -> dict:
    """Each query, after it has made sure that executors find this package."""

    def bound(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            python_path(spark)
            return query(spark, sf_dir)

        return run

    return {name: bound(query) for name, query in QUERIES.items()}
