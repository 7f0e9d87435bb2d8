"""Markdown for translation: prefixes, protected spans, chunks, line classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, squeeze, strip

FENCE = "`" * 3
# What translation leaves alone, in the order in which it is numbered.
PROTECTED = [
    r"(?s)!\[[^\]]*\]\([^)]+\)",
    r"(?s)\[[^\]]+\]\([^)]+\)",
    r"(?s)`[^`]+`",
    r"(?s)\$\$.*?\$\$",
    r"(?s)(?<!\\)\$(?!\$).*?(?<!\\)\$",
    r"(?s)<[^>]+>",
]
# Most characters of a chunk, by service.
LIMITS = {"google": 4500, "bing": 900}


def structural(line: Column) -> Column:
    s = strip(line)
    return s.startswith("<") | s.startswith("![") | s.startswith("|") | s.rlike(r"^[-*_]{3,}\z")


def translatable(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


# Fixed value: the marks that a block may begin with.
PREFIX = r"(?s)^((?U)\s*(?:#{1,6}\s+|>\s+|[-*+]\s+|\d+[.)]\s+)?)(.*)\z"


def prefix_split(text: Column) -> Column:
    """``struct<prefix, body>``: white space and the mark of a heading, quote or item; the rest."""
    return F.struct(F.regexp_extract(text, PREFIX, 1).alias("prefix"), F.regexp_extract(text, PREFIX, 2).alias("body"))


def protect(text: Column) -> Column:
    """``struct<text, spans array<struct<ph, value>>, mark>``: spans become ``{v0}``, ``{v1}`` and so on.

    Where the text has such a token of its own, the mark is one that it hasn't.
    """
    own = F.size(F.regexp_extract_all(text, F.lit(r"(?i)\{\s*v+\d+\s*\}"), F.lit(0))) > 0
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\{\s*(v+)\d+\s*\}"), F.lit(1)), lambda v: F.length(v))), F.lit(0))
    mark = F.when(own, F.repeat(F.lit("v"), longest + 1)).otherwise("v")
    state = F.struct(text.alias("text"), F.array().cast("array<struct<ph:string,value:string>>").alias("spans"))
    for pattern in PROTECTED:
        state = _numbered(state, pattern, mark)
    return F.struct(state["text"].alias("text"), state["spans"].alias("spans"), mark.alias("mark"))


def _numbered(state: Column, pattern: str, mark: Column) -> Column:
    def step(_, s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
        names = F.transform(found, lambda _, i: F.concat(F.lit("{"), mark, (F.size(s["spans"]) + i).cast("string"), F.lit("}")))
        text = F.array_join(F.zip_with(F.split(s["text"], pattern, -1), names, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), "")
        return F.struct(text.alias("text"), F.concat(s["spans"], F.zip_with(names, found, lambda n, v: F.struct(n.alias("ph"), v.alias("value")))).alias("spans"))

    # a fold over one element names the state, so that it is computed once
    return F.aggregate(F.array(state), F.struct(F.lit("").alias("text"), F.array().cast("array<struct<ph:string,value:string>>").alias("spans")), step)


def restore(text: Column, spans: Column) -> Column:
    """Spans in place of their tokens, literally and last first, in either case and with blanks inside the braces."""

    def put(acc: Column, s: Column) -> Column:
        name = F.substring(s["ph"], F.lit(2), F.length(s["ph"]) - 2)
        pattern = F.concat(F.lit(r"(?iU)\{\s*"), name, F.lit(r"\s*\}"))
        literal = F.regexp_replace(s["value"], r"([\\$])", r"\\$1")
        return F.regexp_replace(acc, pattern, literal)

    return F.aggregate(F.reverse(spans), text, put)


def chunks(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, of whole sentences where they fit."""
    flat = squeeze(text)
    parts = F.split(flat, rf"(?<=[.!?。！？]){SPACE}+")
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        joined = F.when(acc["cur"] == "", part).otherwise(F.concat(acc["cur"], F.lit(" "), part))
        size = F.length(part)
        slices = F.when(size > limit, F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / limit).cast("int") - 2, F.lit(0))), lambda i: F.substring(part, i * limit + 1, F.lit(limit)))).otherwise(empty)
        rest = F.when(size > limit, F.substring(part, F.size(slices) * limit + 1, F.lit(limit))).otherwise(part)
        flushed = F.concat(acc["ch"], F.when(acc["cur"] != "", F.array(acc["cur"])).otherwise(empty), slices)
        return F.when(F.length(joined) <= limit, F.struct(acc["ch"].alias("ch"), joined.alias("cur"))).otherwise(F.struct(flushed.alias("ch"), rest.alias("cur")))

    packed = F.aggregate(parts, F.struct(empty.alias("ch"), F.lit("").alias("cur")), step, lambda acc: F.concat(acc["ch"], F.when(acc["cur"] != "", F.array(acc["cur"])).otherwise(empty)))
    return F.when(F.length(flat) <= limit, F.array(flat)).otherwise(packed)


def text_lines(text: Column) -> Column:
    """Lines with their terminators, as Python's splitlines cuts them."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^\r\n\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85  ])|[^\r\n\x0b\x0c\x1c-\x1e\x85  ]+\z"), F.lit(0)), lambda s: s != "")


def html_subset(html: Column) -> Column:
    """Markdown of simple pages, in column functions: headings, paragraphs, items, links and breaks."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in ("script", "style", "head", "nav", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"""(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>""", "[$2]($1)")
    out = F.regexp_replace(out, r"(?is)<b\b[^>]*>(.*?)</b\s*>", "**$1**")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n* ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|article|ul|section)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+\z", "")


def python_prefix(text: str) -> tuple[str, str]:
    """The same split in Python, for providers."""
    m = re.match(r"^(\s*(?:#{1,6}\s+|>\s+|[-*+]\s+|\d+[.)]\s+)?)(.*)$", text, re.S)
    return m[1], m[2]
