"""Heading classification of text blocks, as column expressions.

A block has ``text`` (squeezed), ``font_size``, ``is_bold``, ``is_italic``, ``x0``, ``x1``,
``width`` and ``first_span`` (text of its first span, null with fewer than two spans).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import level_of, squeeze, strip

HAN = r"\u4e00-\u9fff"

# Titles of academic sections.
TITLES = [
    "abstract", "introduction", "background", "case study", "data", "data and methods", "method", "methods", "methodology",
    "materials and methods", "model setup", "model", "models", "model description", "modelling", "modeling", "numerical model",
    "observations", "results", "discussion", "results and discussion", "conclusion", "conclusions", "references",
    "acknowledgements", "acknowledgments", "appendix",
]
#: What has the form of a title at all (letters that are ASCII in lower case): the small letters of other texts cost more than all patterns.
TITLE_FORM = r"^[A-Za-z\x{212A} ]{1,40}+[.:]*\z"
# Words that begin a body text after a heading.
STARTERS = "The This These We In For To A An As Based Here Our Several When Where With".split()
# Words that begin a Chinese body text after a numbered heading.
HAN_STARTERS = "按照|简述|根据|基于|例[：:]|本|按|如|应|为|项目|图|表"
# Vocabulary of contact and account tables.
ENTRY_WORDS = r"地址|账号|权限|密码|管理员|平台|联系|邮箱|OA|http|www|\\\\|\.cn\b"

# Patterns that only contents or tables have; two more rules need a width or a length besides (see ``rejected``).
REJECTED = [
    r"\.{4}",
    r"^[a-z]{3,20}\z",
    r"^(?iu)(Figure|Fig\.|Table)(?U)\s+\d+",
    r"^(?iu)PAPER(?U)\s+•\s+OPEN\s+ACCESS\z",
    r"^(?U)(Citation|Received|Revised|Accepted|Published|Copyright)\b",
    r"^(?U)\d{3,}\s+",
    r"(?U)\b[NSWE]\b|°[NSEW]|XXXXX",
    r"^(?U)\d{1,2}\s+.*[。；;]\z",
    r"(?U)https?://|\\\\|/|OA\+|\.cn\b",
    r"^(?U)[A-Z]\d?\s+",
]
PAGE_NUMBER_ENDS = r"(?U)\s\d{1,3}\z"
LISTED_SENTENCE = rf"^(?U)\d+[.、]\s*[{HAN}].*[。；;]?\z"
# Forms of headings, by rule.
CHAPTER = r"^(?U)第[一二三四五六七八九十百\d]+[章节篇部分]\S*"
ATTACHMENT = r"^(?U)附件\d+[：:]\s*\S+"
ONE_NUMBER = rf"^(?U)\d{{1,2}}\s+[{HAN}A-Za-z]"
DECIMAL = r"^(?U)(\d{1,2}(?:\.\d{1,2})+)\.?\s+\S+"
NUMBERED_LATIN = r"^(?U)\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z].*"
NUMBER = r"^(?U)\d+(?:\.\d+)*\.?\s+"
SPAN_NUMBER = r"^(?U)(\d{1,2}(?:\.\d{1,2})*)\.?\s+(.{2,80})\z"
LINE_NUMBER = r"^(?dU)(\d{1,2}(?:\.\d{1,2})*\.?)\s+(.+)\z"
COMBINED = r"(?U)(?<!\S)(\d{1,2}(?:\.\d{1,2})*\.?)\s+([A-Z][A-Za-z][^0-9]{2,80}?)(?=\s+\d{1,2}(?:\.\d{1,2})*\.?\s+[A-Z]|\s*\z)"
HAN_PREFIX = rf"^(?dU)((?:\d{{1,2}}(?:\.\d{{1,2}})+)\s+.{{2,24}}?)(\s+(?:{HAN_STARTERS}).+)\z"


def rejected(text: Column, width: Column, page_width: Column) -> Column:
    """Whether a line belongs to a table of contents or a table."""
    out = (F.length(text) > 90) | ((width >= page_width * 0.68) & text.rlike(PAGE_NUMBER_ENDS))  # most lines are long: no pattern is tried on them
    for pattern in REJECTED:
        out = out | text.rlike(pattern)
    return out | (text.rlike(LISTED_SENTENCE) & (F.length(text) > 36))


def table_entry(text: Column) -> Column:
    return text.rlike(f"(?iu)(?:{ENTRY_WORDS})")


def academic_title(text: Column) -> Column:
    bare = strip(F.regexp_replace(text, NUMBER, ""))
    return bare.rlike(TITLE_FORM) & F.regexp_replace(F.lower(bare), r"[.:]+\z", "").isin(*TITLES)


def body_continues(text: Column) -> Column:
    return text.rlike(rf"^(?U)(?:{'|'.join(STARTERS)})\b") | text.rlike("^[a-z]")


def short_column_line(text: Column, x0: Column, width: Column, font_size: Column, body_size: Column, page_width: Column) -> Column:
    begins = (x0 <= page_width * 0.22) | ((x0 >= page_width * 0.42) & (x0 <= page_width * 0.64))
    return begins & (F.length(text) <= 48) & (width <= page_width * 0.42) & (font_size >= body_size - 0.2)


def heading_level(text: Column, font_size: Column, bold: Column, italic: Column, x0: Column, width: Column, body_size: Column, page_width: Column) -> Column:
    """2 to 6, or null; the first rule that fires decides."""
    styled = bold | italic
    prominent = (font_size >= body_size + 1.0) | (styled & (font_size >= body_size - 0.2))
    short = short_column_line(text, x0, width, font_size, body_size, page_width)
    number = F.regexp_extract(text, DECIMAL, 1)
    none = F.lit(None).cast("int")

    def two(ok: Column) -> Column:
        return F.when(ok, 2).otherwise(none)

    return (
        F.when(rejected(text, width, page_width), none)
        .when((font_size < body_size - 0.2) & ~prominent, none)
        .when(text.rlike(CHAPTER), two(prominent | (F.length(text) <= 32)))
        .when(text.rlike(ATTACHMENT), two(prominent & (F.length(text) <= 40)))
        .when(text.rlike(ONE_NUMBER), two(~table_entry(text) & (prominent | short)))
        .when((number != "") & (prominent | short), level_of(number))
        .when(text.rlike(NUMBERED_LATIN), two(prominent | short))
        .when(academic_title(text), two(prominent | short | styled))
        .when(bold & (font_size >= body_size + 2.0) & (F.length(text) <= 40), 2)
        .otherwise(none)
    )


def joined(level: Column, heading: Column, rest: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), heading, F.lit("\n\n"), rest)


def leading_span(text: Column, first_span: Column, width: Column, x1: Column) -> Column:
    """A heading that is the block's first span, and the text after it; else null."""
    heading = squeeze(first_span)
    rest = F.when(text.startswith(heading) & (heading != ""), F.nullif(strip(F.substring(text, F.length(heading) + 1, F.length(text))), F.lit("")))
    number, title = F.regexp_extract(heading, SPAN_NUMBER, 1), strip(F.regexp_extract(heading, SPAN_NUMBER, 2))
    numbered = (number != "") & ~rejected(heading, F.least(width, F.length(heading) * 8.0), F.greatest(x1, F.lit(1.0))) & title.rlike(f"[A-Za-z{HAN}]")
    abstract = F.lower(F.regexp_replace(heading, r"\.+\z", "")) == "abstract"
    return F.when(rest.isNotNull(), F.when(abstract, joined(F.lit(2), F.lit("Abstract"), rest)).when(numbered, joined(level_of(number), F.concat(number, F.lit(". "), title), rest)))


def numbered_prefix(text: Column) -> Column:
    """``struct<heading, rest, level>`` of a numbered academic title with body text behind it; else null."""
    number = F.regexp_replace(F.regexp_extract(text, LINE_NUMBER, 1), r"\.+\z", "")
    remainder = strip(F.regexp_extract(text, LINE_NUMBER, 2))
    titles = F.lit(sorted(TITLES, key=lambda t: (-len(t), t)))

    def rest(title: Column) -> Column:
        return F.substring(remainder, F.length(title) + 1, F.length(remainder))

    fit = F.filter(titles, lambda t: F.lower(remainder).startswith(t) & ~rest(t).rlike(r"^\p{L}") & body_continues(strip(rest(t))))
    title = F.get(fit, 0)
    heading = F.concat(number, F.lit(". "), strip(F.substring(remainder, F.lit(1), F.length(title))))
    return F.when((number != "") & title.isNotNull(), F.struct(heading.alias("heading"), strip(rest(title)).alias("rest"), level_of(number).alias("level")))


def combined_numbered(text: Column) -> Column:
    """Two or more numbered titles in one line, as headings of their own; else null."""
    whole, numbers, titles = (F.regexp_extract_all(text, F.lit(COMBINED), F.lit(i)) for i in range(3))
    bare = F.transform(numbers, lambda n: F.regexp_replace(n, r"\.+\z", ""))
    lines = F.zip_with(bare, titles, lambda n, t: F.concat(F.repeat(F.lit("#"), level_of(n)), F.lit(" "), n, F.lit(". "), strip(t)))
    return F.when((F.size(whole) >= 2) & text.startswith(F.get(whole, 0)), F.array_join(lines, "\n\n"))


def han_prefix(text: Column, level: Column) -> Column:
    """A decimal-numbered Chinese title with body text behind it; else null."""
    heading, rest = strip(F.regexp_extract(text, HAN_PREFIX, 1)), strip(F.regexp_extract(text, HAN_PREFIX, 2))
    return F.when(rest != "", joined(level, heading, rest))


def heading_markdown(raw: Column, first_span: Column, font_size: Column, bold: Column, italic: Column, x0: Column, x1: Column, width: Column, body_size: Column, page_width: Column, squeezed: bool = False) -> Column:
    """A block's text as Markdown: a heading, a heading and its body, or the text alone. Text that is ``squeezed`` already is taken as it is."""
    text = raw if squeezed else squeeze(raw)
    level = heading_level(text, font_size, bold, italic, x0, width, body_size, page_width)
    prefix = numbered_prefix(text)
    plain = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)
    return (
        F.when(text == "a b s t r a c t", "## Abstract")
        .when(text == "a r t i c l e i n f o", "## Article info")
        .otherwise(F.coalesce(leading_span(text, first_span, width, x1), joined(prefix["level"], prefix["heading"], prefix["rest"]), F.when(level.isNotNull(), F.coalesce(combined_numbered(text), han_prefix(text, level), plain)), text))
    )
