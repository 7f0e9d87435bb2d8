"""Column expressions on text: white space, surrogates, LaTeX, pipe tables, stems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split knows it.
SPACE = r"(?U)[\s\x1c-\x1f]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it: a lambda's own column would be worked out each time."""
    return F.get(F.transform(F.array(value), use), 0)


def visible(text: Column) -> Column:
    """Whether anything is left of a text when it is squeezed: known at its first character that is no white space."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def sanitised(text: Column) -> Column:
    """Lone surrogates become U+FFFD; strings that come from the JVM have none left."""
    return F.regexp_replace(text, r"[\x{D800}-\x{DFFF}]", "�")


def level_of(number: Column) -> Column:
    """Heading level of a dotted number: 2 and its dots, at most 6."""
    return F.least(F.lit(2) + F.length(number) - F.length(F.replace(number, F.lit("."))), F.lit(6))


# --- LaTeX -----------------------------------------------------------------

# Symbols that the converter leaves broken, and what replaces them, in order.
SYMBOLS = [("\\m ", "\\mu "), ("\\n ", "\\nu "), ("\\ta ", "\\tau "), ("×", "\\times "), ("≤", "\\le "), ("≥", "\\ge "), ("≠", "\\ne "), ("±", "\\pm ")]


def fixed_symbols(latex: Column) -> Column:
    out = strip(latex)
    for old, new in SYMBOLS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def cleaned_latex(value: Column) -> Column:
    """Without code fence, dollar wrappers and lines of dollars alone; null if nothing is left.

    Wrappers are peeled off as many times as there are dollars at the shorter end.
    """
    text = strip(value)
    text = F.regexp_replace(text, r"^(?i)```(?:latex|tex|katex|math)?" + SPACE + "*", "")
    text = strip(F.regexp_replace(text, SPACE + r"*```\z", ""))
    dollars = F.least(F.length(F.regexp_extract(text, rf"^(?:\${SPACE}*)+", 0)), F.length(F.regexp_extract(text, rf"(?:{SPACE}*\$)+\z", 0)))

    def peel(t: Column) -> Column:
        two = t.startswith("$$") & t.endswith("$$")
        one = t.startswith("$") & t.endswith("$")
        size = F.length(t)
        return F.when(two, strip(F.substring(t, F.lit(3), F.greatest(size - 4, F.lit(0))))).when(one, strip(F.substring(t, F.lit(2), F.greatest(size - 2, F.lit(0))))).otherwise(t)

    text = F.when(dollars > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(dollars, F.lit(1))), text, lambda t, _: peel(t))).otherwise(text)
    lines = F.filter(F.split(text, r"\R"), lambda line: ~strip(line).isin("$", "$$"))
    return F.nullif(strip(F.array_join(lines, "\n")), F.lit(""))


def unescaped_math(markdown: Column) -> Column:
    """Inside dollars, backslashes before Markdown's signs go; an unclosed formula stays as it is."""
    pattern = r"\$\$[\s\S]*?\$\$|\$\$[\s\S]*\z|\$[^$]*\$"
    found = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(0))
    closed = lambda m: ~(m.startswith("$$") & ~((F.length(m) >= 4) & m.endswith("$$")))
    inner = F.transform(found, lambda m: F.when(closed(m), F.regexp_replace(m, r"\\([*_{}\[\]()#+\-.!])", "$1")).otherwise(m))
    outer = F.split(markdown, pattern, -1)
    return F.array_join(F.zip_with(outer, inner, lambda o, i: F.concat(o, F.coalesce(i, F.lit("")))), "")


# --- tables ----------------------------------------------------------------


def table_cell(value: Column) -> Column:
    return F.replace(squeeze(F.coalesce(value, F.lit(""))), F.lit("|"), F.lit("\\|"))


def pipe_table(rows: Column) -> Column:
    """Rows of nullable cells as a Markdown table: blank rows go, short ones are filled, the first is the head."""
    cells = F.transform(rows, lambda row: F.transform(row, table_cell))
    full = F.filter(cells, lambda row: F.exists(row, lambda c: c != ""))

    def shown(full: Column, width: Column) -> Column:
        drawn = F.transform(full, lambda row: F.concat(F.lit("| "), F.array_join(F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return bound(drawn, lambda d: F.array_join(F.concat(F.slice(d, 1, 1), F.array(rule), F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0)))), "\n"))

    return bound(full, lambda f: F.when(F.size(f) > 0, bound(F.array_max(F.transform(f, F.size)), lambda width: shown(f, width))).otherwise(""))


def style_line(style: Column, level: Column) -> Column:
    """A line of a style map, for heading levels from 0; body text (9 and more) and contents styles have none."""
    name = F.replace(F.replace(style, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    ok = (F.coalesce(style, F.lit("")) != "") & ~F.lower(style).startswith("toc") & level.between(0, 8)
    return F.when(ok, F.concat(F.lit("p[style-name='"), name, F.lit("'] => h"), F.least(level + 1, F.lit(6)).cast("string"), F.lit(":fresh")))


def has_merged_cells(html: Column) -> Column:
    spans = F.regexp_extract_all(html, F.lit(r"""(?i)<t[dh]\b[^>]*?\b(?:rowspan|colspan)\s*=\s*["']?\s*(\d+)"""), F.lit(1))
    return F.exists(spans, lambda s: F.coalesce(s.try_cast("int"), F.lit(1)) > 1)


def merged_table_slots(html: Column, slot: str = "MERGEDTABLESLOT") -> tuple[Column, Column]:
    """HTML with a marker paragraph for each table that has merged cells; and ``array<struct<slot, html>>``.

    Numbers count all tables. Tables are taken without tables inside them.
    """
    pattern = r"(?is)<table\b(?:(?!<table\b).)*?</table>"
    tables = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    outer = F.split(html, pattern, -1)
    name = lambda i: F.concat(F.lit(slot), F.lpad((i + 1).cast("string"), 4, "0"))
    shown = F.transform(tables, lambda t, i: F.when(has_merged_cells(t), F.concat(F.lit("<p>"), name(i), F.lit("</p>"))).otherwise(t))
    kept = F.filter(F.transform(tables, lambda t, i: F.struct(name(i).alias("slot"), t.alias("html"), has_merged_cells(t).alias("merged"))), lambda s: s["merged"])
    pairs = F.transform(kept, lambda s: F.struct(s["slot"].alias("slot"), s["html"].alias("html")))
    return F.array_join(F.zip_with(outer, shown, lambda o, t: F.concat(o, F.coalesce(t, F.lit("")))), ""), pairs


def refilled(markdown: Column, pairs: Column) -> Column:
    return F.aggregate(pairs, markdown, lambda text, p: F.replace(text, p["slot"], p["html"]))


# --- names of outputs ------------------------------------------------------

CHARS, BYTES = 72, 120


def fits(value: Column, chars: int, size: int) -> Column:
    return (F.length(value) <= chars) & (F.octet_length(value) <= size)


def cut(value: Column, chars: int, size: int) -> Column:
    """The longest beginning within both limits, in whole characters."""
    taken = F.aggregate(
        F.split(F.substring(value, 1, chars), ""),
        F.struct(F.lit("").alias("out"), F.lit(False).alias("full")),
        lambda acc, c: F.when(acc["full"] | (F.octet_length(F.concat(acc["out"], c)) > size), F.struct(acc["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), F.lit(False).alias("full"))),
    )
    return taken["out"]


def plain_stem(stem: Column) -> Column:
    """Without white space, signs that paths forbid, and one hash at the end."""
    s = F.regexp_replace(strip(stem), SPACE + "+", "_")
    s = F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1f]+', "_")
    s = F.regexp_replace(s, r"(?i)[_-]?(?:[0-9a-f]{12,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\z", "")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), r"^[._\- ]+|[._\- ]+\z", "")
    return F.when(s == "", "output").otherwise(s)


def short_stem(stem: Column) -> Column:
    """A stem of at most ``CHARS`` characters and ``BYTES`` bytes; long ones end with a digest."""
    s = plain_stem(stem)
    chars, size = CHARS - 9, BYTES - 9
    tokens = F.filter(F.split(s, r"[_\-—–（）()\[\]【】,，、]+"), lambda t: t != "")
    packed = F.aggregate(
        tokens,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("full")),
        lambda acc, t: F.when(
            ~acc["full"] & fits(F.when(acc["out"] == "", t).otherwise(F.concat_ws("_", acc["out"], t)), chars, size), F.struct(F.when(acc["out"] == "", t).otherwise(F.concat_ws("_", acc["out"], t)).alias("out"), F.lit(False).alias("full"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.lit(True).alias("full"))),
    )["out"]
    short = F.when(packed != "", packed).otherwise(F.regexp_replace(cut(s, chars, size), r"[._\- ]+\z", ""))
    return F.when(fits(s, CHARS, BYTES), s).otherwise(F.concat(short, F.lit("-"), F.substring(F.sha1(s.cast("binary")), 1, 8)))


def output_layout(source: Column, target: Column, suffix: Column | None = None) -> Column:
    """``struct<output, output_dir, stem, assets_dir>`` of a source path and an optional target."""
    name = F.regexp_extract(source, r"([^/]*)/*\z", 1)
    bare = F.when(F.regexp_extract(name, r"^(.+)\.[^.]+\z", 1) != "", F.regexp_extract(name, r"^(.+)\.[^.]+\z", 1)).otherwise(name)
    bare = F.when(bare == "", "output").otherwise(bare)
    stem = short_stem(F.concat(bare, F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit("")))
    file = F.lower(target).endswith(".md")
    folder = F.regexp_replace(F.coalesce(target, F.lit("output")), r"/+\z", "")
    last = F.regexp_extract(folder, r"([^/]*)\z", 1)
    parent = F.regexp_extract(target, r"^(.*)/[^/]*\z", 1)
    out_dir = F.when(file, F.when(parent == "", ".").otherwise(parent)).when(target.isNotNull() & (last == stem), folder).otherwise(F.concat_ws("/", folder, stem))
    own = F.when(file, short_stem(F.regexp_extract(target, r"([^/]*)\.[mM][dD]\z", 1))).otherwise(stem)
    output = F.when(file, target).otherwise(F.concat(out_dir, F.lit("/"), own, F.lit(".md")))
    assets = F.when(out_dir == ".", F.concat(own, F.lit("_assets"))).otherwise(F.concat(out_dir, F.lit("/"), own, F.lit("_assets")))
    return F.struct(output.alias("output"), out_dir.alias("output_dir"), own.alias("stem"), assets.alias("assets_dir"))


def relative_path(path: Column, base: Column) -> Column:
    """POSIX path below ``base``; unchanged where it isn't below it."""
    prefix = F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/"))
    return F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
