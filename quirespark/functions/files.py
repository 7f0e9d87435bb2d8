"""Column expressions on files: acceptance, dispatch, media types, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PDF_MIME = ("application/pdf", "application/x-pdf")
DOCX_MIME = ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)
# Image types and their endings; the first four can be shown as they are.
SHOWN = {"image/gif": ".gif", "image/jpeg": ".jpg", "image/png": ".png", "image/svg+xml": ".svg"}
OTHERS = {"image/tiff": ".tiff", "image/x-emf": ".emf", "image/x-wmf": ".wmf"}


def _accepts(ext: Column, mime: Column, ending: str, mimes: tuple[str, ...]) -> Column:
    out = F.lower(F.coalesce(ext, F.lit(""))) == ending
    for m in mimes:
        out = out | F.lower(F.coalesce(mime, F.lit(""))).startswith(m)
    return out


def accepts_pdf(ext: Column, mime: Column) -> Column:
    return _accepts(ext, mime, ".pdf", PDF_MIME)


def accepts_docx(ext: Column, mime: Column) -> Column:
    return _accepts(ext, mime, ".docx", DOCX_MIME)


def converter(ext: Column, mime: Column) -> Column:
    """Which converter takes a file: the special ones come before the general."""
    text = F.lower(F.coalesce(ext, F.lit("")))
    return F.when(accepts_pdf(ext, mime), "pdf").when(accepts_docx(ext, mime), "docx").when(text.isin(".html", ".htm"), "html").when(text.isin(".md", ".txt"), "text")


def image_extension(mime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (SHOWN | OTHERS).items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(mime)), F.lit(".bin"))


def image_asset(number: Column, mime: Column) -> Column:
    """``struct<saved, shown>``: the file that keeps an image's bytes, and the one that Markdown shows."""
    stem = F.format_string("image-%04d", number)
    ext = image_extension(mime)
    saved = F.concat(stem, ext)
    shown = F.when(F.lower(mime).isin(*SHOWN), saved).otherwise(F.concat(stem, F.lit(".png")))
    return F.struct(saved.alias("saved"), shown.alias("shown"))


def used_resources(page: Column, stream: Column) -> Column:
    """Graphics-state names that a form's stream uses and its page knows, as ``array<struct<name, ref>>`` in order of name."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(stream, F.lit(r"/(GS\w+)\s+gs"), F.lit(1))))
    known = F.transform(F.regexp_extract_all(page, F.lit(r"/GS\w+\s+\d+\s+0\s+R"), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, r"/(GS\w+)", 1).alias("name"), F.regexp_extract(s, r"(\d+\s+0\s+R)", 1).alias("ref")))
    return F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), F.get(F.reverse(F.filter(known, lambda k: k["name"] == n)), 0)["ref"].alias("ref"))), lambda s: s["ref"].isNotNull())


def with_resources(obj: Column, states: Column) -> Column:
    """A form's dictionary with the graphics states put into its resources."""
    entry = F.concat(F.lit("/ExtGState << "), F.array_join(F.transform(states, lambda s: F.concat(F.lit("/"), s["name"], F.lit(" "), s["ref"])), " "), F.lit(" >>"))
    empty = r"(?s)^(.*?)/Resources\s*<<\s*>>(.*)\z"
    filled = r"(?s)^(.*?/Resources <<)(.*)\z"
    return (
        F.when(F.size(states) == 0, obj)
        .when(obj.rlike(empty), F.concat(F.regexp_extract(obj, empty, 1), F.lit("/Resources << "), entry, F.lit(" >>"), F.regexp_extract(obj, empty, 2)))
        .when(obj.contains("/Resources <<") & ~obj.contains("/ExtGState"), F.concat(F.regexp_extract(obj, filled, 1), F.lit(" "), entry, F.lit(" "), F.regexp_extract(obj, filled, 2)))
        .otherwise(obj)
    )


# Where each stage begins on a scale from 0 to 1, and how much of it it covers.
STAGES = {"prepare": (0.03, 0.0), "pages": (0.05, 0.75), "docx": (0.05, 0.35), "images": (0.40, 0.35), "translation": (0.05, 0.85), "markdown": (0.88, 0.0), "write": (0.95, 0.0), "done": (1.0, 0.0)}


def stage_progress(stage: Column, current: Column, total: Column) -> Column:
    share = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), current / total))).otherwise(0.0)
    out = None
    for name, (start, width) in STAGES.items():
        value = F.lit(start) + F.lit(width) * F.coalesce(share, F.lit(0.0))
        out = F.when(stage == name, value) if out is None else out.when(stage == name, value)
    return out.otherwise(0.0)


def progress_line(prefix: str, *fields: str) -> Column:
    """An event as a line of its own; null fields are left out and no sign is escaped that needn't be."""
    return F.concat(F.lit(prefix), F.to_json(F.struct(*fields)))
