"""Word packages with the standard library: parts, styles, mathematics, tables, images, as HTML and tables."""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree as X

from ..functions.files import OTHERS, SHOWN
from ..functions.text import SYMBOLS
from . import tiff

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
O = "{urn:schemas-microsoft-com:office:office}"
V = "{urn:schemas-microsoft-com:vml}"
C = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
MIME = {ending: mime for mime, ending in (SHOWN | OTHERS).items()} | {".jpeg": "image/jpeg", ".tif": "image/tiff"}


def parts(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}


def count_images(names) -> int:
    return sum(n.startswith("word/media/") and not n.endswith("/") for n in names)


def _level(element) -> str | None:
    found = element.find(f"{W}pPr/{W}outlineLvl")
    return None if found is None else found.get(f"{W}val")


def style_rows(found: dict[str, bytes]) -> tuple[list[tuple[str, str]], list[tuple[str, str, int]]]:
    """``(style_id, name)`` of paragraph styles, and ``(style_id, level, order)`` of outline levels set in styles or paragraphs."""
    names, levels = [], []
    try:
        styles, document = X.fromstring(found["word/styles.xml"]), X.fromstring(found["word/document.xml"])
    except (KeyError, X.ParseError):
        return [], []
    for s in styles.iter(f"{W}style"):
        key = s.get(f"{W}styleId")
        if s.get(f"{W}type") != "paragraph" or not key:
            continue
        name = s.find(f"{W}name")
        names.append((key, "" if name is None else name.get(f"{W}val") or ""))
        if (level := _level(s)) is not None:
            levels.append((key, level, len(levels)))
    for p in document.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        if style is not None and (level := _level(p)) is not None:
            levels.append((style.get(f"{W}val"), level, len(levels)))
    return names, levels


STYLE_RULE = re.compile(r"\s*p\[style-name='((?:\\.|[^'\\])*)'\]\s*=>\s*(?:h([1-6])|p)(?::fresh)?\s*\Z")


def styled(style_map: str | None) -> dict[str, int | None]:
    """Paragraph style names, in lower case, to their heading: the first line that names a style counts. Other lines have no effect."""
    out: dict[str, int | None] = {}
    for line in (style_map or "").splitlines():
        if m := STYLE_RULE.match(line):
            out.setdefault(re.sub(r"\\(.)", r"\1", m[1]).lower(), int(m[2]) if m[2] else None)
    return out


def heading_levels(found: dict[str, bytes], style_map: str | None = None) -> dict[str, int]:
    """Style id -> heading 1 to 6; body text and contents styles have none. A package's outline levels come before ``style_map``."""
    names, levels = style_rows(found)
    chosen = styled(style_map)
    named, least = dict(names), {}
    for key, level, _ in levels:
        if level.isdecimal():
            least[key] = min(least.get(key, 99), int(level))
    own = {k: v for k, v in least.items() if v <= 8 and named.get(k) and not named[k].lower().startswith("toc")}
    plain = set()
    for key, name in named.items():
        if key not in own and name.lower() in chosen:
            level = chosen[name.lower()]
            if level is None:
                plain.add(key)
            else:
                own[key] = level - 1
    for key, name in named.items():  # the built-in headings need no outline level
        if name.lower().startswith("heading ") and name[8:].isdecimal() and key not in plain:
            own.setdefault(key, int(name[8:]) - 1)
    return {k: min(v + 1, 6) for k, v in own.items()}


# --- mathematics -----------------------------------------------------------

# Operators with limits, accents, and signs over or under a group.
NARY = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap"}
ACCENTS = {"̂": "\\hat", "̃": "\\tilde", "̅": "\\bar", "̇": "\\dot", "̈": "\\ddot", "⃗": "\\vec"}
LIMITS = ("lim", "max", "min", "sup", "inf")
GROUPS = {"⏟": "\\underbrace", "⏞": "\\overbrace", "→": "\\overrightarrow", "←": "\\overleftarrow"}


def latex(node) -> str:
    """LaTeX of an ``oMath`` tree: runs, fractions, scripts, roots, n-ary operators, delimiters, accents and functions."""

    def part(e, name):
        found = e.find(M + name)
        return "" if found is None else inner(found)

    def inner(e):
        return "".join(map(one, e))

    def value(e, path, default):
        found = e.find("/".join(M + p for p in path))
        return default if found is None else found.get(f"{M}val", default)

    def one(e):
        tag = e.tag.removeprefix(M)
        if tag == "r":
            return "".join(t.text or "" for t in e.iter(f"{M}t"))
        if tag == "f":
            return f"\\frac{{{part(e, 'num')}}}{{{part(e, 'den')}}}"
        if tag == "sSup":
            return f"{{{part(e, 'e')}}}^{{{part(e, 'sup')}}}"
        if tag == "sSub":
            return f"{{{part(e, 'e')}}}_{{{part(e, 'sub')}}}"
        if tag == "sSubSup":
            return f"{{{part(e, 'e')}}}_{{{part(e, 'sub')}}}^{{{part(e, 'sup')}}}"
        if tag == "rad":
            degree = part(e, "deg")
            return f"\\sqrt[{degree}]{{{part(e, 'e')}}}" if degree else f"\\sqrt{{{part(e, 'e')}}}"
        if tag == "nary":
            sign = value(e, ("naryPr", "chr"), "∫")
            low, high = part(e, "sub"), part(e, "sup")
            return NARY.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{part(e, 'e')}}}"
        if tag == "d":
            a, b = value(e, ("dPr", "begChr"), "("), value(e, ("dPr", "endChr"), ")")
            return f"\\left{a or '.'}{','.join(inner(x) for x in e.findall(M + 'e'))}\\right{b or '.'}"
        if tag == "acc":
            return f"{ACCENTS.get(value(e, ('accPr', 'chr'), chr(0x302)), chr(92) + 'hat')}{{{part(e, 'e')}}}"
        if tag == "groupChr":
            return f"{GROUPS.get(value(e, ('groupChrPr', 'chr'), '⏟'), chr(92) + 'underbrace')}{{{part(e, 'e')}}}"
        if tag in ("limLow", "limUpp"):
            base, limit = part(e, "e"), part(e, "lim")
            sign = "_" if tag == "limLow" else "^"
            return f"\\{base.strip()}{sign}{{{limit}}}" if base.strip() in LIMITS else f"{chr(92)}{'under' if sign == '_' else 'over'}set{{{limit}}}{{{base}}}"
        if tag == "eqArr":
            return "\\begin{array}{c}" + " \\\\ ".join(inner(x) for x in e.findall(M + "e")) + "\\end{array}"
        if tag == "sPre":
            return f"{{}}_{{{part(e, 'sub')}}}^{{{part(e, 'sup')}}}{{{part(e, 'e')}}}"
        if tag == "bar":
            return f"\\overline{{{part(e, 'e')}}}"
        if tag == "func":
            return f"\\{part(e, 'fName').strip()}{{{part(e, 'e')}}}"
        if tag == "m":
            return "\\begin{matrix}" + " \\\\ ".join(" & ".join(inner(x) for x in row.findall(M + "e")) for row in e.findall(M + "mr")) + "\\end{matrix}"
        return "" if tag.endswith("Pr") else inner(e)

    out = inner(node).strip() or "".join(t.text or "" for t in node.iter(f"{M}t"))
    for old, new in SYMBOLS:
        out = out.replace(old, new)
    return out


# --- numbering -------------------------------------------------------------


def list_kinds(found: dict[str, bytes]) -> dict[tuple[str, int], str]:
    """``(number id, level)`` -> ``ul`` or ``ol``."""
    if "word/numbering.xml" not in found:
        return {}
    try:
        root = X.fromstring(found["word/numbering.xml"])
    except X.ParseError:
        return {}
    kinds: dict[str, dict[int, str]] = {}
    for a in root.iter(f"{W}abstractNum"):
        own = kinds.setdefault(a.get(f"{W}abstractNumId") or "", {})
        for level in a.iter(f"{W}lvl"):
            shape = level.find(f"{W}numFmt")
            at = level.get(f"{W}ilvl") or "0"
            if at.isdecimal():
                own[int(at)] = "ul" if shape is not None and shape.get(f"{W}val") in ("bullet", "none") else "ol"
    out = {}
    for n in root.iter(f"{W}num"):
        ref = n.find(f"{W}abstractNumId")
        for at, kind in kinds.get("" if ref is None else ref.get(f"{W}val") or "", {}).items():
            out[n.get(f"{W}numId") or "", at] = kind
    return out


def nested_lists(items: list[tuple[int, str, str]]) -> str:
    """``(level, ul or ol, content)`` of paragraphs that follow one another, as lists in lists."""
    out, open_lists = "", []
    for level, kind, text in items:
        while open_lists and len(open_lists) > level + 1:
            out += f"</li></{open_lists.pop()}>"
        if len(open_lists) == level + 1:
            if open_lists[-1] == kind:
                out += "</li>"
            else:
                out += f"</li></{open_lists.pop()}>"
        while len(open_lists) < level + 1:
            out += f"<{kind}>" + ("<li>" if len(open_lists) < level else "")
            open_lists.append(kind)
        out += f"<li>{text}"
    while open_lists:
        out += f"</li></{open_lists.pop()}>"
    return out


def placeholder(width: int = 1000, height: int = 300) -> bytes:
    """A white picture with a grey frame, in place of one that can't be shown."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    edge, row = b"\0" + b"\xa0" * width, b"\0\xa0" + b"\xff" * (width - 2) + b"\xa0"
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(edge + row * (height - 2) + edge)) + chunk(b"IEND", b"")


# --- document --------------------------------------------------------------


def to_html(content: bytes, folder: str | None = None, style_map: str | None = None) -> tuple[str, list[tuple[str, str, bytes]], str | None]:
    """A package as HTML, its images ``(name, mime, bytes)`` in order of reference, and its title.

    Links to images begin with ``folder``. Footnotes and endnotes stand at the end, and are linked both ways.
    """
    found = parts(content)
    headings = heading_levels(found, style_map)
    kinds = list_kinds(found)
    list_styles = _list_styles(found)
    document = X.fromstring(found["word/document.xml"])
    targets = {}
    if "word/_rels/document.xml.rels" in found:
        for r in X.fromstring(found["word/_rels/document.xml.rels"]):
            targets[r.get("Id")] = r.get("Target", "")
    images: list[tuple[str, str, bytes]] = []
    seen = 0
    title = None
    if "docProps/core.xml" in found:
        t = X.fromstring(found["docProps/core.xml"]).find("{http://purl.org/dc/elements/1.1/}title")
        title = None if t is None else t.text

    notes: dict[str, dict[str, X.Element]] = {}
    for kind in ("footnote", "endnote"):
        if f"word/{kind}s.xml" in found:
            notes[kind] = {n.get(f"{W}id") or "": n for n in X.fromstring(found[f"word/{kind}s.xml"]).findall(f"{W}{kind}")}
    cited: list[tuple[str, str]] = []

    def image(ref, alt=""):
        target = targets.get(ref, "")
        path = target[1:] if target.startswith("/") else "word/" + target
        if path not in found:
            return ""
        nonlocal seen
        seen += 1
        mime = MIME.get("." + path.rpartition(".")[2].lower(), "application/octet-stream")
        stem = f"image-{seen:04d}"
        drawn = tiff.to_png(found[path]) if mime == "image/tiff" else None
        if drawn is not None:
            images.append((stem + ".png", "image/png", drawn))
        else:
            images.append((stem + {**SHOWN, **OTHERS}.get(mime, ".bin"), mime, found[path]))
            if mime not in SHOWN:  # browsers can't show it: the bytes stay beside an empty picture
                images.append((stem + ".png", "image/png", placeholder()))
        where = f"{folder.rstrip('/')}/" if folder else ""
        return f'<img src="{html.escape(where)}{stem}{SHOWN.get(mime, ".png")}" alt="{html.escape(alt)}">'

    def note(kind, e):
        key = e.get(f"{W}id") or ""
        if key not in notes.get(kind, {}):
            return ""
        cited.append((kind, key))
        return f'<sup><a href="#{kind}-{key}" id="{kind}-ref-{key}">[{len(cited)}]</a></sup>'

    fields: list[dict] = []  # open ones; a field may go on in the next paragraph
    beside: list[str] = []  # text boxes of the paragraph at hand, which follow it

    def boxes(e):
        """Text boxes of a drawing or picture, those in others left to their own."""
        for x in e:
            if x.tag == f"{W}txbxContent":
                beside.append(body(x))
            else:
                boxes(x)

    def run(r):
        on = lambda name: (e := r.find(f"{W}rPr/{W}{name}")) is not None and e.get(f"{W}val", "1") not in ("0", "false", "off", "none")
        text = ""
        for e in r:
            if e.tag == f"{W}t":
                text += html.escape(e.text or "", quote=False)
            elif e.tag in (f"{W}br", f"{W}cr"):
                text += "<br>"
            elif e.tag == f"{W}tab":
                text += " "
            elif e.tag == f"{W}noBreakHyphen":
                text += "\u2011"
            elif e.tag == f"{W}drawing":
                said = next((d.get("descr") or "" for d in e.iter() if d.tag.endswith("}docPr")), "")
                inner = {id(b) for t in e.iter(f"{W}txbxContent") for b in t.iter(f"{A}blip")}
                text += "".join(image(b.get(f"{R}embed"), said) for b in e.iter(f"{A}blip") if id(b) not in inner)
                boxes(e)
            elif e.tag == f"{W}pict":
                inner = {id(d) for t in e.iter(f"{W}txbxContent") for d in t.iter(f"{V}imagedata")}
                text += "".join(image(d.get(f"{R}id"), d.get(f"{O}title") or "") for d in e.iter(f"{V}imagedata") if id(d) not in inner)
                boxes(e)
            elif e.tag in (f"{W}footnoteReference", f"{W}endnoteReference"):
                text += note(e.tag.removeprefix(W).removesuffix("Reference"), e)
            elif e.tag == f"{W}fldChar":
                kind = e.get(f"{W}fldCharType")
                if kind == "begin":
                    fields.append({"code": "", "shown": False})
                elif kind == "separate" and fields:
                    fields[-1]["shown"] = True
                elif kind == "end" and fields:
                    fields.pop()
            elif e.tag == f"{W}instrText" and fields:
                fields[-1]["code"] += e.text or ""
            elif e.tag == f"{C}AlternateContent":
                branches, known = (e.find(f"{C}Choice"), e.find(f"{C}Fallback")), len(beside)
                made = "" if branches[0] is None else run(branches[0])
                text += made if made or len(beside) > known or branches[1] is None else run(branches[1])
        if not text.strip():
            return text
        place = r.find(f"{W}rPr/{W}vertAlign")
        raised = {"superscript": "sup", "subscript": "sub"}.get(place.get(f"{W}val", "")) if place is not None else None
        for tag in (raised, "s" if on("strike") or on("dstrike") else None, "i" if on("i") else None, "b" if on("b") else None):
            text = f"<{tag}>{text}</{tag}>" if tag else text
        return text

    def inline(e):
        pieces: list[list] = []  # [target, HTML]: neighbours with one target become one link

        def add(target, text):
            if pieces and pieces[-1][0] == target:
                pieces[-1][1] += text
            else:
                pieces.append([target, text])

        for x in e:
            if x.tag == f"{W}r":
                text = run(x)
                add(next((t for f in reversed(fields) if f["shown"] and (t := field_target(f["code"]))), None), text)
            elif x.tag == f"{M}oMathPara":
                add(None, "".join(f"$${html.escape(latex(m), quote=False)}$$" for m in x.iter(f"{M}oMath")))
            elif x.tag == f"{M}oMath":
                add(None, f"${html.escape(latex(x), quote=False)}$")
            elif x.tag == f"{W}sdt":
                add(None, "".join(map(inline, x.findall(f"{W}sdtContent"))))
            elif x.tag in (f"{W}hyperlink", f"{W}ins", f"{W}smartTag", f"{W}fldSimple"):
                anchor = x.get(f"{W}anchor") if x.tag == f"{W}hyperlink" else None
                target = targets.get(x.get(f"{R}id")) or (f"#{anchor}" if anchor else field_target(x.get(f"{W}instr") or ""))
                add(target, inline(x))
        return "".join(f'<a href="{html.escape(target)}">{text}</a>' if target and text.strip() else text for target, text in pieces)

    def paragraph(p):
        """``(HTML, None)``, or ``(content, (level, kind))`` of an item of a list."""
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val") if style is not None else None
        level = headings.get(name)
        text = inline(p)
        if not text.strip():
            return "", None
        if level:
            return f"<h{level}>{text}</h{level}>", None
        number = _number(p) or list_styles.get(name)
        if number and number[0] != "0":
            at = min(number[1], 8)
            return text, (at, kinds.get(number, "ul"))
        return f"<p>{text}</p>", None

    def table(t):
        grid = []
        for row in t.findall(f"{W}tr"):
            cells, column = [], 0
            for c in row.findall(f"{W}tc"):
                span = c.find(f"{W}tcPr/{W}gridSpan")
                merge = c.find(f"{W}tcPr/{W}vMerge")
                wide = int(span.get(f"{W}val", "1")) if span is not None and span.get(f"{W}val", "1").isdecimal() else 1
                follows = merge is not None and merge.get(f"{W}val", "continue") == "continue"
                cells.append([column, wide, follows, body(c), 1])
                column += wide
            grid.append(cells)
        for y, cells in enumerate(grid):
            for cell in cells:
                if not cell[2]:
                    for below in grid[y + 1 :]:
                        if not any(b[0] == cell[0] and b[2] for b in below):
                            break
                        cell[4] += 1
        attrs = lambda c: (f' colspan="{c[1]}"' if c[1] > 1 else "") + (f' rowspan="{c[4]}"' if c[4] > 1 else "")
        return "<table>" + "".join("<tr>" + "".join(f"<td{attrs(c)}>{c[3]}</td>" for c in cells if not c[2]) + "</tr>" for cells in grid) + "</table>"

    def children(e):
        for x in e:
            if x.tag == f"{W}sdt":
                for inside in x.findall(f"{W}sdtContent"):
                    yield from children(inside)
            elif x.tag in (f"{W}ins", f"{W}customXml"):
                yield from children(x)
            else:
                yield x

    def body(e):
        blocks, items = [], []
        for x in children(e):
            if x.tag == f"{W}p":
                above, beside[:] = list(beside), []
                text, place = paragraph(x)
                after, beside[:] = "".join(beside), above
                if place is not None:
                    items.append((*place, text + after))
                    continue
                text += after
                if not text:
                    continue
            elif x.tag == f"{W}tbl":
                text = table(x)
            else:
                continue
            if items:
                blocks.append(nested_lists(items))
                items = []
            blocks.append(text)
        if items:
            blocks.append(nested_lists(items))
        if e.tag == f"{W}tc" and len(blocks) == 1:
            return blocks[0].removeprefix("<p>").removesuffix("</p>")
        return "".join(blocks)

    main = document.find(f"{W}body")
    shown = "" if main is None else body(main)
    ends, at = "", 0
    while at < len(cited):  # a note may cite another
        kind, key = cited[at]
        ends += f'<li id="{kind}-{key}">{body(notes[kind][key])} <a href="#{kind}-ref-{key}">↑</a></li>'
        at += 1
    return shown + (f"<ol>{ends}</ol>" if ends else ""), images, title


def field_target(code: str) -> str | None:
    """Where a field of the kind HYPERLINK leads: an address, a bookmark, or both."""
    m = re.match(r'\s*HYPERLINK\s+(?!\\)(?:"([^"]*)"|(\S+))', code)
    mark = re.search(r'\s\\l\s+(?:"([^"]*)"|(\S+))', code) if re.match(r"\s*HYPERLINK\b", code) else None
    target = (m[1] or m[2] or "" if m else "") + (f"#{mark[1] or mark[2]}" if mark else "")
    return target or None


def _number(p) -> tuple[str, int] | None:
    """``(number id, level)`` of a paragraph or a style."""
    found = p.find(f"{W}pPr/{W}numPr")
    if found is None:
        return None
    key, level = found.find(f"{W}numId"), found.find(f"{W}ilvl")
    at = "0" if level is None else level.get(f"{W}val") or "0"
    return None if key is None else (key.get(f"{W}val") or "0", int(at) if at.isdecimal() else 0)


def _list_styles(found: dict[str, bytes]) -> dict[str | None, tuple[str, int]]:
    try:
        styles = X.fromstring(found["word/styles.xml"])
    except (KeyError, X.ParseError):
        return {}
    return {s.get(f"{W}styleId"): number for s in styles.iter(f"{W}style") if (number := _number(s))}
