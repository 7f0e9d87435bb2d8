"""HTML to Markdown: a tree is built with the tags that pages leave out, and written from its leaves up.

A start tag ends what it implies (an item the item before it, a block its paragraph, a cell or row the one before); an end tag closes
only what is open within its own cell, list or table, and stray ones are passed over. Places of open tags are kept by
name, so that a page takes linear time however badly it nests. A part is written once, when its element ends.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

SKIPPED = {"script", "style", "head", "template"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "figure", "figcaption", "aside", "nav", "address", "form", "fieldset", "dl", "dt", "dd", "caption"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CELLS, PARTS = {"td", "th"}, {"thead", "tbody", "tfoot"}
#: What a start tag ends, and what it doesn't reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"} | CELLS, {"table"}),
    **{tag: (CELLS, {"tr", "table"}) for tag in CELLS},
    **{tag: (PARTS | CELLS | {"tr"}, {"table"}) for tag in PARTS},
    **{tag: ({"p"}, {"li", "dd", "blockquote", "table", "button", "div"} | CELLS) for tag in (BLOCKS - {"dt", "dd", "caption"}) | {"blockquote", "pre", "ul", "ol", "table", "hr", *(f"h{i}" for i in range(1, 7))}},
}
#: Where an end tag stops looking for its start.
BOUNDS = {"li": {"ul", "ol", "table"}, "tr": {"table"}, **{tag: {"table"} for tag in CELLS | PARTS}, "table": set()}
MARKED = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "strike": "~~"}
SAME = {"b": ("b", "strong"), "strong": ("b", "strong"), "i": ("i", "em"), "em": ("i", "em"), "s": ("s", "del", "strike"), "del": ("s", "del", "strike"), "strike": ("s", "del", "strike")}
MONO = {"code", "kbd", "samp"}


class _Node:
    __slots__ = ("attrs", "count", "parts", "rows", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.parts, self.rows, self.count = tag, attrs, [], [], 0


class _Writer(HTMLParser):
    def __init__(self, escape: bool = False):
        super().__init__(convert_charrefs=True)
        self.escape = escape
        self.root = _Node("", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.skip = 0
        self.title: str | None = None
        self.in_title = False
        self.last = ""

    def place(self, tags) -> int:
        """Where the innermost of some tags is open; -1 if none is."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def put(self, text: str) -> None:
        self.stack[-1].parts.append(text)
        self.last = text

    def depth(self) -> int:
        return len(self.places["ul"]) + len(self.places["ol"])

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        ends, beyond = IMPLIED.get(tag, ((), ()))
        bound = self.place(beyond) if ends else 0
        at = min((p for t in ends for p in reversed(self.places[t]) if p > bound), default=-1) if ends else -1
        if at >= 0:
            self.end(at)
        known = dict(attrs)
        if tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "img":
            self.put(f"![{known.get('alt') or ''}]({known.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.put("\n" if self.depth() else "\n\n")
        if tag in EMPTY:
            return
        self.places[tag].append(len(self.stack))
        self.stack.append(_Node(tag, known))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or not self.places[tag]:
            return
        at = self.places[tag][-1]
        if at > self.place(BOUNDS.get(tag, CELLS | {"table"})) or tag == "table":
            self.end(at)

    def end(self, at: int) -> None:
        """Ends all that is open from a place of the stack on, innermost first."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            self.put(self.written(node, "".join(node.parts)))

    def written(self, node: _Node, inner: str) -> str:
        tag = node.tag
        if tag in MARKED:
            text = " ".join(inner.split())
            mark = "" if any(self.places[t] for t in SAME[tag]) else MARKED[tag]
            return f"{mark}{text}{mark}" if text else ""
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
            text = " ".join(inner.split())
            return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
        if tag in MONO and not self.places["pre"]:
            if any(self.places[t] for t in MONO) or not inner:
                return inner
            fence = "`" * (max(map(len, re.findall("`+", inner)), default=0) + 1)
            pad = " " if inner[0] == "`" or inner[-1] == "`" else ""
            return f"{fence}{pad}{inner}{pad}{fence}"
        if tag == "pre":
            fence = "`" * max(3, max(map(len, re.findall("`+", inner)), default=0) + 1)
            return f"\n\n{fence}\n" + inner.removeprefix("\n").rstrip("\n") + f"\n{fence}\n\n"
        if tag == "a":
            text = " ".join(inner.split())
            return f"[{text}]({node.attrs.get('href') or ''})" if text else ""
        if tag == "li":
            own = self.stack[max(0, self.place(("ul", "ol")))]
            own.count += 1
            mark = f"{own.count}. " if own.tag == "ol" else "* "
            return "  " * max(0, self.depth() - 1) + mark + inner.strip() + "\n"
        if tag in ("ul", "ol"):
            return inner + ("" if self.depth() else "\n")
        if tag in CELLS:
            own = self.stack[max(0, self.place(("tr", "table")))]
            if own is self.root:
                return inner
            own.rows.append(" ".join(inner.split()))
            return ""
        if tag == "tr":
            own = self.stack[max(0, self.place(("table",)))]
            if own is self.root:
                return " ".join(node.rows) + inner
            own.rows.append(node.rows)
            return inner if inner.strip() else ""
        if tag == "table":
            rows = [r if isinstance(r, list) else [r] for r in node.rows]
            if any(self.places[t] for t in CELLS):  # within a cell: its text
                return " ".join([inner, *(c for row in rows for c in row)]) + " "
            return (f"\n\n{inner.strip()}" if inner.strip() else "") + _table(rows)
        if tag == "blockquote":
            lines = tidy(inner).split("\n")
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in lines) + "\n\n" if any(lines) else ""
        if tag in BLOCKS:
            return f"\n\n{inner.strip()}\n\n" if inner.strip() else ""
        return inner

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        if self.skip or self.in_title:
            return
        if self.places["pre"]:
            self.put(data)
        elif data.strip():
            plain = self.escape and not any(self.places[t] for t in MONO)
            self.put(re.sub(r"[*_]", r"\\\g<0>", " ".join(data.split("\n"))) if plain else " ".join(data.split("\n")))
        elif data and self.last and not self.last.endswith("\n"):
            self.put(" ")


def _table(rows: list[list[str]]) -> str:
    drawn = [[c.replace("|", "\\|") for c in r] for r in rows]
    drawn = [r for r in drawn if any(r)]
    if not drawn:
        return ""
    width = max(map(len, drawn))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in drawn]
    return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"


def tidy(text: str) -> str:
    text = re.sub(r"[ \t]*\n[ \t]*(?=\n)", "\n", text)
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(html: str | None, escape: bool = False) -> tuple[str, str | None]:
    """Markdown and title of a page. With ``escape``, asterisks and underscores of the text don't become markup."""
    writer = _Writer(escape)
    writer.feed(html or "")
    writer.close()
    writer.end(1)
    return tidy("".join(writer.root.parts)), writer.title
