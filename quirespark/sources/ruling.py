"""Tables from the ruling lines of a page: lines merged by an interval sweep, cells as the faces of their grid.

All of it runs on the lines of one page, which its parser has at hand; nothing is shuffled for it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence
from typing import NamedTuple

#: Points by which lines may miss each other: beside each other, end to end, and at a crossing.
SNAP, JOIN, REACH = 3.0, 3.0, 3.0
#: Least length of a rule.
SHORT = 3.0
#: Cells that a table has at least: a single frame is none.
CELLS = 2


class Table(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    rows: list[list[tuple[float, float, float, float] | None]]  # a merged cell stands where it begins


def merged(lines: Iterable[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """``(place, low, high)`` lines: those at one place that overlap or adjoin become one."""
    out: list[tuple[float, float, float]] = []
    groups: list[list[tuple[float, float, float]]] = []
    for line in sorted(lines):
        if groups and line[0] - groups[-1][0][0] <= SNAP:
            groups[-1].append(line)
        else:
            groups.append([line])
    for group in groups:
        place = sum(x[0] for x in group) / len(group)
        low = high = None
        for a, b in sorted((x[1], x[2]) for x in group):
            if high is not None and a <= high + JOIN:
                high = max(high, b)
                continue
            if high is not None:
                out.append((place, low, high))
            low, high = a, b
        out.append((place, low, high))
    return [x for x in out if x[2] - x[1] >= SHORT]


class Sets:
    """Which things belong together."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def distinct(places: Iterable[float]) -> list[float]:
    out: list[float] = []
    for x in sorted(places):
        if not out or x - out[-1] > SNAP:
            out.append(x)
    return out


def tables(rules: Sequence[tuple[float, float, float, float]]) -> list[Table]:
    """The tables of a page in order of their upper left corners; ``rules`` are ``(x0, y0, x1, y1)`` along the axes."""
    level = merged((y0, min(x0, x1), max(x0, x1)) for x0, y0, x1, y1 in rules if abs(x1 - x0) > abs(y1 - y0))
    upright = merged((x0, min(y0, y1), max(y0, y1)) for x0, y0, x1, y1 in rules if abs(x1 - x0) <= abs(y1 - y0))
    sets = Sets(len(level) + len(upright))
    for i, (y, left, right) in enumerate(level):
        for j, (x, top, bottom) in enumerate(upright):  # in order of x
            if x > right + REACH:
                break
            if x >= left - REACH and top - REACH <= y <= bottom + REACH:
                sets.join(i, len(level) + j)
    parts: dict[int, tuple[list, list]] = {}
    for i, line in enumerate([*level, *upright]):
        parts.setdefault(sets.find(i), ([], []))[i >= len(level)].append(line)
    found = [t for rows, columns in parts.values() if len(rows) > 1 and len(columns) > 1 and (t := faces(rows, columns)) is not None]
    return sorted(found, key=lambda t: (t.y0, t.x0))


def faces(level: list[tuple[float, float, float]], upright: list[tuple[float, float, float]]) -> Table | None:
    """The enclosed faces of one grid of crossing lines."""
    xs, ys = distinct(x[0] for x in upright), distinct(y[0] for y in level)
    n, m = len(xs) - 1, len(ys) - 1
    if n < 1 or m < 1:
        return None

    def walls(lines, places, across):
        """For each place and each stretch between neighbouring ``across``, whether a line covers the stretch."""
        out = [[False] * (len(across) - 1) for _ in places]
        for place, low, high in lines:
            k = min(range(len(places)), key=lambda i: abs(places[i] - place))
            for i in range(len(across) - 1):
                if low - REACH <= across[i] and across[i + 1] <= high + REACH:
                    out[k][i] = True
        return out

    left, top = walls(upright, xs, ys), walls(level, ys, xs)
    cells, outside = Sets(n * m + 1), n * m
    for r in range(m):
        for c in range(n):
            here = r * n + c
            if not left[c + 1][r]:
                cells.join(here, here + 1 if c + 1 < n else outside)
            if not top[r + 1][c]:
                cells.join(here, here + n if r + 1 < m else outside)
            if c == 0 and not left[0][r]:
                cells.join(here, outside)
            if r == 0 and not top[0][c]:
                cells.join(here, outside)
    boxes: dict[int, list[int]] = {}
    for r in range(m):
        for c in range(n):
            root = cells.find(r * n + c)
            if root != cells.find(outside):
                box = boxes.setdefault(root, [c, r, c, r])
                box[0], box[2], box[3] = min(box[0], c), max(box[2], c), max(box[3], r)
    if len(boxes) < CELLS:
        return None
    rows: list[list] = [[None] * n for _ in range(m)]
    for c0, r0, c1, r1 in boxes.values():
        rows[r0][c0] = (xs[c0], ys[r0], xs[c1 + 1], ys[r1 + 1])
    used = [b for row in rows for b in row if b is not None]
    return Table(min(b[0] for b in used), min(b[1] for b in used), max(b[2] for b in used), max(b[3] for b in used), rows)


def texts(table: Table, spans: Iterable) -> list[list[str]]:
    """The table's cells as text: spans (``text, x0, x1, y, size``) whose middle lies in a cell, from top to bottom."""
    placed = [(s.y - s.size / 3, (s.x0 + s.x1) / 2, i, s) for i, s in enumerate(spans)]
    inside = sorted(p for p in placed if table.x0 <= p[1] <= table.x1 and table.y0 <= p[0] <= table.y1)
    heights = [p[0] for p in inside]

    def cell(box) -> str:
        row = inside[bisect_left(heights, box[1]) : bisect_left(heights, box[3])]
        own = [(round(s.y), s.x0, i, s.text) for _, x, i, s in row if box[0] <= x < box[2]]
        return own[0][3] if len(own) == 1 else " ".join([o[3] for o in sorted(own)])

    return [["" if box is None else cell(box) for box in row] for row in table.rows]
