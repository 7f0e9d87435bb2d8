"""Pictures of regions without a renderer: what lies below a region is cut out of the page's images.

Images are known by where the page places them. Of those below a region the one that covers most of it is taken, if that
is half of it or more: cropped to the region, scaled, and written as a PNG. A JPEG can't be cropped
without a decoder and is passed through whole, if the region holds most of it. Regions over drawn lines or text have no picture here.
"""

from __future__ import annotations

import struct
import zlib
from typing import Any, NamedTuple

import numpy as np

from . import pdf

#: Share of a region that an image has to cover, and of a JPEG that has to lie in the region.
COVERED, HELD = 0.5, 0.5
#: Pixels of a picture at most: the scale is lowered beyond.
PIXELS = 1 << 24
_last: list[tuple[bytes, "Pages"]] = []


class Placed(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    turned: tuple[bool, bool]  # from right to left, from bottom to top
    ref: Any


class Pages:
    """A file whose pages are interpreted once for their images."""

    def __init__(self, content: bytes):
        self.file = pdf.File(content)
        self.pages = list(self.file.pages())
        self.known: dict[int, list[Placed]] = {}

    def images(self, number: int) -> list[Placed]:
        if number not in self.known:
            shown = pdf.interpreted(self.file, self.pages[number - 1])
            self.known[number] = [p for matrix, ref in shown.images if (p := placed(matrix, ref)) is not None]
        return self.known[number]


def placed(matrix, ref) -> Placed | None:
    """Where the unit square comes to lie; nothing for images that are askew or stand on their side."""
    a, b, c, d, e, f = matrix
    if max(abs(b), abs(c)) > 0.01 * max(abs(a), abs(d), 1e-9):
        return None
    return Placed(min(e, e + a), min(f, f + d), max(e, e + a), max(f, f + d), (a < 0, d > 0), ref)


def overlap(p: Placed, box) -> float:
    return max(0.0, min(p.x1, box[2]) - max(p.x0, box[0])) * max(0.0, min(p.y1, box[3]) - max(p.y0, box[1]))


def render(content: bytes, page_no: int, box: tuple[float, float, float, float], scale: float = 2.0) -> bytes | None:
    """The bytes of a PNG (or of a JPEG) of a region in points, or None."""
    if not _last or _last[0][0] is not content and _last[0][0] != content:
        _last[:] = [(content, Pages(content))]
    own = _last[0][1]
    if not 1 <= page_no <= len(own.pages):
        return None
    best = max(own.images(page_no), key=lambda p: overlap(p, box), default=None)
    area = (box[2] - box[0]) * (box[3] - box[1])
    if best is None or overlap(best, box) < COVERED * area:
        return None
    head = own.file.table(best.ref)
    filters = own.file.get(head.get("Filter"))
    filters = filters if isinstance(filters, list) else [filters]
    if own.file.get(filters[-1]) in ("DCTDecode", "DCT"):
        size = (best.x1 - best.x0) * (best.y1 - best.y0)
        return own.file.raw(best.ref, len(filters) - 1) if overlap(best, box) >= HELD * size else None
    image = pixels(own.file, best.ref)
    if image is None:
        return None
    return png(cropped(image, best, box, scale))


def cropped(image: np.ndarray, at: Placed, box, scale: float) -> np.ndarray:
    """The region's part of an image, a pixel for each step of ``1 / scale`` points; white where the image ends."""
    width, height = (max(1, round((box[k + 2] - box[k]) * scale)) for k in (0, 1))
    if width * height > PIXELS:
        less = (PIXELS / (width * height)) ** 0.5
        width, height = max(1, int(width * less)), max(1, int(height * less))
    rows, columns = image.shape[:2]

    def places(n: int, low: float, high: float, begin: float, end: float, size: int, turned: bool) -> np.ndarray:
        middle = low + (np.arange(n) + 0.5) * (high - low) / n
        found = np.floor((middle - begin) / (end - begin) * size).astype(np.int64)
        return np.where((middle < begin) | (middle >= end), -1, size - 1 - found if turned else found)

    x = places(width, box[0], box[2], at.x0, at.x1, columns, at.turned[0])
    y = places(height, box[1], box[3], at.y0, at.y1, rows, at.turned[1])
    out = image[np.clip(y, 0, rows - 1)][:, np.clip(x, 0, columns - 1)].copy()
    out[(y < 0) | (y >= rows)] = 255
    out[:, (x < 0) | (x >= columns)] = 255
    return out


def pixels(file, ref) -> np.ndarray | None:
    """Rows and columns of grey (one) or red, green and blue (three) bytes; None for what isn't read here."""
    head, data = file.stream(ref)
    if not data:
        return None
    value = lambda *names: next((file.get(head[n]) for n in names if n in head), None)
    width, height = value("Width", "W"), value("Height", "H")
    mask = value("ImageMask", "IM") is True
    bits = 1 if mask else value("BitsPerComponent", "BPC") or 8
    channels, table = (1, None) if mask else colours(file, value("ColorSpace", "CS"))
    if not isinstance(width, int) or not isinstance(height, int) or width * height <= 0 or width * height > 1 << 28 or bits not in (1, 2, 4, 8, 16) or not channels:
        return None
    stride = (width * channels * bits + 7) // 8
    raw = np.frombuffer(data[: stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
    if bits < 8:
        parts = np.unpackbits(raw, axis=1)[:, : width * channels * bits].reshape(height, width * channels, bits)
        samples = (parts * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)
    else:
        samples = raw[:, :: bits // 8][:, : width * channels]
    samples = samples.reshape(height, width, channels)
    decode = value("Decode", "D")
    if table is not None:
        return table[np.minimum(samples[:, :, 0], len(table) - 1)]
    if bits < 8:
        samples = (samples.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if isinstance(decode, list) and len(decode) >= 2 and isinstance(decode[0], (int, float)) and decode[0] > decode[1]:
        samples = 255 - samples
    if channels == 4:  # cyan, magenta, yellow, black
        ink = 255 - samples.astype(np.uint16)
        samples = (ink[:, :, :3] * ink[:, :, 3:] // 255).astype(np.uint8)
    return samples


def colours(file, space: Any) -> tuple[int, np.ndarray | None]:
    """Samples of a pixel, and the table of an indexed space."""
    names = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 0, "DeviceCMYK": 4, "CMYK": 4}
    if not isinstance(space, list):
        return names.get(space, 1 if space is None else 0), None
    kind = file.get(space[0]) if space else None
    if kind == "ICCBased" and len(space) > 1:
        n = file.get(file.table(space[1]).get("N"))
        return (n, None) if n in (1, 3, 4) else (0, None)
    if kind in ("Indexed", "I") and len(space) == 4:
        base, _ = colours(file, file.get(space[1]))
        data = file.stream(space[3])[1] if isinstance(space[3], pdf.Ref) and not isinstance(file.get(space[3]), bytes) else file.get(space[3])
        if base not in (1, 3, 4) or not isinstance(data, bytes) or len(data) < base:
            return 0, None
        table = np.frombuffer(data[: len(data) // base * base], np.uint8).reshape(-1, base)
        if base == 4:
            ink = 255 - table.astype(np.uint16)
            table = (ink[:, :3] * ink[:, 3:] // 255).astype(np.uint8)
        return 1, table
    return names.get(kind, 0), None


def png(samples: np.ndarray) -> bytes:
    height, width, channels = samples.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.zeros((height, width * channels + 1), np.uint8)
    lines[:, 1:] = samples.reshape(height, width * channels)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
