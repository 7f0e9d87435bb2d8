"""Baseline TIFF pictures as PNG, with the standard library: strips of 1 or 8 bits, grey, palette or RGB."""

from __future__ import annotations

import struct
import zlib

from .pdf import lzw

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def _packed(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _entries(data: bytes, order: str) -> dict[int, list[int]]:
    """The first picture's tags with integer values."""
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        size = SIZES[kind] * n
        spot = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        out[tag] = list(struct.unpack_from(f"{order}{n}{' BxHI'[kind]}", data, spot))
    return out


def to_png(data: bytes) -> bytes | None:
    """The first picture, or None where its kind is not known here or it is damaged."""
    try:
        return _to_png(data)
    except (struct.error, zlib.error, IndexError, KeyError, ValueError):
        return None


def _to_png(data: bytes) -> bytes | None:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return None
    tags = _entries(data, order)
    width, height = tags[256][0], tags[257][0]
    bits, packing, sense, samples = tags.get(258, [1]), tags.get(259, [1])[0], tags[262][0], tags.get(277, [1])[0]
    unpack = {1: bytes, 5: lambda x: lzw(x, 1), 8: zlib.decompress, 32946: zlib.decompress, 32773: _packed}.get(packing)
    if unpack is None or 273 not in tags or len(set(bits)) > 1 or bits[0] not in (1, 8) or tags.get(284, [1])[0] != 1 or width * height > 1 << 28:
        return None
    raw = b"".join(unpack(data[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    step = (width * bits[0] * samples + 7) // 8
    rows = [bytearray(raw[i * step : (i + 1) * step].ljust(step, b"\0")) for i in range(height)]
    if tags.get(317, [1])[0] == 2 and bits[0] == 8:
        for row in rows:
            for i in range(samples, step):
                row[i] = (row[i] + row[i - samples]) & 255
    palette = b""
    if sense == 3 and samples == 1:
        n = 1 << bits[0]
        colours = tags[320]
        palette = b"".join(bytes(colours[c * n + i] >> 8 for c in range(3)) for i in range(n))
        kind = 3
    elif sense in (0, 1) and samples in (1, 2):
        if sense == 0:
            rows = [bytearray(255 - x for x in row) for row in rows] if samples == 1 else rows
        kind = {1: 0, 2: 4}[samples]
    elif sense == 2 and samples in (3, 4) and bits[0] == 8:
        kind = {3: 2, 4: 6}[samples]
    else:
        return None

    def chunk(name: bytes, value: bytes) -> bytes:
        return struct.pack(">I", len(value)) + name + value + struct.pack(">I", zlib.crc32(name + value))

    head = struct.pack(">IIBBBBB", width, height, bits[0], kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")
