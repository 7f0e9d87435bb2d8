"""Characters and widths from what a PDF file embeds of a font, where the file doesn't state them.

* TrueType: ``cmap`` subtables turned round (glyph to character), names from ``post``, widths from ``hmtx``.
* CFF: charsets (names of glyphs, or CIDs), encodings, and the standard names by rule.
* Type 1: the encoding in the program's clear part.
* Predefined character maps: those whose codes are Unicode, or a national encoding that Python knows.

A table that is damaged or cut gives what can be read of it; nothing here fails.
"""

from __future__ import annotations

import re
import struct

# The standard glyphs of PostScript fonts by their characters, in order of their numbers from 1: ASCII (with its own
# quotes), the rest of the standard encoding with their codes, further signs, and letters with accents.
ASCII = " !\"#$%&’()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_‘abcdefghijklmnopqrstuvwxyz{|}~"
UPPER = "¡ ¢ £ ⁄ ¥ ƒ § ¤ ' “ « ‹ › fi fl – † ‡ · ¶ • ‚ „ ” » … ‰ ¿ ` ´ ˆ ˜ ¯ ˘ ˙ ¨ ˚ ¸ ˝ ˛ ˇ — Æ ª Ł Ø Œ º æ ı ł ø œ ß".split(" ")
UPPER_CODES = [*range(0xA1, 0xB0), 0xB1, 0xB2, 0xB3, 0xB4, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xBB, 0xBC, 0xBD, 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, 0xE8, 0xE9, 0xEA, 0xEB, 0xF1, 0xF5, 0xF8, 0xF9, 0xFA, 0xFB]
SIGNS = list("¹¬µ™Ð½±Þ¼÷¦°þ¾²®−ð×³©")
CAPITALS = list("ÁÂÄÀÅÃÇÉÊËÈÍÎÏÌÑÓÔÖÒÕŠÚÛÜÙÝŸŽ")
STANDARD = ["", *ASCII, *UPPER, *SIGNS, *CAPITALS, *[c.lower() for c in CAPITALS]]
STANDARD_CODES = {32 + i: c for i, c in enumerate(ASCII)} | dict(zip(UPPER_CODES, UPPER, strict=True))
#: Standard names of fonts of the first format: numbers from here on are the font's own.
OWN_NAMES = 391
# National encodings by a part of a predefined map's name.
NATIONAL = {"GBK2K": "gb18030", "GBKp": "gbk", "GBK": "gbk", "GBpc": "gb2312", "GB-": "gb2312", "90ms": "cp932", "90msp": "cp932", "90pv": "cp932", "83pv": "cp932", "Add-RKSJ": "cp932", "Ext-RKSJ": "cp932", "RKSJ": "cp932", "HKscs": "big5hkscs", "ETen": "cp950", "B5": "big5", "KSCms": "cp949", "KSCpc": "cp949", "KSC": "cp949", "EUC": "euc_jp"}


def predefined(name: str) -> str | None:
    """The codec of a predefined map's codes, by its name; nothing for maps to a collection's own numbers."""
    if not re.search(r"-[HV]\Z", name) or name.startswith("Identity"):
        return None
    if re.match(r"Uni\w+-(UCS2|UTF16)", name):
        return "utf-16-be"
    if re.match(r"Uni\w+-UTF8", name):
        return "utf-8"
    if re.match(r"Uni\w+-UTF32", name):
        return "utf-32-be"
    return next((codec for part, codec in NATIONAL.items() if part in name), None)


#: Codecs each of whose codes is one character, and a code alone decodes as it does among others.
ONE_EACH = ("utf-16-be", "gb18030", "gbk", "gb2312", "cp932", "cp949", "cp950", "big5")


def whole(data: bytes, codec: str) -> str | None:
    """The characters of all codes, one for each; nothing where a code is damaged, or may be several characters."""
    try:
        return data.decode(codec) if codec in ONE_EACH else None
    except UnicodeDecodeError:
        return None


def split_codes(data: bytes, codec: str) -> list[tuple[bytes, str]]:
    """Codes of a predefined map and their characters: a national code is as long as its first bytes decode to one."""
    if codec in ("utf-16-be", "utf-32-be"):
        step, out, at = (2 if codec == "utf-16-be" else 4), [], 0
        while at < len(data):
            size = 4 if step == 2 and 0xD8 <= data[at] <= 0xDB and at + 4 <= len(data) else step
            out.append((data[at : at + size], data[at : at + size].decode(codec, "replace")))
            at += size
        return out
    out, at = [], 0
    while at < len(data):
        for size in range(1, 5):
            try:
                out.append((data[at : at + size], data[at : at + size].decode(codec)))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append((data[at : at + 1], "�"))
        at += len(out[-1][0])
    return out


class Reading:
    """Big-endian numbers out of bytes; behind the end there are zeros."""

    def __init__(self, data: bytes):
        self.data = data

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size].ljust(size, b"\0"), "big")

    def short(self, at: int) -> int:
        return self.number(at, 2)


# --- TrueType --------------------------------------------------------------


class TrueType(Reading):
    """``characters``: glyph to character; ``codes``: code to glyph of fonts with codes of their own; ``widths``: glyph to 1000ths."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.characters: dict[int, str] = {}
        self.codes: dict[int, int] = {}
        self.widths: dict[int, float] = {}
        self.tables: dict[bytes, tuple[int, int]] = {}
        if data[:4] == b"ttcf":
            start = self.number(12, 4)
        else:
            start = 0
        for i in range(min(self.short(start + 4), 256)):
            at = start + 12 + 16 * i
            self.tables[data[at : at + 4]] = (self.number(at + 8, 4), self.number(at + 12, 4))
        if b"post" in self.tables:
            self.names()
        if b"cmap" in self.tables:
            self.maps()
        if b"hmtx" in self.tables and b"hhea" in self.tables and b"head" in self.tables:
            self.advances()

    def maps(self) -> None:
        base = self.tables[b"cmap"][0]
        listed = []
        for i in range(min(self.short(base + 2), 64)):
            platform, encoding = self.short(base + 4 + 8 * i), self.short(base + 6 + 8 * i)
            listed.append((platform, encoding, base + self.number(base + 8 + 8 * i, 4)))
        for platform, encoding, at in sorted(listed, key=lambda x: (x[0] == 3 and x[1] in (1, 10) or x[0] == 0, x[1])):
            found = dict(self.subtable(at))
            if platform == 0 or platform == 3 and encoding in (1, 10):
                for code, glyph in sorted(found.items(), reverse=True):  # of several, the least character
                    self.characters[glyph] = chr(code)
            elif platform == 3 and encoding == 0:
                self.codes |= {code & 0xFF: glyph for code, glyph in found.items()}
            elif platform == 1:
                self.codes = {**found, **self.codes}
                for code, glyph in found.items():
                    if code < 256:
                        self.characters.setdefault(glyph, bytes([code]).decode("mac_roman"))

    def subtable(self, at: int):
        kind = self.short(at)
        if kind == 0:
            yield from ((c, g) for c, g in enumerate(self.data[at + 6 : at + 262]) if g)
        elif kind == 4:
            n = self.short(at + 6) // 2
            for i in range(min(n, 1 << 15)):
                end, start = self.short(at + 14 + 2 * i), self.short(at + 16 + 2 * n + 2 * i)
                delta, place = self.short(at + 16 + 4 * n + 2 * i), at + 16 + 6 * n + 2 * i
                offset = self.short(place)
                for code in range(start, end + 1):
                    glyph = self.short(place + offset + 2 * (code - start)) if offset else code
                    glyph = (glyph + delta) & 0xFFFF if glyph or not offset else 0
                    if glyph and code != 0xFFFF:
                        yield code, glyph
        elif kind == 6:
            first = self.short(at + 6)
            yield from ((first + i, g) for i in range(self.short(at + 8)) if (g := self.short(at + 10 + 2 * i)))
        elif kind == 12:
            for i in range(min(self.number(at + 12, 4), 1 << 16)):
                place = at + 16 + 12 * i
                start, end, glyph = struct.unpack_from(">III", self.data, place) if place + 12 <= len(self.data) else [self.number(place + 4 * k, 4) for k in range(3)]
                yield from ((code, glyph + code - start) for code in range(start, min(end, start + 0xFFFF, 0x10FFFF) + 1))

    def names(self) -> None:
        from .pdf import glyph

        at, size = self.tables[b"post"]
        if self.number(at, 4) != 0x20000:
            return
        n = self.short(at + 32)
        place, strings = at + 34 + 2 * n, []
        while place < at + size and len(strings) < 1 << 16:
            length = self.number(place, 1)
            strings.append(self.data[place + 1 : place + 1 + length].decode("latin-1"))
            place += 1 + length
        for i in range(n):
            index = self.short(at + 34 + 2 * i)
            if 258 <= index < 258 + len(strings) and (text := glyph(strings[index - 258])) != "�":
                self.characters[i] = text

    def advances(self) -> None:
        unit = self.short(self.tables[b"head"][0] + 18) or 1000
        at, n = self.tables[b"hmtx"][0], self.short(self.tables[b"hhea"][0] + 34)
        widths = struct.unpack(f">{2 * n}H", self.data[at : at + 4 * n].ljust(4 * n, b"\0"))[::2]
        self.widths.update((i, w * 1000 / unit) for i, w in enumerate(widths))


# --- CFF and Type 1 --------------------------------------------------------


class Cff(Reading):
    """``names``: glyph to name or, with ``wide``, to CID; ``codes``: code to glyph of the font's own encoding."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.names: dict[int, str | int] = {}
        self.codes: dict[int, int] = {}
        self.wide = False
        try:
            self.read()
        except (struct.error, LookupError, ValueError):
            pass

    def index(self, at: int) -> tuple[list[tuple[int, int]], int]:
        """Begin and end of an index's entries, and what follows it."""
        n, size = self.short(at), self.number(at + 2, 1)
        if not n or not 1 <= size <= 4:
            return [], at + 2
        base = at + 2 + size * (n + 1)
        ends = [base + self.number(at + 3 + size * i, size) for i in range(n + 1)]
        return list(zip(ends, ends[1:], strict=False)), ends[-1]

    def dictionary(self, at: int, end: int) -> dict[int, list[float]]:
        out, held = {}, []
        while at < end:
            b = self.data[at]
            if b <= 21:
                key = 1200 + self.data[at + 1] if b == 12 else b
                out[key], held = held, []
                at += 2 if b == 12 else 1
            elif b == 28:
                held.append(struct.unpack_from(">h", self.data, at + 1)[0])
                at += 3
            elif b == 29:
                held.append(struct.unpack_from(">i", self.data, at + 1)[0])
                at += 5
            elif b == 30:
                at += 1
                while at < end and self.data[at] & 15 != 15 and self.data[at] >> 4 != 15:
                    at += 1
                held.append(0.0)
                at += 1
            elif 32 <= b <= 246:
                held.append(b - 139)
                at += 1
            elif 247 <= b <= 254:
                held.append((b - 247) * 256 + self.data[at + 1] + 108 if b <= 250 else -(b - 251) * 256 - self.data[at + 1] - 108)
                at += 2
            else:
                at += 1
        return out

    def read(self) -> None:
        _, at = self.index(self.number(2, 1))
        tops, at = self.index(at)
        strings, _ = self.index(at)
        top = self.dictionary(*tops[0])
        glyphs = len(self.index(int(top[17][0]))[0])
        self.wide = 1230 in top

        def name(sid: int) -> str | int:
            if self.wide:
                return sid
            if sid < OWN_NAMES:
                return STANDARD[sid] if sid < len(STANDARD) else "�"
            begin, end = strings[sid - OWN_NAMES]
            from .pdf import glyph

            return glyph(self.data[begin:end].decode("latin-1"))

        sids = self.charset(int(top.get(15, [0])[0]), glyphs)
        for i, sid in enumerate(sids):
            try:
                self.names[i] = name(sid)
            except IndexError:
                continue
        if not self.wide:
            self.encoding(int(top.get(16, [0])[0]), sids)

    def charset(self, at: int, glyphs: int) -> list[int]:
        if at <= 2:
            return list(range(glyphs)) if at == 0 else [0]
        out, kind = [0], self.number(at, 1)
        at += 1
        while len(out) < glyphs and at < len(self.data):
            if kind == 0:
                out.append(self.short(at))
                at += 2
            else:
                first, left = self.short(at), self.number(at + 2, kind)
                out.extend(range(first, first + left + 1))
                at += 2 + kind
        return out[:glyphs]

    def encoding(self, at: int, sids: list[int]) -> None:
        if at <= 1:
            places = {text: i for i, text in self.names.items()}
            self.codes = {code: places[text] for code, text in STANDARD_CODES.items() if text in places} if at == 0 else {}
            return
        kind, n = self.number(at, 1), self.number(at + 1, 1)
        glyph, place = 1, at + 2
        for _ in range(n):
            first, left = self.number(place, 1), self.number(place + 1, 1) if kind & 127 else 0
            for k in range(left + 1):
                self.codes[first + k] = glyph
                glyph += 1
            place += 2 if kind & 127 else 1
        if kind & 128:
            places = {sid: i for i, sid in enumerate(sids)}
            for i in range(self.number(place, 1)):
                sid = self.short(place + 2 + 3 * i)
                if sid in places:
                    self.codes[self.number(place + 1 + 3 * i, 1)] = places[sid]


def type1_codes(data: bytes) -> dict[int, str]:
    """Code to characters, by the encoding that a Type 1 program states."""
    from .pdf import glyph

    clear = data[: data.find(b"eexec")] if b"eexec" in data else data[: 1 << 16]
    if re.search(rb"/Encoding\s+StandardEncoding\b", clear):
        return dict(STANDARD_CODES)
    found = re.findall(rb"dup\s+(\d+|8#[0-7]+|16#[0-9A-Fa-f]+)\s*/([^\s/()<>\[\]{}]+)\s+put", clear)
    numbers = [int(n.split(b"#")[1], int(n.split(b"#")[0])) if b"#" in n else int(n) for n, _ in found]
    return {n: glyph(name.decode("latin-1")) for n, (_, name) in zip(numbers, found, strict=True) if name != b".notdef"}


# --- what a font entry of a file knows --------------------------------------


class Embedded:
    """Characters and widths of an embedded program, by code (simple fonts) or by CID (``wide``)."""

    def __init__(self, kind: str, data: bytes, wide: bool, glyph_of: dict[int, int] | None = None):
        self.texts: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        try:
            if kind == "FontFile":
                self.texts = type1_codes(data)
            elif data[:4] in (b"\0\1\0\0", b"true", b"ttcf"):
                self.from_truetype(TrueType(data), wide, glyph_of)
            elif data[:4] == b"OTTO":
                outer = TrueType(data)
                at, size = outer.tables.get(b"CFF ", (0, 0))
                if wide and outer.characters:
                    self.from_truetype(outer, wide, glyph_of)
                else:
                    self.from_cff(Cff(data[at : at + size]), wide)
            else:
                self.from_cff(Cff(data), wide)
        except (struct.error, LookupError, ValueError, TypeError, OverflowError):
            pass
        self.texts = {code: text for code, text in self.texts.items() if text and text != "�"}

    def from_truetype(self, font: TrueType, wide: bool, glyph_of: dict[int, int] | None) -> None:
        codes = ({g: g for g in {*font.characters, *font.widths}} if glyph_of is None else glyph_of) if wide else font.codes
        self.texts = {code: font.characters[g] for code, g in codes.items() if g in font.characters}
        self.widths = {code: font.widths[g] for code, g in codes.items() if g in font.widths}

    def from_cff(self, font: Cff, wide: bool) -> None:
        if font.wide:
            return  # a collection's own numbers: no characters
        names = {g: str(n) for g, n in font.names.items()}
        self.texts = names if wide else {code: names[g] for code, g in font.codes.items() if g in names}
