"""Compact fonts: dictionaries, character sets, byte encodings and outlines of their charstrings.

Names of the strings beyond the plain character set (small capitals, old-style figures) are not known; such glyphs have a
name only where the font brings it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from . import encodings

# The standard strings behind the standard encoding's glyphs; the accented letters follow by their names.
_SIGNS = (
    "onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior "
    "registered minus eth multiply threesuperior copyright"
)
_ACCENTED = (
    "Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis Igrave Ntilde "
    "Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute Ydieresis Zcaron"
)
#: Fixed value: the number of standard strings.
STANDARD = 391


@encodings.remember
def standard_strings() -> list[str]:
    """The names of the first standard strings."""
    first = [n for _, n in sorted((c, encodings.byte_to_glyph("StandardEncoding", c)) for c in encodings.table("StandardEncoding")) if n]
    lower = [n[0].lower() + n[1:] for n in _ACCENTED.split()]
    return [".notdef", *first, *_SIGNS.split(), *_ACCENTED.split(), *lower]


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    n = struct.unpack(">H", data[at : at + 2])[0]
    if n == 0:
        return [], at + 2
    size = data[at + 2]
    ends = [int.from_bytes(data[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(n + 1)]
    base = at + 2 + (n + 1) * size
    return [data[base + a : base + b] for a, b in zip(ends, ends[1:], strict=False)], base + ends[-1]


_REAL = "0123456789.EE -"


def _dict(data: bytes) -> dict[int, list[float]]:
    """Operands by operator; those of two bytes count from 1200 on."""
    out: dict[int, list[float]] = {}
    stack: list[float] = []
    at = 0
    while at < len(data):
        b, at = data[at], at + 1
        if b <= 21:
            if b == 12:
                b, at = 1200 + data[at], at + 1
            out[b], stack = stack, []
        elif b == 28 or b == 29:
            n = 2 if b == 28 else 4
            stack.append(int.from_bytes(data[at : at + n], "big", signed=True))
            at += n
        elif b == 30:
            text = ""
            while True:
                pair, at = data[at], at + 1
                for half in (pair >> 4, pair & 15):
                    if half == 15:
                        break
                    text += "E-" if half == 12 else _REAL[half]
                else:
                    continue
                break
            stack.append(float(text or 0))
        elif b <= 246:
            stack.append(b - 139)
        elif b <= 254:
            stack.append((b - 247) * 256 + data[at] + 108 if b <= 250 else -(b - 251) * 256 - data[at] - 108)
            at += 1
    return out


@dataclass
class Font:
    units: float
    charstrings: list[bytes]
    global_subrs: list[bytes]
    #: Local subroutines, default and nominal width of each glyph's part.
    parts: list[tuple[list[bytes], float, float]]
    part_of: list[int]
    names: dict[str, int]
    #: Glyphs by character identifier; None for fonts by name.
    cids: dict[int, int] | None
    codes: dict[int, int] = field(default_factory=dict)

    def glyph(self, g: int) -> tuple[float, list[list[tuple[float, float]]]]:
        """The advance, and closed outlines as points; a glyph that can't be run is empty."""
        run = _Run(self, g)
        try:
            run.call(self.charstrings[g])
        except (IndexError, ZeroDivisionError, ValueError):
            return run.width, []
        return run.width, [r for r in run.rings if len(r) > 1]


def parse(data: bytes) -> Font:
    """A bare font, or the one in an OpenType wrapper."""
    if data[:4] in (b"OTTO", b"\0\1\0\0"):
        for k in range(struct.unpack(">H", data[4:6])[0]):
            tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * k : 28 + 16 * k])
            if tag == b"CFF ":
                return parse(data[at : at + size])
        raise ValueError("there is no compact font in it")
    if len(data) < 4 or data[0] != 1:
        raise ValueError("no compact font")
    _, at = _index(data, data[2])
    tops, at = _index(data, at)
    strings, at = _index(data, at)
    subrs, _ = _index(data, at)
    top = _dict(tops[0])
    glyphs, _ = _index(data, int(top[17][0]))
    n = len(glyphs)

    def part(d: dict) -> tuple[list[bytes], float, float]:
        if 18 not in d:
            return [], 0.0, 0.0
        size, start = map(int, d[18])
        private = _dict(data[start : start + size])
        local = _index(data, start + int(private[19][0]))[0] if 19 in private else []
        return local, private.get(20, [0])[0], private.get(21, [0])[0]

    wide = 1230 in top
    parts, part_of = [part(top)], [0] * n
    if wide and 1236 in top:
        parts = [part(_dict(d)) for d in _index(data, int(top[1236][0]))[0]]
        part_of = _selected(data, int(top[1237][0]), n) if 1237 in top else part_of
    sids = _charset(data, int(top.get(15, [0])[0]), n)

    def name(sid: int) -> str:
        known = standard_strings()
        return known[sid] if sid < len(known) else strings[sid - STANDARD].decode("latin-1") if 0 <= sid - STANDARD < len(strings) else ""

    names = {} if wide else {name(s): g for g, s in reversed(list(enumerate(sids)))}
    scale = top.get(1207, [0.001])[0]
    font = Font(1 / scale if scale else 1000.0, glyphs, subrs, parts, part_of, names, {s: g for g, s in enumerate(sids)} if wide else None)
    if not wide:
        font.codes = _encoding(data, int(top.get(16, [0])[0]), names)
    return font


def _charset(data: bytes, at: int, n: int) -> list[int]:
    if at <= 2:
        return list(range(n))
    form, at, out = data[at], at + 1, [0]
    while len(out) < n:
        first = struct.unpack(">H", data[at : at + 2])[0]
        left = 0 if form == 0 else data[at + 2] if form == 1 else struct.unpack(">H", data[at + 2 : at + 4])[0]
        at += 2 + form
        out += range(first, first + left + 1)
    return out[:n]


def _selected(data: bytes, at: int, n: int) -> list[int]:
    if data[at] == 0:
        return list(data[at + 1 : at + 1 + n])
    count, out = struct.unpack(">H", data[at + 1 : at + 3])[0], [0] * n
    for i in range(count):
        first, part, after = struct.unpack(">HBH", data[at + 3 + 3 * i : at + 8 + 3 * i])
        out[first:after] = [part] * (min(after, n) - first)
    return out


def _encoding(data: bytes, at: int, names: dict[str, int]) -> dict[int, int]:
    if at <= 1:
        found = {c: encodings.byte_to_glyph("StandardEncoding", c) for c in encodings.table("StandardEncoding")}
        return {c: names[n] for c, n in found.items() if n in names}
    form, count = data[at] & 127, data[at + 1]
    if form == 0:
        return {c: g for g, c in enumerate(data[at + 2 : at + 2 + count], 1)}
    out: dict[int, int] = {}
    for i in range(count):
        first, left = data[at + 2 + 2 * i], data[at + 3 + 2 * i]
        for c in range(first, first + left + 1):
            out[c] = len(out) + 1
    return out


class _Run:
    """A charstring at work: its stack, its point and the outlines so far."""

    DEPTH, STEPS = 10, 8

    def __init__(self, font: Font, g: int):
        self.font = font
        self.local, self.width, self.nominal = font.parts[font.part_of[g]]
        self.stack: list[float] = []
        self.rings: list[list[tuple[float, float]]] = []
        self.x = self.y = 0.0
        self.hints, self.sized, self.done = 0, False, False

    def advance(self, extra: bool) -> None:
        """The first operator that empties the stack may bring the width below its own operands."""
        if not self.sized and extra:
            self.width = self.nominal + self.stack.pop(0)
        self.sized = True

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.rings[-1].append((self.x, self.y))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        x0, y0 = self.x, self.y
        x1, y1 = x0 + a, y0 + b
        x2, y2 = x1 + c, y1 + d
        self.x, self.y = x2 + e, y2 + f
        for i in range(1, self.STEPS + 1):
            t = i / self.STEPS
            w = (1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3
            self.rings[-1].append((w[0] * x0 + w[1] * x1 + w[2] * x2 + w[3] * self.x, w[0] * y0 + w[1] * y1 + w[2] * y2 + w[3] * self.y))

    def call(self, code: bytes, depth: int = 0) -> None:
        if depth > self.DEPTH:
            raise ValueError("subroutines lie too deep")
        at, s = 0, self.stack
        while at < len(code) and not self.done:
            b, at = code[at], at + 1
            if b == 28:
                s.append(struct.unpack(">h", code[at : at + 2])[0])
                at += 2
            elif b == 255:
                s.append(struct.unpack(">i", code[at : at + 4])[0] / 65536)
                at += 4
            elif b >= 247:
                s.append((b - 247) * 256 + code[at] + 108 if b <= 250 else -(b - 251) * 256 - code[at] - 108)
                at += 1
            elif b >= 32:
                s.append(b - 139)
            elif b in (10, 29):
                subrs = self.local if b == 10 else self.font.global_subrs
                k = int(s.pop()) + (107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768)
                if not 0 <= k < len(subrs):
                    raise ValueError("there is no such subroutine")
                self.call(subrs[k], depth + 1)
            elif b == 11:
                return
            elif b in (19, 20):
                self.stems()
                at += (self.hints + 7) // 8
            elif b == 12:
                self.other(code[at])
                at += 1
            else:
                self.path(b)

    def stems(self) -> None:
        self.advance(len(self.stack) % 2 == 1)
        self.hints += len(self.stack) // 2
        self.stack.clear()

    def path(self, b: int) -> None:
        s = self.stack
        if b in (1, 3, 18, 23):
            return self.stems()
        if b in (4, 21, 22):
            self.advance(len(s) > (2 if b == 21 else 1))
            dx, dy = (s[0], s[1]) if b == 21 else (s[0], 0) if b == 22 else (0, s[0])
            self.x, self.y = self.x + dx, self.y + dy
            self.rings.append([(self.x, self.y)])
        elif b == 14:
            self.advance(len(s) in (1, 5))
            if len(s) >= 4:
                self.joined(*s[-4:])
            self.done = True
        elif b == 5:
            for i in range(0, len(s) - 1, 2):
                self.line(s[i], s[i + 1])
        elif b in (6, 7):
            for i, v in enumerate(s):
                self.line(*((v, 0) if (i % 2 == 0) == (b == 6) else (0, v)))
        elif b in (8, 24):
            n = len(s) // 6 * 6
            for i in range(0, n, 6):
                self.curve(*s[i : i + 6])
            if b == 24:
                self.line(*s[n : n + 2])
        elif b == 25:
            n = len(s) - 6
            for i in range(0, n - 1, 2):
                self.line(s[i], s[i + 1])
            self.curve(*s[n:])
        elif b in (26, 27):
            side = s.pop(0) if len(s) % 4 else 0
            for i in range(0, len(s) - 3, 4):
                p, q, r, t = s[i : i + 4]
                self.curve(*((side, p, q, r, 0, t) if b == 26 else (p, side, q, r, t, 0)))
                side = 0
        elif b in (30, 31):
            level, i = b == 31, 0
            while len(s) - i >= 4:
                p, q, r, t = s[i : i + 4]
                rest = s[i + 4] if len(s) - i == 5 else 0
                self.curve(*((p, 0, q, r, rest, t) if level else (0, p, q, r, t, rest)))
                level, i = not level, i + 4
        s.clear()
        return None

    def other(self, b: int) -> None:
        s = self.stack
        if b == 35:
            self.curve(*s[:6])
            self.curve(*s[6:12])
        elif b == 34:
            self.curve(s[0], 0, s[1], s[2], s[3], 0)
            self.curve(s[4], 0, s[5], -s[2], s[6], 0)
        elif b == 36:
            self.curve(*s[:5], 0)
            self.curve(s[5], 0, *s[6:8], s[8], -(s[1] + s[3] + s[7]))
        elif b == 37:
            dx, dy = sum(s[0:10:2]), sum(s[1:10:2])
            self.curve(*s[:6])
            self.curve(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))
        else:
            return self.reckon(b)
        s.clear()
        return None

    def reckon(self, b: int) -> None:
        s = self.stack
        one = {9: abs, 14: lambda v: -v, 26: lambda v: v**0.5}
        two = {10: lambda v, w: v + w, 11: lambda v, w: v - w, 12: lambda v, w: v / w, 24: lambda v, w: v * w}
        if b in one:
            s[-1] = one[b](s[-1])
        elif b in two:
            w = s.pop()
            s[-1] = two[b](s[-1], w)
        elif b == 18:
            s.pop()
        elif b == 27:
            s.append(s[-1])
        elif b == 28:
            s[-2:] = s[:-3:-1]
        else:
            raise ValueError(f"unknown operator {b}")

    def joined(self, dx: float, dy: float, base: float, accent: float) -> None:
        """A letter and its accent, both by their standard codes."""
        for code, x, y in ((base, 0, 0), (accent, dx, dy)):
            g = self.font.names.get(encodings.byte_to_glyph("StandardEncoding", int(code)) or "")
            if g is not None:
                part = _Run(self.font, g)
                part.call(self.font.charstrings[g], 5)
                self.rings += [[(px + x, py + y) for px, py in ring] for ring in part.rings]
