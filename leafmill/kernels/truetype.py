"""TrueType fonts: metrics, character maps (formats 0, 4, 6 and 12) and glyph outlines, simple and compound."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


class _Outlines(dict):
    """Outlines by glyph, read when asked for."""

    def __init__(self, glyf: bytes, loca: list[int]):
        super().__init__()
        self.glyf, self.loca = glyf, loca

    def __missing__(self, g: int) -> list[list[tuple[float, float, bool]]]:
        self[g] = _outline(self.glyf, self.loca, g)
        return self[g]


@dataclass
class Font:
    units: int
    ascent: int
    descent: int
    widths: list[int]
    cmap: dict[int, int]
    outlines: dict[int, list[list[tuple[float, float, bool]]]] = field(default_factory=lambda: _Outlines(b"", []))
    #: Glyphs by code of the font's own byte encoding.
    codes: dict[int, int] = field(default_factory=dict)


def parse(data: bytes) -> Font:
    n = struct.unpack(">H", data[4:6])[0]
    tables = {}
    for k in range(n):
        tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * k : 28 + 16 * k])
        tables[tag] = data[at : at + size]
    units, wide = struct.unpack(">H", tables[b"head"][18:20])[0], struct.unpack(">h", tables[b"head"][50:52])[0]
    ascent, descent = struct.unpack(">hh", tables[b"hhea"][4:8])
    long_metrics = struct.unpack(">H", tables[b"hhea"][34:36])[0]
    glyphs = struct.unpack(">H", tables[b"maxp"][4:6])[0]
    widths = [struct.unpack(">H", tables[b"hmtx"][4 * k : 4 * k + 2])[0] for k in range(min(long_metrics, glyphs))]
    widths += widths[-1:] * (glyphs - len(widths))
    cmap, codes = _cmap(tables[b"cmap"]) if b"cmap" in tables else ({}, {})
    font = Font(units, ascent, descent, widths, cmap, codes=codes)
    if b"glyf" in tables and b"loca" in tables:
        loca = struct.unpack(f">{glyphs + 1}{'I' if wide else 'H'}", tables[b"loca"][: (glyphs + 1) * (4 if wide else 2)])
        loca = [v if wide else 2 * v for v in loca]
        font.outlines = _Outlines(tables[b"glyf"], loca)
    return font


def _cmap(table: bytes) -> tuple[dict[int, int], dict[int, int]]:
    """Glyphs by character, and by code of a byte encoding."""
    out: dict[int, int] = {}
    codes: dict[int, int] = {}
    for k in range(struct.unpack(">H", table[2:4])[0]):
        platform, _, at = struct.unpack(">HHI", table[4 + 8 * k : 12 + 8 * k])
        kind = struct.unpack(">H", table[at : at + 2])[0]
        found: dict[int, int] = {}
        if kind == 0:
            found = dict(enumerate(table[at + 6 : at + 262]))
        elif kind == 6:
            first, n = struct.unpack(">HH", table[at + 6 : at + 10])
            found = {first + i: g for i, g in enumerate(struct.unpack(f">{n}H", table[at + 10 : at + 10 + 2 * n]))}
        elif kind == 12:
            for i in range(struct.unpack(">I", table[at + 12 : at + 16])[0]):
                first, last, glyph = struct.unpack(">III", table[at + 16 + 12 * i : at + 28 + 12 * i])
                found |= {c: glyph + c - first for c in range(first, min(last, 0x10FFFF) + 1)}
        for code, glyph in found.items():
            if glyph:
                (codes if platform == 1 else out).setdefault(code, glyph)
        if kind != 4:
            continue
        n = struct.unpack(">H", table[at + 6 : at + 8])[0] // 2
        words = lambda start, kind="H": struct.unpack(f">{n}{kind}", table[start : start + 2 * n])  # noqa: E731, B023
        ends, starts = words(at + 14), words(at + 16 + 2 * n)
        deltas, offsets = words(at + 16 + 4 * n), words(at + 16 + 6 * n)
        for i, (first, last, delta, offset) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
            for code in range(first, min(last, 0xFFFE) + 1):
                if offset:
                    spot = at + 16 + 6 * n + 2 * i + offset + 2 * (code - first)
                    glyph = struct.unpack(">H", table[spot : spot + 2])[0]
                    glyph = (glyph + delta) & 0xFFFF if glyph else 0
                else:
                    glyph = (code + delta) & 0xFFFF
                if glyph:
                    (codes if platform == 1 else out).setdefault(code, glyph)
    return out, codes


def _outline(glyf: bytes, loca: list[int], g: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
    """Contours of (x, y, on the curve)."""
    if not 0 <= g < len(loca) - 1 or loca[g] >= loca[g + 1] or depth > 8:
        return []
    d = glyf[loca[g] : loca[g + 1]]
    contours = struct.unpack(">h", d[:2])[0]
    if contours < 0:
        out, at = [], 10
        while True:
            flags, part = struct.unpack(">HH", d[at : at + 4])
            dx, dy = struct.unpack(">hh" if flags & 1 else ">bb", d[at + 4 : at + (8 if flags & 1 else 6)])
            at += 8 if flags & 1 else 6
            a, b, c, e = 1.0, 0.0, 0.0, 1.0
            count = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
            v = [x / 16384 for x in struct.unpack(f">{count}h", d[at : at + 2 * count])]
            at += 2 * count
            if count == 1:
                a = e = v[0]
            elif count == 2:
                a, e = v
            elif count == 4:
                a, b, c, e = v
            dx, dy = (dx, dy) if flags & 2 else (0, 0)
            out += [[(a * x + c * y + dx, b * x + e * y + dy, on) for x, y, on in ring] for ring in _outline(glyf, loca, part, depth + 1)]
            if not flags & 0x20:
                return out
    ends = struct.unpack(f">{contours}H", d[10 : 10 + 2 * contours])
    at = 10 + 2 * contours
    at += 2 + struct.unpack(">H", d[at : at + 2])[0]
    count, flags = (ends[-1] + 1 if ends else 0), []
    while len(flags) < count:
        f = d[at]
        at += 1
        repeat = 1
        if f & 8:
            repeat, at = repeat + d[at], at + 1
        flags += [f] * repeat
    axes = []
    for short, same in ((2, 16), (4, 32)):
        v, values = 0, []
        for f in flags[:count]:
            if f & short:
                v, at = v + (d[at] if f & same else -d[at]), at + 1
            elif not f & same:
                v, at = v + struct.unpack(">h", d[at : at + 2])[0], at + 2
            values.append(v)
        axes.append(values)
    points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags[:count], strict=True)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [points[a : b + 1] for a, b in zip(starts, ends, strict=True)]


def flatten(ring: list[tuple[float, float, bool]], steps: int = 8) -> list[tuple[float, float]]:
    """A contour's quadratic curves as points; between two points off the curve lies one on it."""
    full: list[tuple[float, float, bool]] = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        full.append(p)
        if not p[2] and not q[2]:
            full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True))
    first = next((k for k, p in enumerate(full) if p[2]), None)
    if first is None:
        return []
    full = full[first:] + full[: first + 1]
    out, k = [full[0][:2]], 1
    while k < len(full):
        if full[k][2]:
            out.append(full[k][:2])
            k += 1
        else:
            (x0, y0), (x1, y1), (x2, y2) = out[-1], full[k][:2], full[k + 1][:2]
            for i in range(1, steps + 1):
                t = i / steps
                out.append(((1 - t) ** 2 * x0 + 2 * (1 - t) * t * x1 + t * t * x2, (1 - t) ** 2 * y0 + 2 * (1 - t) * t * y1 + t * t * y2))
            k += 2
    return out


def text_width(font: Font, text: str, size: float) -> float:
    return sum(font.widths[font.cmap.get(ord(c), 0)] for c in text) * size / font.units
