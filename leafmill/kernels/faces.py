"""Fonts of documents as they are painted: codes of strings, glyphs, advances and outlines."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import cff, encodings, truetype
from .pdf import Document, Name, Stream, font_encoding

#: The advance of codes without a width, in thousandths of an em.
DEFAULT = 500.0


class Face:
    """A font dictionary with its embedded TrueType or compact program, if it has one that can be read."""

    def __init__(self, doc: Document, font: dict):
        self.wide = doc.get(font.get("Subtype")) == "Type0"
        below = doc.get(font.get("DescendantFonts")) or [] if self.wide else []
        holder = (doc.get(below[0]) if below else font) or {}
        about = doc.get(holder.get("FontDescriptor")) or {}
        self.program: truetype.Font | cff.Font | None = None
        for entry, parse in (("FontFile2", truetype.parse), ("FontFile3", cff.parse)):
            program = doc.get(about.get(entry))
            if isinstance(program, Stream):
                try:
                    self.program = parse(doc.stream_bytes(program))
                except (struct.error, KeyError, IndexError, ValueError):
                    self.program = None
        self.encoding = None if self.wide else font_encoding(doc, font)
        self.named = {} if self.wide else _differences(doc, font)
        self.map = b""
        if self.wide:
            self.widths, self.default = _wide(doc, holder), float(doc.get(holder.get("DW")) or 1000)
            to_glyph = doc.get(holder.get("CIDToGIDMap"))
            self.map = doc.stream_bytes(to_glyph) if isinstance(to_glyph, Stream) else b""
        else:
            first = int(doc.get(font.get("FirstChar")) or 0)
            self.widths = {first + i: float(doc.get(w)) for i, w in enumerate(doc.get(font.get("Widths")) or [])}
            missing = doc.get(about.get("MissingWidth"))
            self.default = None if missing is None else float(missing)

    def glyph(self, code: int) -> int:
        if self.wide:
            if isinstance(self.program, cff.Font) and self.program.cids is not None:
                return self.program.cids.get(code, 0)
            return int.from_bytes(self.map[2 * code : 2 * code + 2], "big") if self.map else code
        font, text = self.program, (self.encoding or {}).get(code, "")
        if isinstance(font, cff.Font):
            found = font.names.get(self.named.get(code) or encodings.glyph_of().get(text, ""))
            return (font.codes.get(code) if found is None else found) or 0
        named = font.cmap.get(ord(text)) if len(text) == 1 else None
        own = font.cmap.get(0xF000 + code) or font.codes.get(code)
        return (named or own if self.encoding else own or font.cmap.get(code)) or 0

    def advance(self, code: int) -> float:
        """In ems."""
        if code in self.widths:
            return self.widths[code] / 1000
        if self.default is None and self.program:
            g = self.glyph(code)
            if isinstance(self.program, cff.Font):
                return self.program.glyph(g)[0] / self.program.units if g < len(self.program.charstrings) else DEFAULT / 1000
            wide = self.program.widths
            return wide[g] / self.program.units if g < len(wide) else DEFAULT / 1000
        return (DEFAULT if self.default is None else self.default) / 1000

    def codes(self, s: bytes) -> Iterator[int]:
        return (int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s) - 1, 2)) if self.wide else iter(s)

    def rings(self, code: int) -> list[list[tuple[float, float]]]:
        """Closed outlines of a code's glyph, in ems."""
        unit, g = self.program.units, self.glyph(code)
        if isinstance(self.program, cff.Font):
            rings = self.program.glyph(g)[1] if g < len(self.program.charstrings) else []
        else:
            rings = map(truetype.flatten, self.program.outlines[g])
        return [[(x / unit, y / unit) for x, y in ring] for ring in rings if ring]


def _differences(doc: Document, font: dict) -> dict[int, str]:
    """Glyph names by code that the font's encoding states itself."""
    enc = doc.get(font.get("Encoding"))
    out: dict[int, str] = {}
    code = 0
    for x in doc.get(enc.get("Differences")) or [] if isinstance(enc, dict) else []:
        if isinstance(x, Name):
            out[code] = str(x)
            code += 1
        elif isinstance(x, int):
            code = x
    return out


def _wide(doc: Document, holder: dict) -> dict[int, float]:
    """Widths of the form ``first [w ...]`` and ``first last w``."""
    out: dict[int, float] = {}
    parts = [doc.get(x) for x in doc.get(holder.get("W")) or []]
    at = 0
    while at + 1 < len(parts):
        if isinstance(parts[at + 1], list):
            out |= {int(parts[at]) + i: float(doc.get(w)) for i, w in enumerate(parts[at + 1])}
            at += 2
        elif at + 2 < len(parts):
            out |= dict.fromkeys(range(int(parts[at]), min(int(parts[at + 1]), 0xFFFF) + 1), float(parts[at + 2]))
            at += 3
        else:
            break
    return out
