"""Widths and descriptors of the standard fonts, and the width of strings in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Advances of the characters from the blank to the tilde, in thousandths of an em, as the fonts' published
# metrics state them.
_HELVETICA = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 "
    "1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 "
    "333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
_HELVETICA_BOLD = (
    "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 "
    "975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 "
    "333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
)
_TIMES = (
    "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 "
    "921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 "
    "333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
)
#: The fourteen names.
FONTS = (
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique",
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Symbol", "ZapfDingbats",
)
_TABLES = {"Helvetica": _HELVETICA, "Helvetica-Oblique": _HELVETICA, "Helvetica-Bold": _HELVETICA_BOLD, "Helvetica-BoldOblique": _HELVETICA_BOLD, "Times-Roman": _TIMES}
#: Ascent, descent and cap height by family.
_HEIGHTS = {"Helvetica": (718, -207, 718), "Courier": (629, -157, 562), "Times": (683, -217, 662)}
#: The width of characters that a font's table doesn't hold.
DEFAULT = 500


def known_fonts() -> list[str]:
    return list(FONTS)


def widths(font: str) -> dict[str, int]:
    """Characters with their advances; all of Courier's are 600. Fonts without a table here have none."""
    if font.startswith("Courier"):
        return {chr(c): 600 for c in range(32, 127)}
    return {chr(32 + k): int(w) for k, w in enumerate(_TABLES.get(font, "").split())}


def descriptor(font: str) -> dict[str, float] | None:
    """Ascent, descent, cap height, slant and pitch of a standard font of text; None for other names."""
    heights = _HEIGHTS.get(font.split("-")[0])
    if font not in FONTS or heights is None:
        return None
    slanted = "Oblique" in font or "Italic" in font
    return {"ascent": heights[0], "descent": heights[1], "cap_height": heights[2], "italic_angle": (-15.5 if font.startswith("Times") else -12.0) if slanted else 0.0, "fixed_pitch": font.startswith("Courier"), "bold": "Bold" in font}


def char_width(c: Column, font: str) -> Column:
    """The advance of a character."""
    table = F.create_map(*(F.lit(x) for kv in widths(font).items() for x in kv)) if widths(font) else F.lit(None)
    return F.coalesce(table[c], F.lit(DEFAULT)) if widths(font) else F.lit(DEFAULT)


def string_units(text: Column, font: str = "Helvetica") -> Column:
    """The sum of a text's advances, in thousandths of an em, by one look at each of its characters."""
    table = np.full(128, DEFAULT, dtype=np.int64)
    for c, w in widths(font).items():
        table[ord(c)] = w

    @F.pandas_udf("long")
    def units(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            if t is None:
                return None
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
            plain = codes[codes < 128]
            return int(table[plain].sum()) + DEFAULT * (len(codes) - len(plain))

        return pd.Series([one(t) for t in texts], dtype="Int64")

    return units(text)


def measure(text: Column, size: Column, font: str = "Helvetica", char_spacing: float = 0.0, word_spacing: float = 0.0, scale: float = 100.0) -> Column:
    """The width of a text at a size, with spacing after each character and each blank, scaled horizontally."""
    blanks = F.length(text) - F.length(F.translate(text, " ", ""))
    return (string_units(text, font) * size / 1000 + F.length(text) * char_spacing + blanks * word_spacing) * (scale / 100)
