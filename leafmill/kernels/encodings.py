"""Glyph names and the byte encodings of simple fonts.

Names of accented letters follow from a letter's decomposition, names of Greek letters from their Unicode names; only
signs and irregular letters are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

# Glyph names of signs and irregular letters, and their characters.
_ASCII_NAMES = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at"
).split()
_ASCII_TAIL = "bracketleft backslash bracketright asciicircum underscore grave".split(), "braceleft bar braceright asciitilde".split()
_SIGNS = {
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
    "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷",
    "AE": "Æ", "ae": "æ", "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "Dcroat": "Đ",
    "dcroat": "đ", "dotlessi": "ı", "Hbar": "Ħ", "hbar": "ħ", "Eng": "Ŋ", "eng": "ŋ", "IJ": "Ĳ", "ij": "ĳ", "kgreenlandic": "ĸ", "longs": "ſ", "florin": "ƒ", "fi": "ﬁ", "fl": "ﬂ", "fraction": "⁄",
    "bullet": "•", "dagger": "†", "daggerdbl": "‡", "ellipsis": "…", "emdash": "—", "endash": "–", "guilsinglleft": "‹", "guilsinglright": "›", "perthousand": "‰", "quotedblbase": "„",
    "quotedblleft": "“", "quotedblright": "”", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "trademark": "™", "Euro": "€", "minus": "−", "circumflex": "ˆ", "tilde": "˜", "breve": "˘",
    "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂", "summation": "∑",
    "product": "∏", "integral": "∫", "radical": "√", "approxequal": "≈", "lozenge": "◊", "Delta": "∆", "Omega": "Ω", "sigma1": "ς",
}
_ACCENTS = {0x300: "grave", 0x301: "acute", 0x302: "circumflex", 0x303: "tilde", 0x304: "macron", 0x306: "breve", 0x307: "dotaccent", 0x308: "dieresis", 0x30A: "ring", 0x30B: "hungarumlaut", 0x30C: "caron", 0x327: "cedilla", 0x328: "ogonek"}
#: Letters whose cedilla is called a comma.
_COMMA = frozenset("GKLNRTgklnrt")

# The codes of the standard encoding above ASCII, by glyph name, from the code before the names on; and the
# codes of the document encoding that differ from Latin-1.
_STANDARD = {
    161: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl", 177: "endash dagger daggerdbl periodcentered",
    182: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 191: "questiondown", 193: "grave acute circumflex tilde macron breve dotaccent dieresis", 202: "ring cedilla",
    205: "hungarumlaut ogonek caron emdash", 225: "AE", 227: "ordfeminine", 232: "Lslash Oslash OE ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash oslash oe germandbls",
}
_DOCUMENT = {
    24: "breve caron circumflex dotaccent hungarumlaut ogonek ring tilde",
    128: "bullet dagger daggerdbl ellipsis emdash endash florin fraction guilsinglleft guilsinglright minus perthousand quotedblbase quotedblleft quotedblright quoteleft quoteright quotesinglbase trademark fi fl Lslash OE Scaron Ydieresis Zcaron dotlessi lslash oe scaron zcaron",
    160: "Euro",
}
ENCODINGS = ("StandardEncoding", "WinAnsiEncoding", "MacRomanEncoding", "PDFDocEncoding")


def remember(f: Callable) -> Callable:
    """Results by arguments. Unlike the library's caches, functions wrapped so travel to executors by value."""
    kept: dict = {}

    def run(*args):
        if args not in kept:
            kept[args] = f(*args)
        return kept[args]

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@remember
def names() -> dict[str, str]:
    """Characters by glyph name."""
    out = {n: chr(32 + k) for k, n in enumerate(_ASCII_NAMES)}
    out |= {n: chr(91 + k) for k, n in enumerate(_ASCII_TAIL[0])} | {n: chr(123 + k) for k, n in enumerate(_ASCII_TAIL[1])}
    out |= {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    for code in [*range(0xC0, 0x180), 0x218, 0x219, *range(0x1E80, 0x1E86), 0x1EF2, 0x1EF3]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and ord(parts[1]) in _ACCENTS:
            comma = ord(parts[1]) == 0x327 and parts[0] in _COMMA
            out[parts[0] + ("commaaccent" if comma else _ACCENTS[ord(parts[1])])] = chr(code)
    out |= {"Scommaaccent": "Ș", "scommaaccent": "ș"}
    for code in range(0x386, 0x3CF):
        name = unicodedata.name(chr(code), "")
        if name.startswith("GREEK") and " LETTER " in name:
            word = name.split(" LETTER ")[1].lower().replace("lamda", "lambda").replace("dialytika", "dieresis").replace(" with ", " ").replace(" and ", " ").replace(" ", "")
            if not word.startswith("final"):
                out[word.capitalize() if "CAPITAL" in name else word] = chr(code)
    return out | _SIGNS


@remember
def glyph_of() -> dict[str, str]:
    """The glyph name of each character that has one."""
    return {c: n for n, c in reversed(names().items())}


@remember
def table(encoding: str) -> dict[int, str]:
    """Characters by code of an encoding; codes without a glyph have none."""
    if encoding == "WinAnsiEncoding":
        out = {i: bytes((i,)).decode("cp1252", "ignore") for i in range(32, 256)}
        return {i: c for i, c in out.items() if c and i != 127} | {160: " ", 173: "-"}
    if encoding == "MacRomanEncoding":
        return {i: bytes((i,)).decode("mac_roman") for i in range(32, 256) if i != 127} | {202: " ", 219: "¤"}
    if encoding == "PDFDocEncoding":
        out = {i: chr(i) for i in [*range(32, 127), *range(161, 256)] if i != 173}
        rows = _DOCUMENT
    elif encoding == "StandardEncoding":
        out = {i: chr(i) for i in range(32, 127)} | {39: "’", 96: "‘"}
        rows = _STANDARD
    else:
        raise ValueError(f"unknown encoding: {encoding}")
    return out | {at + k: names()[n] for at, found in rows.items() for k, n in enumerate(found.split())}


def from_name(name: str | None) -> str | None:
    """The encoding that a font names, or None."""
    return name if name in ENCODINGS else None


def byte_to_glyph(encoding: str, code: int) -> str | None:
    """The name of the glyph that a code shows."""
    c = table(encoding).get(code)
    return None if c is None else glyph_of().get(c)
