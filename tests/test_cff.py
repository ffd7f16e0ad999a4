import struct

import numpy as np
import pytest

from leafmill.kernels import cff, pdf
from test_render import pixels, with_parts


def index(items):
    if not items:
        return b"\0\0"
    ends = [1]
    for x in items:
        ends.append(ends[-1] + len(x))
    return struct.pack(">HB", len(items), 2) + struct.pack(f">{len(ends)}H", *ends) + b"".join(items)


def n(*values):
    return b"".join(b"\x1c" + struct.pack(">h", v) for v in values)


def far(v):
    return b"\x1d" + struct.pack(">i", v)


SQUARE = n(0, 0) + b"\x15" + n(100, 100, -100) + b"\x06"


def font(glyphs, names=("A", "odd"), subrs=(), local=(), wide=False):
    """A font with glyphs for A, for a name of its own, and more."""
    strings = index([b"odd"])
    sids = [{"A": 34, "odd": 391}.get(x, x) for x in names]
    private = n(500) + b"\x14" + n(600) + b"\x15" + n(12) + b"\x13"
    head = b"\1\0\4\1" + index([b"F"])

    def top(*at):
        return (n(391, 391, 0) + b"\x0c\x1e" if wide else b"") + far(at[0]) + b"\x0f" + far(at[1]) + b"\x11" + far(len(private)) + far(at[2]) + b"\x12"

    start = len(head) + len(index([top(0, 0, 0)])) + len(strings) + len(index(list(subrs)))
    charset = b"\0" + struct.pack(f">{len(sids)}H", *sids)
    chars = index([b"\x0e", *glyphs])
    tail = charset + chars + private + index(list(local))
    assert len(private) == 12
    return head + index([top(start, start + len(charset), start + len(charset) + len(chars))]) + strings + index(list(subrs)) + tail


def ring(code, **more):
    return cff.parse(font([code + b"\x0e", b"\x0e"], **more)).glyph(1)


def test_standard_strings():
    names = cff.standard_strings()
    assert len(names) == 229 and (names[1], names[34], names[66], names[149], names[228]) == ("space", "A", "a", "germandbls", "zcaron")


def test_tables():
    f = cff.parse(font([SQUARE + b"\x0e", b"\x0e"]))
    assert f.units == 1000 and f.names == {".notdef": 0, "A": 1, "odd": 2} and f.codes[65] == 1 and f.cids is None
    assert cff.parse(font([b"\x0e", b"\x0e"], names=(7, 9), wide=True)).cids == {0: 0, 7: 1, 9: 2}
    assert cff._dict(b"\x1e\xe2\xa2\x5f\x0c\x07" + bytes((139 + 5,)) + b"\x11" + b"\xfa\x7c\xfe\x7c\x0f") == {1207: [-2.25], 17: [5], 15: [1000, -1000]}
    assert cff._dict(b"\x1e\x0a\x14\x05\x41\xc3\xff\x0c\x07") == {1207: [0.140541e-3]}
    assert cff._charset(b"\0\0\0\1" + struct.pack(">HBHB", 5, 2, 40, 0), 3, 5) == [0, 5, 6, 7, 40]
    assert cff._selected(b"\3" + struct.pack(">H", 2) + struct.pack(">HBHBH", 0, 1, 2, 0, 4), 0, 4) == [1, 1, 0, 0]
    assert cff._encoding(b"\0\0" + bytes((0, 2, 70, 90)), 2, {}) == {70: 1, 90: 2} and cff._encoding(b"\0\0" + bytes((1, 1, 65, 2)), 2, {}) == {65: 1, 66: 2, 67: 3}
    for bad in (b"", b"junk"):
        with pytest.raises(ValueError):
            cff.parse(bad)
    wrapped = b"OTTO" + struct.pack(">HHHH", 1, 0, 0, 0) + struct.pack(">4sIII", b"CFF ", 0, 28, len(font([b"\x0e", b"\x0e"]))) + font([b"\x0e", b"\x0e"])
    assert cff.parse(wrapped).names["odd"] == 2


def test_charstrings():
    square = [[(0, 0), (100, 0), (100, 100), (0, 100)]]
    assert ring(SQUARE) == (500, square)
    # the width lies below the first operator's operands, hints included
    assert ring(n(-400) + SQUARE) == (200, square)
    assert ring(n(-400, 10, 20) + b"\x12" + n(1, 2) + b"\x13\xc0" + SQUARE) == (200, square)
    assert ring(n(-107) + b"\x1d", subrs=[SQUARE + b"\x0b"]) == (500, square)
    assert ring(n(-107) + b"\x0a", local=[SQUARE + b"\x0b"]) == (500, square)
    assert ring(n(0, 0) + b"\x15" + n(50, 50) + b"\x0c\x0a" + n(100, -100) + b"\x06") == (500, square)
    for broken in (n(5) + b"\x0a", n(0, 0) + b"\x15" + b"\x0c\x0a", b"\x05" + n(1, 1) + b"\x05"):
        assert ring(broken)[1] == []
    deep = cff.parse(font([n(-107) + b"\x1d\x0e", b"\x0e"], subrs=[n(-107) + b"\x1d"]))
    assert deep.glyph(1)[1] == []


@pytest.mark.parametrize("code, ends", [
    (n(1, 2, 3, 4, 5, 6) + b"\x08", [(9, 12)]), (n(1, 2, 3, 4) + b"\x1b", [(7, 3)]), (n(9, 1, 2, 3, 4) + b"\x1b", [(7, 12)]), (n(1, 2, 3, 4) + b"\x1a", [(2, 8)]), (n(9, 1, 2, 3, 4) + b"\x1a", [(11, 8)]),
    (n(1, 2, 3, 4) + b"\x1f", [(3, 7)]), (n(1, 2, 3, 4, 5) + b"\x1f", [(8, 7)]), (n(1, 2, 3, 4) + b"\x1e", [(6, 4)]), (n(1, 2, 3, 4, 5) + b"\x1e", [(6, 9)]), (n(1, 2, 3, 4, 5, 6, 7, 8) + b"\x1e", [(6, 4), (17, 19)]),
    (n(1, 2, 3, 4, 5, 6, 7, 8) + b"\x18", [(9, 12), (16, 20)]), (n(7, 8, 1, 2, 3, 4, 5, 6) + b"\x19", [(7, 8), (16, 20)]), (n(*range(1, 13), 50) + b"\x0c\x23", [(9, 12), (36, 42)]), (n(1, 2, 3, 4, 5, 6, 7) + b"\x0c\x22", [(7, 3), (25, 0)]),
    (n(1, 2, 3, 4, 5, 6, 7, 8, 9) + b"\x0c\x24", [(9, 6), (31, 0)]), (n(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 99) + b"\x0c\x25", [(9, 12), (0, 129)]),
])
def test_curves(code, ends):
    points = ring(n(0, 0) + b"\x15" + code)[1][0]
    flat = [(round(x, 6), round(y, 6)) for x, y in points]
    assert flat[-1] == ends[-1] and all(e in flat for e in ends)


def test_accented_glyphs():
    f = cff.parse(font([SQUARE + b"\x0e", n(10, 20, 65, 65) + b"\x0e"]))
    assert f.glyph(2)[1] == [[(0, 0), (100, 0), (100, 100), (0, 100)], [(10, 20), (110, 20), (110, 120), (10, 120)]]


def test_painting():
    name, ref = pdf.Name, pdf.Ref
    shown = {"Type": name("Font"), "Subtype": name("Type1"), "FontDescriptor": ref(6, 0), "Encoding": {"Differences": [66, name("odd")]}}
    wide = {"Type": name("Font"), "Subtype": name("Type0"), "DescendantFonts": [{"Subtype": name("CIDFontType0"), "FontDescriptor": ref(9, 0), "DW": 200}]}
    parts = {5: shown, 6: {"FontFile3": ref(7, 0)}, 7: pdf.Stream({"Subtype": name("Type1C")}, font([n(-400) + SQUARE + b"\x0e", SQUARE + b"\x0e"])), 8: wide, 9: {"FontFile3": ref(10, 0)}, 10: pdf.Stream({}, font([SQUARE + b"\x0e", b"\x0e"], names=(7, 9), wide=True))}
    draw = lambda ops: pixels(with_parts(ops, {"Font": {"F": ref(5, 0), "W": ref(8, 0)}}, parts))
    got = draw(b"BT /F 50 Tf 0 0 Td (AB) Tj ET")
    assert (got[5:, :5] == 0).all() and (got[5:, 10:15] == 0).all() and got.sum() == 255 * 150
    assert (draw(b"BT /W 50 Tf 0 0 Td <00070007> Tj ET") == got).all()
    assert (draw(b"BT /W 50 Tf 0 0 Td <00090001> Tj ET") == np.uint8(255)).all()
