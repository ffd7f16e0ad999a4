import struct

from leafmill.kernels import render, truetype


def font():
    """A font of a blank, a square and a square moved by (10, 0), for the characters A and B."""
    square = struct.pack(">hhhhh", 1, 0, 0, 100, 100) + struct.pack(">HH", 3, 0) + bytes([1, 1, 1, 1]) + struct.pack(">hhhh", 0, 100, 0, -100) + struct.pack(">hhhh", 0, 0, 100, 0)
    square += b"\0" * (-len(square) % 4)
    moved = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHhh", 3, 1, 10, 0)
    moved += b"\0" * (-len(moved) % 4)
    loca = struct.pack(">4H", 0, 0, len(square) // 2, (len(square) + len(moved)) // 2)
    segments = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 66, 0xFFFF) + struct.pack(">H", 0) + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">HH", (1 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + segments, b"glyf": square + moved, b"head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 30 + struct.pack(">hh", 0, 0),
        b"hhea": b"\0" * 4 + struct.pack(">hh", 800, -200) + b"\0" * 26 + struct.pack(">H", 2), b"hmtx": struct.pack(">HhHh", 500, 0, 600, 0), b"loca": loca, b"maxp": struct.pack(">IH", 0x10000, 3),
    }
    head, body, at = b"", b"", 12 + 16 * len(tables)
    for tag, data in tables.items():
        head += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0) + head + body


def test_font():
    f = truetype.parse(font())
    assert (f.units, f.ascent, f.descent, f.widths) == (1000, 800, -200, [500, 600, 600])
    assert f.cmap == {65: 1, 66: 2}
    assert f.outlines[0] == [] and f.outlines[1] == [[(0, 0, True), (100, 0, True), (100, 100, True), (0, 100, True)]]
    assert f.outlines[2][0][0] == (10, 0, True)
    assert truetype.text_width(f, "AB?", 10) == 17
    ring = truetype.flatten([(0, 0, True), (50, 100, False), (100, 0, True)], 2)
    assert ring == [(0, 0), (50, 50), (100, 0), (0, 0)]
    cover = render.coverage(10, 10, [[(x / 10, y / 10) for x, y, _ in f.outlines[2][0]]])
    assert cover[5, 0] == 0 and cover[5, 5] == 1


def test_character_maps():
    def made(platform, sub):
        return truetype._cmap(struct.pack(">HHHHI", 0, 1, platform, 0, 12) + sub)

    assert made(1, struct.pack(">HHH", 0, 262, 0) + bytes([0, 5]) + bytes(254)) == ({}, {1: 5})
    assert made(3, struct.pack(">HHHHH2H", 6, 14, 0, 65, 2, 7, 0)) == ({65: 7}, {})
    assert made(3, struct.pack(">HHIII", 12, 0, 28, 0, 1) + struct.pack(">III", 0x1F600, 0x1F602, 3)) == ({0x1F600: 3, 0x1F601: 4, 0x1F602: 5}, {})
