"""Raster images: PNG, BMP and TIFF files, palettes, local thresholds and filled rectangles.
An image is (width, height, RGBA bytes)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import ccitt
from .codecs import flate_decode, lzw_decode, runlength_decode, undo_predictor

_PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(width: int, height: int, rgba: bytes, alpha: bool = True) -> bytes:
    px = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)
    px = px if alpha else px[:, :, :3]
    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), px.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> tuple[int, int, bytes]:
    """Not interlaced images of 8 and fewer bits, and of 16 cut to 8."""
    if data[:8] != _PNG:
        raise ValueError("no PNG file")
    at, chunks = 8, {}
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        chunks[kind] = chunks.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += n + 12
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if interlaced:
        raise ValueError("interlaced images are not read")
    parts = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = undo_predictor(zlib.decompress(chunks[b"IDAT"]), 15, parts, bits, w)
    row = (w * parts * bits + 7) // 8
    a = np.frombuffer(raw, dtype=np.uint8).reshape(h, row)
    if bits == 16:
        a = a[:, ::2]
    elif bits < 8:
        a = np.stack([a >> s & ((1 << bits) - 1) for s in range(8 - bits, -1, -bits)], axis=2).reshape(h, -1)[:, : w * parts]
        a = a if colour == 3 else (a.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    a = a.reshape(h, w, parts)
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    if colour == 3:
        palette = np.frombuffer(chunks[b"PLTE"], dtype=np.uint8).reshape(-1, 3)
        out[:, :, :3] = palette[a[:, :, 0]]
        if b"tRNS" in chunks:
            fade = np.full(256, 255, dtype=np.uint8)
            fade[: len(chunks[b"tRNS"])] = np.frombuffer(chunks[b"tRNS"], dtype=np.uint8)
            out[:, :, 3] = fade[a[:, :, 0]]
    elif colour in (0, 4):
        out[:, :, :3] = a[:, :, :1]
        if colour == 4:
            out[:, :, 3] = a[:, :, 1]
    else:
        out[:, :, :parts] = a
    return w, h, out.tobytes()


def bmp_encode(width: int, height: int, rgba: bytes) -> bytes:
    """24 bits, rows from the bottom up, padded to four bytes."""
    px = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)[::-1, :, 2::-1].reshape(height, -1)
    rows = np.pad(px, ((0, 0), (0, -px.shape[1] % 4))).tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def bmp_decode(data: bytes) -> tuple[int, int, bytes]:
    if data[:2] != b"BM":
        raise ValueError("no BMP file")
    start, head = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    w, h, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not read")
    row = (w * bits + 31) // 32 * 4
    a = np.frombuffer(data[start : start + row * abs(h)], dtype=np.uint8).reshape(abs(h), row)[:, : w * bits // 8]
    a = a[::-1] if h > 0 else a
    out = np.full((abs(h), w, 4), 255, dtype=np.uint8)
    if bits == 8:
        palette = np.frombuffer(data[14 + head : start], dtype=np.uint8).reshape(-1, 4)
        out[:, :, :3] = palette[a][:, :, 2::-1]
    else:
        out[:, :, :3] = a.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return w, abs(h), out.tobytes()


def tiff_encode(pages: list[tuple[int, int, bytes]], dpi: int = 72) -> bytes:
    """RGB pages, Deflate, one strip each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for w, h, rgba in pages:
        strip = zlib.compress(np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)[:, :, :3].tobytes())
        at = len(out)
        out += strip + b"\0" * (len(strip) % 2)
        extra = len(out)
        out += struct.pack("<HHH", 8, 8, 8) + b"\0\0" + struct.pack("<II", dpi, 1)
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, extra), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, 1, at), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(strip)), (282, 5, 1, extra + 8), (283, 5, 1, extra + 8), (296, 3, 1, 2)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_encode_bilevel(pages: list[tuple[int, int, bytes]], packing: int = 4, dpi: int = 72) -> bytes:
    """Black and white pages, fax coded (3: one-dimensional, 4: two-dimensional), one strip each. A pixel is black where
    its local threshold says so."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for w, h, rgba in pages:
        grey = np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)[:, :, :3].mean(axis=2).astype(np.uint8)
        black = threshold(grey) & (grey < 255)
        strip = ccitt.encode(np.packbits(black, axis=1).tobytes(), w, h, -1 if packing == 4 else 0, True, end_of_line=packing == 3)
        at = len(out)
        out += strip + b"\0" * (len(strip) % 2)
        extra = len(out)
        out += struct.pack("<II", dpi, 1)
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 1), (259, 3, 1, packing), (262, 3, 1, 0), (273, 4, 1, at), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(strip)), (282, 5, 1, extra), (283, 5, 1, extra), (296, 3, 1, 2)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_decode(data: bytes) -> list[tuple[int, int, bytes]]:
    """Grey, palette and RGB pages of 8 bits, and bilevel ones; strips without compression, LZW, Deflate, PackBits, fax codes."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not e or struct.unpack(e + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    sizes, letters = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}, {1: "B", 2: "B", 3: "H", 4: "I", 5: "Q"}
    out, at, seen = [], struct.unpack(e + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(e + "H", data[at : at + 2])[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            size = sizes.get(kind, 1) * count
            start = at + 10 + 12 * k if size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            if kind in letters:
                tags[tag] = struct.unpack(f"{e}{count}{letters[kind]}", data[start : start + size])
        w, h, packing = tags[256][0], tags[257][0], tags.get(259, (1,))[0]
        bits, parts, kind = tags.get(258, (1,))[0], tags.get(277, (1,))[0], tags.get(262, (1,))[0]
        left = iter(range(h, 0, -tags.get(278, (h,))[0]))
        fax = lambda k, **flags: lambda s: ccitt.decode(s, w, min(next(left), tags.get(278, (h,))[0]), k, True, **flags)  # noqa: E731, B023
        group_3 = 1 if tags.get(292, (0,))[0] & 1 else 0
        unpack = {2: fax(0, byte_align=True, end_of_block=False), 3: fax(group_3), 4: fax(-1), 1: lambda s: s, 5: lambda s: lzw_decode(s, 1), 8: flate_decode, 32946: flate_decode, 32773: lambda s: runlength_decode(s + b"\x80")}[packing]
        raw = b"".join(unpack(data[o : o + c]) for o, c in zip(tags[273], tags[279], strict=True))
        if tags.get(317, (1,))[0] == 2:
            raw = undo_predictor(raw, 2, parts, bits, w)
        row = (w * parts * bits + 7) // 8
        a = np.frombuffer(raw[: row * h], dtype=np.uint8).reshape(h, row)
        if bits == 1:
            a = np.unpackbits(a, axis=1)[:, : w * parts] * np.uint8(255)
        a = a.reshape(h, w, parts)
        page = np.full((h, w, 4), 255, dtype=np.uint8)
        if kind == 3:
            page[:, :, :3] = (np.array(tags[320], dtype=np.uint32).reshape(3, -1).T >> 8).astype(np.uint8)[a[:, :, 0]]
        elif kind == 2:
            page[:, :, : min(parts, 4)] = a[:, :, :4]
        else:
            page[:, :, :3] = a[:, :, :1] if kind == 1 else 255 - a[:, :, :1]
        out.append((w, h, page.tobytes()))
        at = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return out


def quantise(rgba: bytes, colours: int = 256) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Median cut: the bucket with the widest channel is split at its median until there are enough; a bucket's
    colour is its truncated mean, and each pixel takes the nearest, ties to the lowest index."""
    px = np.frombuffer(rgba, dtype=np.uint8).reshape(-1, 4)[:, :3].astype(np.int64)
    distinct, back, count = np.unique(px, axis=0, return_inverse=True, return_counts=True)
    buckets = [np.arange(len(distinct))]
    while len(buckets) < colours:
        spread = [np.ptp(distinct[b], axis=0) if len(b) > 1 else np.zeros(3, dtype=np.int64) for b in buckets]
        k = int(np.argmax([s.max() for s in spread]))
        if spread[k].max() == 0:
            break
        b = buckets[k][np.argsort(distinct[buckets[k], int(np.argmax(spread[k]))], kind="stable")]
        half = int(np.searchsorted(np.cumsum(count[b]), count[b].sum() / 2)) + 1
        half = min(max(half, 1), len(b) - 1)
        buckets[k : k + 1] = [b[:half], b[half:]]
    palette = np.array([(distinct[b] * count[b, None]).sum(axis=0) // count[b].sum() for b in buckets])
    near = np.concatenate([((part[:, None, :] - palette[None]) ** 2).sum(axis=2).argmin(axis=1) for part in np.array_split(distinct, max(1, len(distinct) // 4096))])
    return [tuple(map(int, c)) for c in palette], near[back.ravel()]


def threshold(grey: np.ndarray, window: int | None = None, percent: int = 15) -> np.ndarray:
    """Local thresholds by sums over windows: black (True) where a pixel, times the window's pixels, is at most
    its sum less ``percent``; windows are cut at the edges."""
    h, w = grey.shape
    half = max(2, w // 8 if window is None else window) // 2
    total = np.zeros((h + 1, w + 1), dtype=np.int64)
    total[1:, 1:] = grey.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    y0, y1 = np.maximum(np.arange(h) - half, 0)[:, None], np.minimum(np.arange(h) + half, h - 1)[:, None] + 1
    x0, x1 = np.maximum(np.arange(w) - half, 0)[None], np.minimum(np.arange(w) + half, w - 1)[None] + 1
    sums = total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0]
    return grey.astype(np.int64) * ((y1 - y0) * (x1 - x0)) * 100 <= sums * (100 - percent)


def psnr(a: bytes, b: bytes) -> float:
    error = np.mean((np.frombuffer(a, dtype=np.uint8).astype(float) - np.frombuffer(b, dtype=np.uint8)) ** 2)
    return float("inf") if error == 0 else float(10 * np.log10(255**2 / error))


def fill_rects(width: int, height: int, rects: list[tuple[float, float, float, float, tuple[int, int, int]]]) -> bytes:
    """Rectangles on white, with the share of 4 x 4 samples of a pixel that they cover."""
    out = np.full((height, width, 3), 255.0)
    sx, sy = (np.arange(width * 4) + 0.5) / 4, (np.arange(height * 4) + 0.5) / 4
    for x0, y0, x1, y1, colour in rects:
        cover = np.outer(((sy >= y0) & (sy < y1)).reshape(height, 4).mean(axis=1), ((sx >= x0) & (sx < x1)).reshape(width, 4).mean(axis=1))[:, :, None]
        out = out * (1 - cover) + np.array(colour, dtype=float) * cover
    return np.dstack([np.floor(out + 0.5).astype(np.uint8), np.full((height, width), 255, dtype=np.uint8)]).tobytes()
