"""Baseline JPEG: encoding without subsampling, decoding of sequential Huffman images with any subsampling."""

from __future__ import annotations

import struct

import numpy as np

_N = np.arange(8)
_DCT = np.sqrt(np.where(_N == 0, 1, 2) / 8)[:, None] * np.cos((2 * _N[None] + 1) * _N[:, None] * np.pi / 16)
#: The order of coefficients: diagonals, turning at the edges.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))


def quantisation(quality: int) -> np.ndarray:
    """Steps that grow with frequency, by rule; finer for higher quality (1 to 100)."""
    u, v = np.meshgrid(_N, _N)
    base = 8 + 5 * (u + v)
    return np.clip(np.floor(base * (200 - 2 * quality) / 100 + 0.5), 1, 255).astype(np.int64)


def _size(v: int) -> int:
    return abs(v).bit_length()


class _Bits:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def put(self, value: int, width: int) -> None:
        self.acc, self.n = self.acc << width | value & ((1 << width) - 1), self.n + width
        while self.n >= 8:
            self.n -= 8
            byte = self.acc >> self.n & 255
            self.out.append(byte)
            if byte == 255:
                self.out.append(0)
        self.acc &= (1 << self.n) - 1

    def done(self) -> bytes:
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)
        return bytes(self.out)


#: Code tables of even length: sizes 0 to 11 in 4 bits, runs and sizes in 8.
_DC_SYMBOLS = list(range(12))
_AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]


def encode(width: int, height: int, rgba: bytes, quality: int = 75) -> bytes:
    px = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)[:, :, :3].astype(np.float64)
    px = np.pad(px, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = px[:, :, 0], px[:, :, 1], px[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    q = quantisation(quality)
    rows, cols = px.shape[0] // 8, px.shape[1] // 8
    coded = []
    for p in planes:
        blocks = p.reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3)
        coded.append(np.rint(_DCT @ blocks @ _DCT.T / q).astype(np.int64).reshape(rows, cols, 64)[:, :, ZIGZAG])
    bits, last = _Bits(), [0, 0, 0]
    ac = {s: i for i, s in enumerate(_AC_SYMBOLS)}

    def amount(v: int) -> None:
        n = _size(v)
        if n:
            bits.put(v if v > 0 else v + (1 << n) - 1, n)

    for i in range(rows):
        for j in range(cols):
            for c in range(3):
                block = coded[c][i, j].tolist()
                diff, last[c] = block[0] - last[c], block[0]
                bits.put(_size(diff), 4)
                amount(diff)
                run = 0
                for v in block[1:]:
                    v = max(-1023, min(1023, v))
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        bits.put(ac[0xF0], 8)
                        run -= 16
                    bits.put(ac[run << 4 | _size(v)], 8)
                    amount(v)
                    run = 0
                if run:
                    bits.put(ac[0x00], 8)
    part = lambda mark, body: b"\xff" + bytes((mark,)) + struct.pack(">H", len(body) + 2) + body
    lengths = lambda n, count: bytes(count if k == n else 0 for k in range(1, 17))
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), part(0xDB, b"\0" + bytes(q.reshape(64)[ZIGZAG].tolist())),
        part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0))),
        part(0xC4, b"\x00" + lengths(4, len(_DC_SYMBOLS)) + bytes(_DC_SYMBOLS)), part(0xC4, b"\x10" + lengths(8, len(_AC_SYMBOLS)) + bytes(_AC_SYMBOLS)),
        part(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))), bits.done(), b"\xff\xd9",
    ])


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 16
    for n, count in enumerate(body[:16], 1):
        for _ in range(count):
            out[n, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode(data: bytes) -> tuple[int, int, bytes]:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, quant, huff, restart, adobe = 2, {}, {}, 0, None
    while at < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF or mark == 0 or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide, which = body[k] >> 4, body[k] & 15
                size = 128 if wide else 64
                quant[which] = np.frombuffer(body[k + 1 : k + 1 + size], dtype=">u2" if wide else np.uint8).astype(np.int64)
                k += 1 + size
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                total = sum(body[k + 1 : k + 17])
                huff[body[k]] = _codes(body[k + 1 : k + 17 + total])
                k += 17 + total
        elif mark in (0xC0, 0xC1):
            _, height, width, parts = struct.unpack(">BHHB", body[:6])
            frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)}
        elif mark == 0xC2:
            raise ValueError("progressive images are not read")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            planes = _scan(data, at, width, height, frame, scan, quant, huff, restart)
            break
    return width, height, _colours(planes, width, height, adobe)


def _scan(data, at, width, height, frame, scan, quant, huff, restart) -> list[np.ndarray]:
    hmax, vmax = max(f[0] for f in frame.values()), max(f[1] for f in frame.values())
    cols, rows = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    blocks = {c: np.zeros((rows * frame[c][1], cols * frame[c][0], 64), dtype=np.int64) for c, _, _ in scan}
    acc = have = 0

    def bit() -> int:
        nonlocal acc, have, at
        if not have:
            acc = data[at] if at < len(data) else 0
            at += 2 if acc == 0xFF and data[at + 1 : at + 2] == b"\0" else 1
            have = 8
        have -= 1
        return acc >> have & 1

    def symbol(table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bit()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("a code is unknown")

    def amount(n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | bit()
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    last = dict.fromkeys(blocks, 0)
    for mcu in range(rows * cols):
        if restart and mcu and mcu % restart == 0:
            have = 0
            while at + 1 < len(data) and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
            last = dict.fromkeys(blocks, 0)
        for c, dc, ac in scan:
            h, v, _ = frame[c]
            for k in range(h * v):
                block = blocks[c][mcu // cols * v + k // h, mcu % cols * h + k % h]
                last[c] += amount(symbol(huff[dc]))
                block[0], i = last[c], 1
                while i < 64:
                    s = symbol(huff[16 | ac])
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15:
                        block[i] = amount(s & 15)
                    i += 1
    out = []
    for c, _, _ in scan:
        h, v, q = frame[c]
        b = blocks[c] * quant[q]
        flat = np.zeros_like(b)
        flat[:, :, ZIGZAG] = b
        r, w = flat.shape[:2]
        plane = (_DCT.T @ flat.reshape(r, w, 8, 8) @ _DCT + 128).transpose(0, 2, 1, 3).reshape(r * 8, w * 8)
        out.append(np.repeat(np.repeat(plane, vmax // v, axis=0), hmax // h, axis=1)[:height, :width])
    return out


def _colours(planes: list[np.ndarray], width: int, height: int, adobe: int | None) -> bytes:
    if len(planes) == 1:
        rgb = np.stack(planes * 3, axis=2)
    elif len(planes) == 3 and adobe != 0:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    elif len(planes) == 3:
        rgb = np.stack(planes, axis=2)
    else:
        rgb = np.stack(planes[:3], axis=2) * planes[3][:, :, None] / 255  # inks are stored inverted
    rgb = np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)
    return np.dstack([rgb, np.full((height, width), 255, dtype=np.uint8)]).tobytes()
