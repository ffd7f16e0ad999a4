"""Fax coding of bilevel rasters: one-dimensional (Group 3), two-dimensional (Group 4) and, on reading, mixed lines.

A line is handled as the ascending places where its colour changes, beginning with white; rasters are packed rows, most
significant bit first. White is the bit 1 unless ``black_is_1``.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

# The codes of white and black runs of 0 to 63, of 64 to 1728 by steps of 64, and of 1792 to 2560 for both.
_WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 "
    "0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 "
    "00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 "
    "01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
)
_WHITE_LONG = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 "
    "011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
)
_BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 "
    "00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 "
    "000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 "
    "000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 "
    "000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 "
    "000000101100 000001011010 000001100110 000001100111"
)
_BLACK_LONG = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 "
    "0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 "
    "0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
_LONGEST = (
    "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 "
    "000000011101 000000011110 000000011111"
)
#: The modes of two-dimensional lines; a number is the distance from the change above.
_MODES = {"pass": "0001", "runs": "001", 0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
_EOL = "000000000001"


def _codes(short: str, long: str) -> dict[int, str]:
    return dict(enumerate(short.split())) | {64 * k: c for k, c in enumerate((long + " " + _LONGEST).split(), 1)}


RUNS = _codes(_WHITE, _WHITE_LONG), _codes(_BLACK, _BLACK_LONG)
_LENGTHS = tuple({c: n for n, c in codes.items()} for codes in RUNS)
_MODE_OF = {c: m for m, c in _MODES.items()}


def _read(table: dict, bits: str, at: int) -> tuple[object, int]:
    for n in range(1, 14):
        if (found := table.get(bits[at : at + n])) is not None:
            return found, at + n
    raise ValueError(f"no code at bit {at}")


def _read_run(bits: str, at: int, colour: int) -> tuple[int, int]:
    total, part = 0, 64
    while part >= 64:
        part, at = _read(_LENGTHS[colour], bits, at)
        total += part
    return total, at


def _write_run(n: int, colour: int) -> str:
    out = ""
    while n >= 2560 + 64:
        out, n = out + RUNS[colour][2560], n - 2560
    if n >= 64:
        out, n = out + RUNS[colour][n // 64 * 64], n % 64
    return out + RUNS[colour][n]


def _above(ref: list[int], a0: int, colour: int, columns: int) -> tuple[int, int]:
    """The next change of the line above to the other colour, right of ``a0``, and the one after it."""
    k = bisect_right(ref, a0)
    k += k % 2 != colour
    return (ref[k] if k < len(ref) else columns), (ref[k + 1] if k + 1 < len(ref) else columns)


def _changes(row: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(row, prepend=np.uint8(0))).tolist()


def _row(changes: list[int], columns: int) -> np.ndarray:
    """Black pixels as 1."""
    row = np.zeros(columns, dtype=np.uint8)
    for a, b in zip(changes[::2], [*changes[1::2], columns], strict=False):
        row[a:b] = 1
    return row


def _plain_line(bits: str, at: int, columns: int) -> tuple[list[int], int]:
    out, x, colour = [], 0, 0
    while x < columns:
        n, at = _read_run(bits, at, colour)
        x, colour = x + n, 1 - colour
        out.append(x)
    if x > columns:
        raise ValueError("a line is too long")
    return out, at


def _coded_line(bits: str, at: int, columns: int, ref: list[int]) -> tuple[list[int], int]:
    out, a0, colour = [], -1, 0
    while a0 < columns:
        mode, at = _read(_MODE_OF, bits, at)
        b1, b2 = _above(ref, a0, colour, columns)
        if mode == "pass":
            a0 = b2
        elif mode == "runs":
            first, at = _read_run(bits, at, colour)
            second, at = _read_run(bits, at, 1 - colour)
            start = max(a0, 0) + first
            a0 = start + second
            out += [start, a0]
        else:
            if b1 + mode < max(a0, 0):
                raise ValueError("a change lies before the last one")
            a0, colour = b1 + mode, 1 - colour
            out.append(a0)
    if a0 > columns:
        raise ValueError("a line is too long")
    return out, at


def decode(data: bytes, columns: int = 1728, rows: int = 0, k: int = 0, black_is_1: bool = False, end_of_line: bool = False, byte_align: bool = False, end_of_block: bool = True) -> bytes:
    """The packed rows of a stream; ``rows`` 0 takes lines up to the end of the block or of the data. Raises on a stream
    without data, on an unknown code and on lines of a wrong length."""
    if columns <= 0 or not data:
        raise ValueError("no columns or no data")
    bits = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}"
    tag = "1" if k > 0 else ""
    # marks of lines that are padded to bytes can look like two in a row
    end = (_EOL + tag) * (3 if byte_align and k >= 0 else 2)
    at, out, ref = 0, [], []
    while (not rows or len(out) < rows) and bits.find("1", at) >= 0:
        if end_of_block and bits.startswith(end, at):
            break
        marked = k >= 0 and (end_of_line or not byte_align) and bits.startswith("0" * 11, at)
        if marked:
            at = bits.find("1", at) + 1
            if end_of_block and bits.startswith(tag + end, at):
                break
        elif end_of_line and k >= 0:
            raise ValueError("a line's mark is missing")
        two = k < 0
        if k > 0 and marked:
            two, at = bits[at : at + 1] == "0", at + 1
        if byte_align:
            at = -(-at // 8) * 8
            if end_of_block and bits.startswith(end, at):
                break
        changes, at = _coded_line(bits, at, columns, ref) if two else _plain_line(bits, at, columns)
        row = _row(changes, columns)
        ref = _changes(row)
        out.append(row)
    if rows and len(out) < rows and not end_of_block:
        raise ValueError("the data end before the last line")
    if not out:
        return b""
    pixels = np.stack(out)
    return np.packbits(pixels if black_is_1 else 1 - pixels, axis=1).tobytes()


def encode(data: bytes, columns: int, rows: int, k: int = -1, black_is_1: bool = False, end_of_line: bool = False, byte_align: bool = False, end_of_block: bool = True) -> bytes:
    """Packed rows as a stream: two-dimensional for a negative ``k``, one-dimensional for 0."""
    wide = (columns + 7) // 8
    if k > 0 or columns <= 0 or len(data) < wide * rows:
        raise ValueError("mixed lines, no columns or too few rows")
    pixels = np.unpackbits(np.frombuffer(data[: wide * rows], dtype=np.uint8).reshape(rows, wide), axis=1)[:, :columns]
    out, size, ref = [], 0, []

    def put(code: str) -> None:
        nonlocal size
        out.append(code)
        size += len(code)

    for row in pixels if black_is_1 else 1 - pixels:
        line = _changes(row)
        if k == 0 and end_of_line:
            put(_EOL)
        if byte_align:
            put("0" * (-size % 8))
        if k == 0:
            for i, (a, b) in enumerate(zip([0, *line], [*line, columns], strict=True)):
                put(_write_run(b - a, i % 2))
            continue
        a0, colour = -1, 0
        while a0 < columns:
            (b1, b2), (a1, a2) = _above(ref, a0, colour, columns), _above(line, a0, colour, columns)
            if b2 < a1:
                put(_MODES["pass"])
                a0 = b2
            elif abs(a1 - b1) <= 3:
                put(_MODES[a1 - b1])
                a0, colour = a1, 1 - colour
            else:
                put(_MODES["runs"] + _write_run(a1 - max(a0, 0), colour) + _write_run(a2 - a1, 1 - colour))
                a0 = a2
        ref = line
    if end_of_block:
        put(_EOL * (2 if k < 0 else 6))
    bits = "".join(out)
    return int(bits + "0" * (-len(bits) % 8) or "0", 2).to_bytes((len(bits) + 7) // 8, "big")


def dump(data: bytes, columns: int) -> str:
    """A raster's lines in hexadecimal digits, below its size."""
    wide = (columns + 7) // 8
    rows = [data[i : i + wide] for i in range(0, len(data), wide)]
    return "".join([f"width={columns}\n", f"height={len(rows)}\n", *(f"row {i} {r.hex()}\n" for i, r in enumerate(rows))])
