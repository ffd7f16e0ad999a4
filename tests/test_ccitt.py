import numpy as np
import pytest

from leafmill.kernels import ccitt, codecs, images


def test_codes_have_no_common_beginnings():
    for codes in (*ccitt.RUNS, ccitt._MODES):
        found = sorted(codes.values())
        assert len(set(found)) == len(found)
        assert not [1 for a, b in zip(found, found[1:], strict=False) if b.startswith(a)]
    # of the white codes nothing is left but the beginnings of eight zeros and more; of the black ones likewise
    for codes in ccitt.RUNS:
        assert len(codes) == 104 and 1 - sum(2.0 ** -len(c) for c in codes.values()) == pytest.approx(2.0**-8, abs=2.0**-9)


@pytest.mark.parametrize("k", [-1, 0])
@pytest.mark.parametrize("flags", [{}, {"black_is_1": True}, {"end_of_line": True}, {"byte_align": True}, {"end_of_line": True, "byte_align": True}])
def test_round_trips(k, flags):
    draw = np.random.default_rng(5)
    for columns, rows, share in ((1, 1, 0.5), (17, 9, 0.5), (64, 20, 0.05), (2700, 6, 0.0005), (6000, 3, 0.0), (40, 12, 0.97)):
        noise = draw.random((rows, columns)) < share
        noise[1:] |= noise[:-1]
        pixels = np.packbits(noise.astype(np.uint8) if flags.get("black_is_1") else 1 - noise.astype(np.uint8), axis=1)
        data = ccitt.encode(pixels.tobytes(), columns, rows, k, **flags)
        assert ccitt.decode(data, columns, rows, k, **flags) == pixels.tobytes()
        assert ccitt.decode(data, columns, 0, k, **flags) == pixels.tobytes()
        bare = ccitt.encode(pixels.tobytes(), columns, rows, k, end_of_block=False, **flags)
        assert ccitt.decode(bare, columns, rows, k, end_of_block=False, **flags) == pixels.tobytes()


def test_known_lines():
    # eight white pixels; then three white, two black, three white
    assert ccitt.encode(b"\xff", 8, 1, 0, end_of_block=False) == bytes([0b10011000])
    assert ccitt.encode(b"\xe7", 8, 1, 0, end_of_block=False) == bytes([0b10001110, 0b00000000])
    assert ccitt.encode(b"\xff\xff", 8, 2, -1, end_of_block=False) == bytes([0b11000000])
    assert ccitt.encode(b"\xff", 8, 1, -1) == bytes([0b10000000, 0b00001000, 0b00000000, 0b10000000])
    # a line coded by itself, then one coded by that above it
    mixed = "000000000001" + "1" + "1000" + "11" + "1000" + "000000000001" + "0" + "1" + "1" + "1" + ("000000000001" + "1") * 6
    data = int(mixed + "0" * (-len(mixed) % 8), 2).to_bytes((len(mixed) + 7) // 8, "big")
    assert ccitt.decode(data, 8, 0, 4) == b"\xe7\xe7"
    assert ccitt.dump(b"\xe7\xff", 8) == "width=8\nheight=2\nrow 0 e7\nrow 1 ff\n"


def test_errors_and_filters():
    for data, columns in ((b"", 8), (b"\xff", 0), (b"\x01\x01", 8)):
        with pytest.raises(ValueError):
            ccitt.decode(data, columns, 1, 0)
    with pytest.raises(ValueError):
        ccitt.encode(b"\xff", 8, 2)
    with pytest.raises(ValueError):
        ccitt.encode(b"\xff", 8, 1, 3)
    packed = ccitt.encode(b"\xe7\x81", 8, 2)
    assert codecs.apply_filters(["CCITTFaxDecode"], packed, [{"K": -1, "Columns": 8, "Rows": 2}]) == b"\xe7\x81"
    assert codecs.apply_filters(["CCF"], b"\x00\x01", [{"K": -1, "Columns": 8, "Rows": 2}]) == b""


@pytest.mark.parametrize("packing", [3, 4])
def test_tiff(packing):
    black = np.zeros((6, 16), dtype=np.uint8)
    black[1:4, 3:9] = 1
    rgba = np.full((6, 16, 4), 255, dtype=np.uint8)
    rgba[:, :, :3] -= (black * 255)[:, :, None]
    data = images.tiff_encode_bilevel([(16, 6, rgba.tobytes())] * 2, packing)
    assert images.tiff_decode(data) == [(16, 6, rgba.tobytes())] * 2
