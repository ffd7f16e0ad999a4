"""Kernels against known answers and round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.kernels import charsets, codecs, crypto, images, pdf, pdf_write


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000))
def test_codecs_round_trip(data):
    for enc, dec in codecs.CODECS.values():
        assert dec(enc(data)) == data
    for early in (0, 1):
        assert codecs.lzw_decode(codecs.lzw_encode(data, early), early) == data


def test_codecs_known_answers():
    assert codecs.lzw_encode(bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])).hex() == "800b6050220c0c8501"
    assert codecs.asciihex_decode(b"48 65 6C 6C 6F 7>junk") == b"Hellop"
    assert codecs.runlength_decode(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    assert codecs.ascii85_encode(b"Man ") == b"9jqo^~>"
    assert codecs.apply_filters(["Unknown"], b"x") == b""
    assert codecs.apply_filters(["A85", "Fl"], codecs.ascii85_encode(codecs.flate_encode(b"text"))) == b"text"
    assert codecs.undo_predictor(bytes([2, 1, 2, 2, 1, 1]), 12, 1, 8, 2) == bytes([1, 2, 2, 3])
    big = bytes(range(256)) * 300
    assert codecs.lzw_decode(codecs.lzw_encode(big)) == big


def test_crypto_known_answers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    assert crypto.aes_cbc_encrypt(key, iv, bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), pad=False).hex() == "7649abac8119b246cee98e9b12e9197d"
    for n in (15, 16, 17):
        assert crypto.aes_cbc_decrypt(key, iv, crypto.aes_cbc_encrypt(key, iv, b"a" * n)) == b"a" * n
    with pytest.raises(ValueError):
        crypto.aes_cbc_encrypt(key, iv, b"short", pad=False)


@pytest.mark.parametrize(("r", "bits"), [(2, 40), (3, 128), (4, 128), (5, 256), (6, 256)])
def test_passwords(r, bits):
    entries = crypto.encrypt_entries(b"user", b"owner", r, bits, -44, b"0123456789abcdef", bytes(range(32)), bytes(range(32)))
    who, key = crypto.authenticate(entries, b"user", b"0123456789abcdef")
    assert who == "user"
    assert crypto.authenticate(entries, b"owner", b"0123456789abcdef") == ("owner", key)
    assert crypto.authenticate(entries, b"wrong", b"0123456789abcdef") is None
    assert crypto.crypt("V2", key, 7, 0, crypto.crypt("V2", key, 7, 0, b"text")) == b"text"


def test_charsets():
    assert charsets.cp1252_bytes("€é中") == b"\x80\xe9?"
    assert charsets.cp1252_text(b"\x80\x81") == "€�"
    assert charsets.utf16_text(b"A\0\0\xd8B\0") == "A�B"


def sample():
    return pdf_write.from_pages([["Hello", "Wörld €"], ["two (a) \\ b"], []], info={"Title": "Tést"}, outline=[(0, "A"), (1, "A1"), (1, "A2"), (0, "B")])


def texts(data):
    doc = pdf.Document.open(data)
    return [pdf.page_text(doc, p) for p in doc.pages()]


def test_document_round_trip():
    doc = pdf.Document.open(sample())
    assert texts(sample()) == ["Hello\nWörld €", "two (a) \\ b", ""]
    assert doc.outline() == [(0, "A"), (1, "A1"), (1, "A2"), (0, "B")]
    assert not doc.recovered
    assert pdf.Document.open(pdf_write.empty_document()).pages() == []


def test_damaged_cross_references_are_rebuilt():
    broken = sample().replace(b"startxref", b"startxrfe")
    assert pdf.Document.open(broken).recovered
    assert texts(broken) == texts(sample())


def test_updates_and_page_sets():
    changed = pdf_write.append(sample(), {3: {"Type": pdf.Name("Font"), "X": 1}})
    assert pdf.Document.open(changed).objects[3][1]["X"] == 1
    assert texts(changed) == texts(sample())
    assert texts(pdf_write.compact(changed)) == texts(sample())
    assert texts(pdf_write.assemble([(sample(), [2]), (sample(), [1])])) == ["two (a) \\ b", "Hello\nWörld €"]
    with pytest.raises(ValueError):
        pdf_write.assemble([(sample(), [9])])


def test_grammar():
    assert pdf.operations(b"BT /F#201 12 Tf (a\\(b\\101) Tj [(x) -2 <4>] TJ BI /W 2 ID abcd EI Q") == [
        ("BT", []), ("Tf", ["F 1", 12]), ("Tj", [b"a(bA"]), ("TJ", [[b"x", -2, b"@"]]), ("INLINE_IMAGE", [{"W": 2}]), ("Q", []),
    ]
    assert pdf.canonical(pdf.Reader(b"[1 2 0 R 3 /name <737472> << /b 1 /a true /b 2 >>]").value()) == "[ 1 2 0 R 3 /name <737472> << /a true /b 1 >> ]"
    cmap = pdf.CMap(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0002> <0041> endbfchar beginbfrange <0003> <0005> <0061> <0006> <0007> [<0078> <0079>] endbfrange")
    assert cmap.decode(bytes([0, 2, 0, 3, 0, 5, 0, 7])) == "Aacy"
    assert [pdf.glyph_text(n) for n in ("A_B.alt", "uni00410042", "u1F600", "nope", "germandbls")] == ["AB", "AB", "\U0001f600", "", "ß"]


def test_images():
    rng = np.random.default_rng(1)
    rgba = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    rgba[:, :, 3] = 255
    raw = rgba.tobytes()
    assert images.png_decode(images.png_encode(7, 5, raw)) == (7, 5, raw)
    assert images.bmp_decode(images.bmp_encode(7, 5, raw)) == (7, 5, raw)
    assert images.tiff_decode(images.tiff_encode([(7, 5, raw), (7, 5, raw)])) == [(7, 5, raw)] * 2
    palette, index = images.quantise(raw, 256)
    assert images.psnr(np.array(palette, dtype=np.uint8)[index].tobytes(), rgba[:, :, :3].tobytes()) > 50
    assert len(images.quantise(raw, 4)[0]) == 4
    grey = np.full((20, 20), 200, dtype=np.uint8)
    grey[5, 5] = 10
    black = images.threshold(grey)
    assert black[5, 5] and black.sum() == 1
    px = np.frombuffer(images.fill_rects(4, 4, [(1, 1, 2.5, 3, (0, 0, 0))]), dtype=np.uint8).reshape(4, 4, 4)
    assert px[1, 1, 0] == 0 and px[1, 2, 0] == 128 and px[0, 0, 0] == 255


@pytest.mark.parametrize("revision", [2, 3, 4, 5, 6])
def test_encrypted_documents(revision):
    locked = pdf_write.encrypt(sample(), b"user", b"owner", revision)
    for password in (b"user", b"owner"):
        doc = pdf.Document.open(locked, password)
        assert [pdf.page_text(doc, p) for p in doc.pages()] == texts(sample())
    with pytest.raises(ValueError):
        pdf.Document.open(locked, b"wrong")
    assert texts(pdf_write.decrypt(locked, b"owner")) == texts(sample())
