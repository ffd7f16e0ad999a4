"""Glyph names, byte encodings, font metrics, big integers, digests, references and dumps against known answers."""

import hashlib
import html
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import bignum, metrics, text
from leafmill.kernels import encodings, pdf, pdf_write
from leafmill.sources import documents


def test_glyph_names():
    names = encodings.names()
    for name, c in {
        "A": "A", "eacute": "é", "Ccedilla": "Ç", "Gcommaaccent": "Ģ", "ntilde": "ñ", "Zcaron": "Ž", "ohungarumlaut": "ő", "alpha": "α", "Lambda": "Λ", "omegatonos": "ώ", "iotadieresistonos": "ΐ", "sigma1": "ς",
        "Euro": "€", "fi": "ﬁ", "zero": "0", "bracketleft": "[", "asciitilde": "~", "grave": "`", "Idotaccent": "İ", "uogonek": "ų", "Wgrave": "Ẁ",
    }.items():
        assert names[name] == c, name
    assert pdf.glyph_text("eacute.alt") == "é" and pdf.glyph_text("f_i") == "fi" and pdf.glyph_text("uni00410042") == "AB" and pdf.glyph_text("nosuch") == ""
    assert all(names[n] == c for c, n in encodings.glyph_of().items())


def test_byte_encodings():
    for encoding, codec in (("WinAnsiEncoding", "cp1252"), ("MacRomanEncoding", "mac_roman")):
        for code, c in encodings.table(encoding).items():
            if (encoding, code) not in {("WinAnsiEncoding", 160), ("WinAnsiEncoding", 173), ("MacRomanEncoding", 202), ("MacRomanEncoding", 219)}:
                assert bytes((code,)).decode(codec) == c
    glyph = encodings.byte_to_glyph
    assert [glyph("StandardEncoding", c) for c in (39, 96, 65, 174, 225, 251, 208, 128)] == ["quoteright", "quoteleft", "A", "fi", "AE", "germandbls", "emdash", None]
    assert [glyph("PDFDocEncoding", c) for c in (24, 128, 146, 158, 160, 233)] == ["breve", "bullet", "trademark", "zcaron", "Euro", "eacute"]
    assert [glyph("WinAnsiEncoding", c) for c in (128, 150, 228)] == ["Euro", "endash", "adieresis"] and glyph("MacRomanEncoding", 138) == "adieresis"
    assert encodings.from_name("MacRomanEncoding") == "MacRomanEncoding" and encodings.from_name("Other") is None
    with pytest.raises(ValueError):
        encodings.table("Other")


def test_font_metrics(spark):
    assert metrics.widths("Helvetica")["W"] == 944 and metrics.widths("Helvetica-Bold")["m"] == 889 and metrics.widths("Times-Roman")["i"] == 278 and set(metrics.widths("Courier-Bold").values()) == {600}
    assert len(metrics.known_fonts()) == 14 and metrics.descriptor("Helvetica-Oblique")["italic_angle"] == -12 and metrics.descriptor("Nothing") is None
    rows = spark.createDataFrame([("Hello, World!", 10.0), ("", 10.0), (None, 10.0), ("é a", 20.0)], "t string, s double")
    got = rows.select(metrics.string_units(F.col("t")).alias("u"), metrics.measure(F.col("t"), F.col("s"), char_spacing=1, word_spacing=2, scale=50).alias("w"), metrics.char_width(F.substring("t", 1, 1), "Helvetica").alias("c")).collect()
    assert [r["u"] for r in got] == [722 + 556 + 222 + 222 + 556 + 278 + 278 + 944 + 556 + 333 + 222 + 556 + 278, 0, None, 500 + 278 + 556]
    assert got[0]["w"] == pytest.approx((57.23 + 13 + 2) / 2) and got[0]["c"] == 722 and got[3]["c"] == 500


def test_big_integers(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(rng.randrange(1, 900)), rng.getrandbits(rng.randrange(1, 500)) + 1, rng.getrandbits(300) | 1) for _ in range(60)] + [(0, 1, 7)]
    frame = spark.createDataFrame([tuple(b"\0" * rng.randrange(3) + bignum.to_bytes(x) for x in r) for r in rows], "a binary, b binary, m binary")
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    out = frame.select(bignum.compare(a, b).alias("sign"), *(bignum.to_decimal(x) for x in (bignum.add(a, b), bignum.mul(a, b), bignum.div(a, b), bignum.mod(a, b), bignum.mod_pow(a, b, m)))).collect()
    for (x, y, z), r in zip(rows, out, strict=True):
        assert tuple(r) == ((x > y) - (x < y), str(x + y), str(x * y), str(x // y), str(x % y), str(pow(x, y, z)))
    assert bignum.to_bytes(5, 4) == b"\0\0\0\5" and bignum.to_bytes(0) == b"\0"
    with pytest.raises(OverflowError):
        bignum.to_bytes(70000, 2)


def test_references(spark):
    texts = ["a &lt;b&gt; &amp;amp; &#65;&#x42;&#X63; &quot;&apos;", "&#0; &#xD800; &#x110000; &#128512; & &; &unknown; &#;", "", None, "plain", "&&amp;&lt"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.decode_entities(F.col("t"))).collect()]
    assert got == ["a <b> &amp; ABc \"'", "&#0; &#xD800; &#x110000; \U0001f600 & &; &unknown; &#;", "", None, "plain", "&&&lt"]
    assert html.unescape(texts[0]) == got[0]


def test_dumps_and_boxes(spark):
    made = pdf_write.from_pages([["One"], ["Two", "more"]], info={"Title": "x"}, outline=[(0, "A"), (1, "B")])
    frame = spark.createDataFrame([(1, made), (2, b"junk"), (3, None)], "doc_id long, content binary")
    lines: dict = {}
    for r in documents.load(frame, "canonical").orderBy("doc_id", "seq").collect():
        if r["doc_id"] == 1:
            lines.setdefault(r["dump"], []).append(r["line"])
    assert [x.split(" ", 2)[2] for x in lines["pages_tree"]] == ["612 792 0", "612 792 0"] and lines["outlines"] == ["0\tA", "1\tB"]
    assert lines["digest"] == [f"{n}: {hashlib.new(n, made).hexdigest()}" for n in ("md5", "sha1", "sha256", "sha384", "sha512")]
    assert "<54776F> Tj" in lines["content_stream"] and lines["trailer"][1] == "root 1" and all(" inuse " in x or " free " in x for x in lines["xref"])
    boxes = {(r["pagenum"], r["box"]): (r["rect"], r["own"]) for r in documents.load(frame, "page_boxes").collect() if r["doc_id"] == 1}
    assert boxes[2, "ArtBox"] == ([0, 0, 612, 792], False) and boxes[1, "MediaBox"][1]
