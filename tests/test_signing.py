from datetime import UTC, datetime

import pytest

from leafmill.kernels import pdf, pdf_edit, pdf_write, signing
from leafmill.sources import documents, writers

WHEN = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)
KEY = signing.derived_key(7)
CERT = signing.self_signed(KEY, "A Signer")


def test_der():
    assert signing.oid("1.2.840.113549") == bytes.fromhex("06062a864886f70d")
    assert signing.whole(0) == b"\2\1\0" and signing.whole(128) == b"\2\2\0\x80"
    assert signing.tlv(4, bytes(200))[:3] == b"\4\x81\xc8" and signing.tlv(4, bytes(300))[:4] == b"\4\x82\1\x2c"
    assert signing.read(signing.tlv(4, bytes(300)) + b"\5\0") == [(4, bytes(300), signing.tlv(4, bytes(300))), (5, b"", b"\5\0")]
    with pytest.raises(ValueError):
        signing.read(b"\4\5ab")
    der = signing.seq(signing.whole(0), signing.whole(KEY.modulus), signing.whole(KEY.public), signing.whole(KEY.private))
    assert signing.key_of(der) == KEY
    assert signing.key_of(signing.seq(signing.whole(0), signing.seq(signing.oid("1.2.840.113549.1.1.1")), signing.tlv(4, der))) == KEY


def test_detached():
    der = signing.sign_detached(b"content", KEY, CERT, WHEN)
    assert signing.verify_detached(b"content", der) == (True, "A Signer")
    assert signing.verify_detached(b"contents", der) == (False, "A Signer")
    assert signing.verify_detached(b"content", der[:-1] + bytes((der[-1] ^ 1,))) == (False, "A Signer")
    # another's certificate under the same name
    other = signing.self_signed(signing.derived_key(8), "A Signer")
    assert signing.verify_detached(b"content", signing.sign_detached(b"content", KEY, other, WHEN)) == (False, "A Signer")
    with pytest.raises(ValueError):
        signing.sign_detached(b"", signing.derived_key(1, 256), CERT, WHEN)


def of(data):
    doc = pdf.Document.open(data)
    return [(v, *signing.verify_document(doc, doc.get(v["V"]))) for _, v in doc.objects.values() if isinstance(v, dict) and v.get("FT") == "Sig"]


def test_documents():
    plain = pdf_write.from_pages([["one"], ["two"]])
    signed = signing.sign_document(plain, KEY, CERT, WHEN, page=2, Reason="Because", Name="Zoë")
    assert signed.startswith(plain) and [x[1:] for x in of(signed)] == [(True, "A Signer")]
    doc = pdf.Document.open(signed)
    assert [len(p.get("Annots") or []) for p in doc.pages()] == [0, 1] and pdf.page_text(doc, doc.pages()[0]) == "one"
    changed = signed.replace(b"(one)", b"(One)") if b"(one)" in signed else bytes((signed[20] ^ 1,)).join((signed[:20], signed[21:]))
    assert not any(x[1] for x in of(changed))
    # a second signature leaves the first one whole
    twice = signing.sign_document(signed, KEY, CERT, WHEN, field="Second")
    assert sorted(x[1:] for x in of(twice)) == [(True, "A Signer")] * 2
    with pytest.raises(ValueError):
        signing.sign_document(signed, KEY, CERT, WHEN)
    with pytest.raises(ValueError):
        signing.sign_document(plain, KEY, CERT, WHEN, page=3)


def test_tables(spark):
    plain = pdf_write.from_pages([["one"]])
    docs = spark.createDataFrame([(1, plain), (2, None), (3, b"junk")], "doc_id int, content binary")
    signed = writers.signed(docs, KEY, CERT, WHEN, Reason="Because")
    rows = {r["doc_id"]: r for r in documents.load(signed, "signatures").collect()}
    assert rows[1]["intact"] and rows[1]["covers_whole"] and (rows[1]["signer"], rows[1]["reason"]) == ("A Signer", "Because") and set(rows) == {1}
    later = pdf_edit.apply_edits(bytes(signed.where("doc_id = 1").first()["content"]), [("add_page", {})])
    assert not any(x[1] for x in of(later))
