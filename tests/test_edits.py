"""Edits, metadata packets and the edits table."""

import json

import pytest

from leafmill.kernels import pdf, pdf_edit, pdf_write, xmp
from leafmill.sources import documents, edits


def base():
    return pdf_write.from_pages([["Hello", "Secret"], ["two"]])


def texts(data):
    doc = pdf.Document.open(data)
    return [pdf.page_text(doc, p) for p in doc.pages()]


def test_pages_and_text():
    out = pdf_edit.apply_edits(base(), [("add_page", {"at": 1}), ("add_text", {"page": 1, "text": "new", "x": 10, "y": 10}), ("replace_text", {"old": "Hello", "new": "Hé"}), ("set_rotation", {"page": 3, "degrees": -90})])
    assert texts(out) == ["new", "Hé\nSecret", "two"]
    doc = pdf.Document.open(out)
    assert pdf.rotation_of(doc.pages()[2], doc) == 270
    assert texts(pdf_edit.apply_edits(out, [("delete_pages", {"pages": [1, 3]})])) == ["Hé\nSecret"]
    assert pdf_edit.apply_edits(out, []) is out
    with pytest.raises(ValueError):
        pdf_edit.apply_edits(out, [("nothing", {})])
    assert "Secret" not in texts(pdf_edit.apply_edits(base(), [("redact", {"page": 1, "rect": [70, 700, 200, 712]})]))[0]
    stamped = texts(pdf_edit.apply_edits(base(), [("stamp", {"text": "p. #", "y": 20}), ("header", {"text": "top"})]))
    assert all(f"p. {n}" in t and "top" in t for n, t in enumerate(stamped, 1))


def test_document_parts(spark):
    steps = [
        ("set_info", {"entries": {"Title": "T"}}), ("set_outline", {"items": [(0, "A", 1), (1, "B", 9)]}), ("rename_bookmarks", {"old": "B", "new": "C"}),
        ("add_annotation", {"page": 1, "subtype": "Text", "rect": [0, 0, 9, 9], "contents": "note", "name": "n1"}), ("add_annotation", {"page": 1, "subtype": "Link", "rect": [0, 0, 9, 9]}),
        ("delete_annotations", {"subtype": "Link"}), ("attach", {"name": "a.txt", "data": b"body", "mime": "text/plain"}), ("set_destination", {"name": "d", "page": 2}),
        ("set_page_label", {"start": 0, "style": "r", "prefix": "x"}), ("add_field", {"name": "f", "kind": "Tx", "page": 1, "rect": [0, 0, 5, 5], "value": "v"}),
        ("add_field", {"name": "g", "kind": "Btn", "page": 1, "rect": [0, 0, 5, 5]}), ("remove_field", {"name": "g"}), ("add_image", {"page": 2, "width": 1, "height": 1, "rgb": b"abc", "rect": [0, 0, 5, 5]}),
    ]
    out = pdf_edit.apply_edits(base(), steps)
    docs = spark.createDataFrame([(1, out)], "doc_id int, content binary")
    get = lambda t, *c: [tuple(r) for r in documents.load(docs, t).select(*c).collect()]
    assert get("info", "key", "value") == [("Title", "T")]
    assert get("outlines", "depth", "title") == [(0, "A"), (1, "C")]
    assert ("Text", "note") in get("annotations", "subtype", "contents") and not documents.load(docs, "annotations").where("subtype = 'Link'").count()
    assert [(n, bytes(b)) for n, b in get("attachments", "name", "bytes")] == [("a.txt", b"body")]
    assert get("named_dests", "name", "page", "verb") == [("d", 2, "Fit")]
    assert get("page_labels", "start_page", "style", "prefix") == [(0, "r", "x")]
    assert get("form_fields", "name", "kind", "value") == [("f", "text", "v")]
    assert get("images", "pagenum", "width") == [(2, 1)]
    later = pdf_edit.apply_edits(out, [("flatten_form", {}), ("detach", {"name": "a.txt"}), ("delete_images", {"page": 2})])
    docs = spark.createDataFrame([(1, later)], "doc_id int, content binary")
    assert not get("form_fields", "name") and not get("attachments", "name") and not get("images", "name")


def test_edits_table(spark):
    docs = spark.createDataFrame([(1, base()), (2, base())], "doc_id int, content binary")
    todo = spark.createDataFrame([(1, 2, "add_text", json.dumps({"page": 1, "text": "x", "x": 1, "y": 1})), (1, 1, "delete_pages", json.dumps({"pages": [1]}))], "doc_id int, seq int, op string, args string")
    got = {r["doc_id"]: texts(bytes(r["content"])) for r in edits.apply(docs, todo).collect()}
    assert got == {1: ["two\nx"], 2: ["Hello\nSecret", "two"]}


def test_xmp():
    packet = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" dc:format="a&amp;b">
    <dc:title><rdf:Alt><rdf:li xml:lang="de">D</rdf:li><rdf:li xml:lang="x-default">E</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>b</rdf:li><rdf:li>a</rdf:li></rdf:Seq></dc:creator>
    <dc:subject><rdf:Bag><rdf:li>b</rdf:li><rdf:li>a</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>"""
    assert xmp.parse(packet) == {"dc:format": "a&b", "dc:title": "E", "dc:creator": "b\ta", "dc:subject": "a\tb"}
    assert xmp.parse(xmp.packet({"dc:title": "a<b", "pdf:Producer": "x"})) == {"dc:title": "a<b", "pdf:Producer": "x"}
    assert xmp.parse(b"junk") == {}
