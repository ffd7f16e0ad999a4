import numpy as np

from leafmill.kernels import images, pdf, pdf_edit, pdf_write, render
from leafmill.sources import devices


def page(ops, box=(0, 0, 8, 8), rotate=0):
    data = pdf_write.write({1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref(2, 0)}, 2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref(3, 0)], "Count": 1}, 3: {"Type": pdf.Name("Page"), "Parent": pdf.Ref(2, 0), "MediaBox": list(box), "Rotate": rotate, "Contents": pdf.Ref(4, 0)}, 4: pdf.Stream({}, ops)}, {"Root": pdf.Ref(1, 0)})
    return data


def pixels(data, dpi=72):
    doc = pdf.Document.open(data)
    w, h, px = render.render(doc, doc.pages()[0], dpi)
    return np.frombuffer(px, dtype=np.uint8).reshape(h, w, 4)[:, :, 0]


def test_fill_rules_and_clips():
    got = pixels(page(b"0 g 1 1 4 4 re f"))
    assert (got[3:7, 1:5] == 0).all() and got.sum() == 255 * (64 - 16)
    ring = b"0 g 0 0 8 8 re 2 2 4 4 re "
    assert pixels(page(ring + b"f*"))[4, 4] == 255 and pixels(page(ring + b"f"))[4, 4] == 0
    assert (pixels(page(b"q 0 0 4 8 re W n 0 g 0 0 8 8 re f Q"))[:, 4:] == 255).all()
    assert pixels(page(b"0.5 g 0.5 0 1 1 re f"))[7, 0] == 191
    assert pixels(page(b"0 G 2 w 0 4 m 8 4 l S"))[4, 4] == 0
    assert pixels(page(b"0 g 0 0 m 0 8 8 8 8 0 c h f"))[7, 4] == 0
    turned = pixels(page(b"0 g 0 0 2 1 re f", (0, 0, 8, 4), 90))
    assert turned.shape == (8, 4) and (turned[0:2, 0] == 0).all() and turned.sum() == 255 * 30
    assert pixels(page(b"", (0, 0, 8, 8)), 144).shape == (16, 16)


def test_images_and_devices(spark):
    data = pdf_edit.apply_edits(page(b""), [("add_image", {"page": 1, "width": 2, "height": 1, "rgb": bytes([255, 0, 0, 0, 0, 255]), "rect": [0, 0, 8, 8]})])
    got = pixels(data)
    assert got[4, 1] == 255 and got[4, 6] == 0
    docs = spark.createDataFrame([(1, data), (2, b"junk")], "doc_id int, content binary")
    rows = devices.pages(docs).collect()
    assert len(rows) == 1 and images.png_decode(bytes(rows[0]["image"]))[:2] == (8, 8)
    assert len(images.tiff_decode(bytes(devices.tiff(docs.where("doc_id = 1")).first()["image"]))) == 1


def with_parts(ops, resources, parts, annots=()):
    name, ref = pdf.Name, pdf.Ref
    objects = {1: {"Type": name("Catalog"), "Pages": ref(2, 0)}, 2: {"Type": name("Pages"), "Kids": [ref(3, 0)], "Count": 1}, 3: {"Type": name("Page"), "Parent": ref(2, 0), "MediaBox": [0, 0, 20, 10], "Resources": resources, "Contents": ref(4, 0), "Annots": list(annots)}, 4: pdf.Stream({}, ops)}
    return pdf_write.write(objects | parts, {"Root": ref(1, 0)})


def test_glyphs_of_embedded_fonts():
    from test_truetype import font

    name, ref = pdf.Name, pdf.Ref
    simple = {"Type": name("Font"), "Subtype": name("TrueType"), "FirstChar": 65, "Widths": [200, 100], "FontDescriptor": ref(6, 0)}
    wide = {"Type": name("Font"), "Subtype": name("Type0"), "Encoding": name("Identity-H"), "DescendantFonts": [{"Subtype": name("CIDFontType2"), "FontDescriptor": ref(6, 0), "W": [1, [200], 2, 2, 100]}]}
    parts = {5: simple, 6: {"FontFile2": ref(7, 0)}, 7: pdf.Stream({}, font()), 8: wide}
    draw = lambda ops: pixels(with_parts(ops, {"Font": {"F": ref(5, 0), "W": ref(8, 0)}}, parts))
    a = draw(b"BT /F 50 Tf 0 0 Td (A) Tj ET")
    assert (a[5:, :5] == 0).all() and a.sum() == 255 * (200 - 25)
    # A is 10 wide; B's square is moved by half a pixel
    ab = draw(b"BT /F 50 Tf 0 0 Td (AB) Tj ET")
    assert (ab[5:, :5] == 0).all() and (ab[5:, 11:15] == 0).all() and (ab[5:, 10] == 128).all() and (ab[:, 6:10] == 255).all()
    assert (draw(b"BT /W 50 Tf 0 0 Td <00010002> Tj ET") == ab).all()
    assert (draw(b"BT /F 50 Tf 0 0 Td [(A) 0 (B)] TJ ET") == ab).all()
    assert (draw(b"BT /F 50 Tf 0 0 Td (A) Tj (B) Tj ET") == ab).all()
    moved = draw(b"BT /F 50 Tf 0 0 Td [(A) 100 (A)] TJ ET")
    assert (moved[5:, :10] == 0).all() and moved.sum() == 255 * 150
    assert (draw(b"BT /F 50 Tf 3 Tr 0 0 Td (A) Tj ET") == 255).all()
    assert (draw(b"BT /F 50 Tf 5 Ts 0 0 Td (A) Tj ET")[:5, :5] == 0).all()
    assert (draw(b"BT /F 50 Tf 2 Tc 0 0 Td (AA) Tj ET")[5:, 12:17] == 0).all()
    assert (draw(b"BT /F 50 Tf 50 Tz 0 0 Td (A) Tj ET")[5:, 3:] == 255).all()
    # a program that can't be read is painted as a box
    broken = pixels(with_parts(b"BT /F 5 Tf 0 0 Td (A) Tj ET", {"Font": {"F": ref(5, 0)}}, parts | {7: pdf.Stream({}, b"junk")}))
    assert (broken[7:, 0] == 0).all()


def test_annotations_and_stencils():
    name, ref = pdf.Name, pdf.Ref
    look = pdf.Stream({"BBox": [0, 0, 1, 1]}, b"0 g 0 0 1 1 re f")
    note = {"Subtype": name("Stamp"), "Rect": [2, 2, 6, 4], "AP": {"N": ref(5, 0)}}
    got = pixels(with_parts(b"", {}, {5: look}, [note]))
    assert (got[6:8, 2:6] == 0).all() and got.sum() == 255 * (200 - 8)
    state = note | {"AP": {"N": {"On": ref(5, 0)}}}
    assert (pixels(with_parts(b"", {}, {5: look}, [state | {"AS": name("On")}])) == got).all()
    for hidden in (note | {"F": 2}, note | {"Subtype": name("Popup")}, state | {"AS": name("Off")}, {"AP": 3}):
        assert (pixels(with_parts(b"", {}, {5: look}, [hidden])) == 255).all()
    stencil = pdf.Stream({"Subtype": name("Image"), "Width": 2, "Height": 1, "ImageMask": True, "BitsPerComponent": 1}, bytes([0b01000000]))
    got = pixels(with_parts(b"q 0 g 20 0 0 10 0 0 cm /I Do Q", {"XObject": {"I": ref(5, 0)}}, {5: stencil}))
    assert (got[:, :10] == 0).all() and (got[:, 10:] == 255).all()
    turned = pdf.Stream(stencil.header | {"Decode": [1, 0]}, stencil.body)
    assert (pixels(with_parts(b"q 0 g 20 0 0 10 0 0 cm /I Do Q", {"XObject": {"I": ref(5, 0)}}, {5: turned}))[:, 10:] == 0).all()
    nibbles = pdf.Stream({"Subtype": name("Image"), "Width": 2, "Height": 1, "ColorSpace": name("DeviceGray"), "BitsPerComponent": 4}, bytes([0x0F]))
    got = pixels(with_parts(b"q 20 0 0 10 0 0 cm /I Do Q", {"XObject": {"I": ref(5, 0)}}, {5: nibbles}))
    assert (got[:, :10] == 0).all() and (got[:, 10:] == 255).all()
    from leafmill.kernels import ccitt

    fax = pdf.Stream({"Subtype": name("Image"), "Width": 2, "Height": 1, "ColorSpace": name("DeviceGray"), "BitsPerComponent": 1, "Filter": name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 2, "Rows": 1}}, ccitt.encode(bytes([0b01000000]), 2, 1))
    got = pixels(with_parts(b"q 20 0 0 10 0 0 cm /I Do Q", {"XObject": {"I": ref(5, 0)}}, {5: fax}))
    assert (got[:, :10] == 0).all() and (got[:, 10:] == 255).all()


def test_shadings_and_transparency():
    name, ref = pdf.Name, pdf.Ref
    ramp = {"FunctionType": 2, "Domain": [0, 1], "C0": [0.0], "C1": [1.0], "N": 1}
    axial = {"ShadingType": 2, "ColorSpace": name("DeviceGray"), "Coords": [0, 0, 20, 0], "Function": ramp}
    steps = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 0, 1, 1], "Functions": [ramp, ramp]}
    radial = {"ShadingType": 3, "ColorSpace": name("DeviceGray"), "Coords": [10, 5, 0, 10, 5, 4], "Function": ramp}
    held = {"Shading": {"A": axial, "R": radial, "S": axial | {"Function": steps}, "T": axial | {"Function": ref(6, 0)}, "B": axial | {"Coords": [5, 0, 10, 0], "Extend": [True, False]}}, "Pattern": {"P": {"PatternType": 2, "Shading": axial}}, "ExtGState": {"G": {"ca": 0.5}}}
    parts = {5: {}, 6: pdf.Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [2], "BitsPerSample": 8}, bytes([0, 255]))}
    draw = lambda ops: pixels(with_parts(ops, held, parts))
    level = np.floor((np.arange(20) + 0.5) / 20 * 255 + 0.5)
    assert (draw(b"/A sh") == level).all() and (draw(b"/T sh") == level).all()
    assert (draw(b"/S sh")[:, :10] == 0).all() and (draw(b"/S sh")[:, 10:] == 255).all()
    assert (draw(b"q 0 0 4 10 re W n /A sh Q")[:, 4:] == 255).all()
    got = draw(b"/Pattern cs /P scn 0 0 20 5 re f")
    assert (got[5:] == level).all() and (got[:5] == 255).all()
    got = draw(b"/B sh")
    assert (got[:, :5] == 0).all() and (got[:, 10:] == 255).all() and 0 < got[0, 7] < 255
    got = draw(b"/R sh")
    assert got[5, 10] < 60 < got[5, 12] < got[5, 13] and got[0, 0] == 255 and got[5, 15] == 255
    assert (draw(b"/G gs 0 g 0 0 20 10 re f") == 128).all() and (draw(b"q /G gs Q 0 g 0 0 20 10 re f") == 0).all()
    mask = pdf.Stream({"Width": 2, "Height": 1, "ColorSpace": name("DeviceGray"), "BitsPerComponent": 8}, bytes([0, 255]))
    image = pdf.Stream({"Subtype": name("Image"), "Width": 1, "Height": 1, "ColorSpace": name("DeviceGray"), "BitsPerComponent": 8, "SMask": ref(6, 0)}, bytes([0]))
    got = pixels(with_parts(b"20 0 0 10 0 0 cm /I Do", {"XObject": {"I": ref(5, 0)}}, {5: image, 6: mask}))
    assert (got[:, :10] == 255).all() and (got[:, 10:] == 0).all()


def test_colour_spaces_of_images():
    from leafmill.kernels import jpeg

    name, ref = pdf.Name, pdf.Ref
    show = lambda head, body, **parts: pixels(with_parts(b"20 0 0 10 0 0 cm /I Do", {"XObject": {"I": ref(5, 0)}}, {5: pdf.Stream({"Subtype": name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8} | head, body), 6: pdf.Stream({"N": 3}, b"")}))
    indexed = [name("Indexed"), name("DeviceRGB"), 1, bytes([10, 0, 0, 200, 0, 0])]
    got = show({"ColorSpace": indexed, "BitsPerComponent": 1}, bytes([0b01000000]))
    assert (got[:, :10] == 10).all() and (got[:, 10:] == 200).all()
    # a number beyond the table is its last one
    assert (show({"ColorSpace": indexed}, bytes([9, 9])) == 200).all()
    got = show({"ColorSpace": [name("ICCBased"), ref(6, 0)]}, bytes([1, 2, 3, 4, 5, 6]))
    assert (got[:, :10] == 1).all() and (got[:, 10:] == 4).all()
    assert (show({"ColorSpace": [name("CalGray"), {}]}, bytes([7, 8]))[:, :10] == 7).all()
    for unknown in (name("Odd"), [name("Lab"), {}], [name("Indexed"), name("Odd"), 1, b"a"], [name("ICCBased"), 3], [], None):
        assert (show({"ColorSpace": unknown}, bytes(6)) == 255).all()
    photo = jpeg.encode(16, 16, bytes([60, 60, 60, 255]) * 256, 95)
    assert abs(show({"Width": 16, "Height": 16, "ColorSpace": name("DeviceRGB"), "Filter": name("DCTDecode")}, photo).astype(int) - 60).max() < 4


def test_jpeg():
    from leafmill.kernels import jpeg

    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG.tolist()) == list(range(64))
    y, x = np.mgrid[0:21, 0:30]
    rgba = np.dstack([x * 8, y * 12, (x + y) * 4, np.full_like(x, 255)]).astype(np.uint8).tobytes()
    w, h, got = jpeg.decode(jpeg.encode(30, 21, rgba, 90))
    assert (w, h) == (30, 21) and images.psnr(rgba, got) > 35
    assert len(jpeg.encode(30, 21, rgba, 20)) < len(jpeg.encode(30, 21, rgba, 95))
