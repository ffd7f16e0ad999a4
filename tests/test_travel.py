"""Functions reach executors that hold no copy of the package."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from leafmill.kernels import ccitt, cff, codecs, crypto, encodings, images, jpeg, pdf, pdf_edit, pdf_write, render, signing, truetype, xmp
from leafmill.sources import documents

MADE = {
    "tables": documents.TABLES, "pdf": pdf.text_runs, "encodings": encodings.table, "render": render.render, "sign": signing.sign_document, "key": signing.derived_key(3, 512), "cff": cff.parse,
    "truetype": truetype.parse, "ccitt": ccitt.decode, "codecs": codecs.apply_filters, "crypto": crypto.authenticate, "images": images.tiff_decode, "jpeg": jpeg.decode, "edit": pdf_edit.apply_edits, "write": pdf_write.from_pages, "xmp": xmp.parse,
}


def test_by_value(tmp_path):
    for name, made in MADE.items():
        (tmp_path / name).write_bytes(cloudpickle.dumps(made))
    run = "import sys, pyspark.cloudpickle as c\nfor n in sys.argv[1:]:\n    c.loads(open(n, 'rb').read())\nassert 'leafmill' not in sys.modules"
    got = subprocess.run([sys.executable, "-c", run, *MADE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": ""}, timeout=120)
    if got.returncode:
        pytest.fail(got.stderr[-500:])
