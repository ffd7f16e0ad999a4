"""Pages as image files, a row for each page, and multi-page files for each document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.kernels import images, jpeg, pdf, render

_FORMATS = {"png": images.png_encode, "bmp": images.bmp_encode, "jpeg": jpeg.encode, "rgba": lambda w, h, px: px}


def pages(docs: DataFrame, form: str = "png", dpi: float = 72.0, first: int = 1, last: int = 0, password: str = "") -> DataFrame:
    """(doc_id, pagenum, width, height, image) of the pages in [first, last]; a last page below 1 is the last."""
    encode = _FORMATS[form]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    doc = pdf.Document.open(content.as_py() or b"", password.encode())
                except (ValueError, TypeError, KeyError, IndexError, RecursionError):
                    continue
                leaves = doc.pages()
                for n in range(max(1, first), (min(last, len(leaves)) if last > 0 else len(leaves)) + 1):
                    w, h, px = render.render(doc, leaves[n - 1], dpi)
                    parts = [pa.array([v], t) for v, t in ((n, pa.int32()), (w, pa.int32()), (h, pa.int32()), (encode(w, h, px), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], batch.schema.field(0).type), *parts], names=["doc_id", "pagenum", "width", "height", "image"])

    return docs.select("doc_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"doc_id {kind}, pagenum int, width int, height int, image binary")


def tiff(docs: DataFrame, dpi: float = 72.0) -> DataFrame:
    """(doc_id, image): all pages of a document in one file."""
    @F.pandas_udf("binary")
    def make(content):
        def one(c):
            doc = pdf.Document.open(bytes(c))
            return images.tiff_encode([render.render(doc, p, dpi) for p in doc.pages()], int(dpi))

        return content.map(one)

    return docs.select("doc_id", make("content").alias("image"))
