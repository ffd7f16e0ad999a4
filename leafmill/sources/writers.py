"""Documents from tables: one file of each group of pages, edits, and files written by the executors."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.kernels import pdf_write, signing


def from_text(docs: DataFrame, info: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, content): a one-page document of each row's text, with the columns ``info`` as its information."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            made = [pdf_write.from_pages([(text or "").split("\n")], info={k: str(v) for k, v in zip(info, rest, strict=True)} or None) for _, text, *rest in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *info).mapInArrow(run, f"doc_id {kind}, content binary")


def from_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc_id, content): a document of each group of pages, in order, with an outline of its pages."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([page, text])
        made = pdf_write.from_pages([t.split("\n") for t in pdf[text]], outline=[(0, f"Page {n}") for n in range(1, len(pdf) + 1)])
        return pd.DataFrame({"doc_id": [key[0]], "content": [made]})

    kind = pages.schema[doc].dataType.simpleString()
    return pages.select(doc, page, text).groupBy(doc).applyInPandas(build, f"doc_id {kind}, content binary")


def concatenate(docs: DataFrame, group: str, order: str) -> DataFrame:
    """(group, content): one document of each group's, in order."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(bytes(c), None) for c in pdf.sort_values(order)["content"]]
        return pd.DataFrame({group: [key[0]], "content": [pdf_write.assemble(parts)]})

    kind = docs.schema[group].dataType.simpleString()
    return docs.select(group, order, "content").groupBy(group).applyInPandas(build, f"{group} {kind}, content binary")


def keep_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, content) with the pages of the array column ``keep``, in document order."""
    @F.pandas_udf("binary")
    def cut(content: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([pdf_write.assemble([(bytes(c), sorted(set(map(int, k))))]) for c, k in zip(content, keep, strict=True)])

    return docs.select("doc_id", cut("content", "keep").alias("content"))


def compacted(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def shrink(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pdf_write.compact(bytes(c)))

    return docs.select("doc_id", shrink("content").alias("content"))


def signed(docs: DataFrame, key: signing.Key, certificate: bytes, time: datetime, field: str = "Signature1", page: int = 1, **texts: str) -> DataFrame:
    """(doc_id, content) with a signature of the whole document; no content where it can't be opened or signed (encrypted,
    without that page, with a field of that name)."""
    def one(content) -> bytes | None:
        try:
            return signing.sign_document(bytes(content), key, certificate, time, field, page, **texts)
        except (ValueError, TypeError, KeyError, IndexError, RecursionError):
            return None

    @F.pandas_udf("binary")
    def make(content: pd.Series) -> pd.Series:
        return content.map(one)

    return docs.select("doc_id", make("content").alias("content"))
