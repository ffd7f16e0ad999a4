"""Files written by the executors: documents, attachments, pictures, texts. The folder must be one that all executors
share, such as a mounted volume; each file is written under a name of its own and then renamed, so a task that runs
again, or twice at a time, leaves whole files only."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as strings

_UNSAFE = r"[^\p{L}\p{N}._ -]"


def folder_of(path: str) -> str:
    """The folder of a path or a file: address; other stores have no files to write to."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"not a folder of files: {path}")
    return unquote(found.path) if found.scheme else path


def safe_name(*parts: Column) -> Column:
    """A file name of the parts, in which everything but letters, digits, full stops, blanks and hyphens is "_"."""
    return F.concat_ws("_", *(F.regexp_replace(p.cast("string"), _UNSAFE, "_") for p in parts))


def save(rows: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """Writes ``content`` (binary; null is empty) of each row to a file ``name`` in the folder when the result is read: path
    and bytes of each file. Names must differ; of equal ones the last one written stays."""
    to = folder_of(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(to, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not file or file in (".", "..") or "/" in file or "\0" in file:
                    raise ValueError(f"not a file name: {file!r}")
                body = data.as_py() or b""
                path = os.path.join(to, file)
                draft = os.path.join(to, f".{uuid.uuid4().hex}")
                with open(draft, "wb") as out:
                    out.write(body)
                os.replace(draft, path)
                paths.append(path)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select(name.cast("string").alias("name"), content.cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")


def save_text(rows: DataFrame, folder: str, name: Column, text: Column, charset: str = "utf-8", preamble: bool = False) -> DataFrame:
    """Like ``save`` for texts in a charset, with its byte order mark if asked for."""
    body = strings.get_bytes(F.coalesce(text, F.lit("")), charset)
    if preamble:
        body = F.concat(F.unhex(F.lit(strings.PREAMBLES[strings.charset(charset)])), body)
    return save(rows, folder, name, body)
