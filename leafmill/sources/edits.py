"""Edits as a table: (doc_id, seq, op, args as JSON) beside (doc_id, content). Documents without edits keep their
bytes; a document's edits are applied in the order of ``seq`` in the task that holds it."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.kernels import pdf_edit

_BYTES = ("data", "rgb", "packet")


def apply(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, content). Byte arguments are base-64 in the JSON."""
    per = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "args"))).alias("edits"))

    @F.pandas_udf("binary")
    def run(content: pd.Series, todo: pd.Series) -> pd.Series:
        out = []
        for c, rows in zip(content, todo, strict=True):
            steps = []
            for r in [] if rows is None else rows:
                args = json.loads(r["args"] or "{}")
                steps.append((r["op"], {k: base64.b64decode(v) if k in _BYTES else v for k, v in args.items()}))
            out.append(pdf_edit.apply_edits(bytes(c), steps))
        return pd.Series(out)

    both = docs.join(per, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("edits").isNull(), F.col("content")).otherwise(run("content", F.coalesce("edits", F.array().cast(per.schema["edits"].dataType)))).alias("content"))
