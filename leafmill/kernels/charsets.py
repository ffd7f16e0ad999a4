"""Charsets that Spark lacks or refuses on dirty input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cp1252_bytes(s: str) -> bytes:
    """Characters that the charset lacks become "?"."""
    return s.encode("cp1252", "replace")


def cp1252_text(b: bytes) -> str:
    """The five undefined bytes become U+FFFD."""
    return b.decode("cp1252", "replace")


def utf16_text(b: bytes, little: bool = True) -> str:
    """Lone surrogates and an odd last byte become U+FFFD, one each."""
    return b.decode("utf-16-le" if little else "utf-16-be", "replace")


def encode_cp1252(s: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else cp1252_bytes(v))

    return run(s)


def decode_cp1252(b: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else cp1252_text(bytes(v)))

    return run(b)


def decode_utf16(b: Column, little: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else utf16_text(bytes(v), little))

    return run(b)
