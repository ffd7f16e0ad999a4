"""Whole numbers of any size as big-endian bytes, without sign. Columns are binary; each operation is one Arrow batch
function over both columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(b: bytes | None) -> int | None:
    return None if b is None else int.from_bytes(b, "big")


def to_bytes(n: int, length: int | None = None) -> bytes:
    """The shortest form, one byte for 0; with a length, padded by zeros. A number that doesn't fit is an error."""
    return n.to_bytes(length if length is not None else max(1, (n.bit_length() + 7) // 8), "big")


def _on(f: Callable[..., int], *columns: Column) -> Column:
    @F.pandas_udf("binary")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else to_bytes(f(*(to_int(bytes(x)) for x in row))) for row in zip(*series, strict=True)])

    return run(*columns)


def from_decimal(c: Column) -> Column:
    """Digits as bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else to_bytes(int(x)))

    return run(c.cast("string"))


def to_decimal(c: Column) -> Column:
    """Bytes as digits."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else str(to_int(bytes(x))))

    return run(c)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.hex(c), "^(?:00)+", "")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, in the engine: without leading zeros the longer is larger, and equally long ones compare as text."""
    x, y = _stripped(a), _stripped(b)
    return F.when(F.length(x) != F.length(y), F.signum(F.length(x) - F.length(y))).when(x < y, -1).when(x > y, 1).otherwise(0).cast("int")


def add(a: Column, b: Column) -> Column:
    return _on(lambda x, y: x + y, a, b)


def sub(a: Column, b: Column) -> Column:
    """a - b; a must not be less."""

    def run(x: int, y: int) -> int:
        if x < y:
            raise ValueError("the difference is negative")
        return x - y

    return _on(run, a, b)


def mul(a: Column, b: Column) -> Column:
    return _on(lambda x, y: x * y, a, b)


def div(a: Column, b: Column) -> Column:
    """The quotient; dividing by 0 is an error."""
    return _on(lambda x, y: x // y, a, b)


def mod(a: Column, b: Column) -> Column:
    return _on(lambda x, y: x % y, a, b)


def mod_pow(base: Column, exponent: Column, modulus: Column) -> Column:
    return _on(pow, base, exponent, modulus)
