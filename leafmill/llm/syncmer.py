"""Document fingerprints of closed syncmers.

A k-mer of characters is a closed syncmer if the smallest hash of its inner s-mers is the first or the last of
them. Whether it is one depends on the k-mer alone, so equal passages give equal anchors wherever they stand.
A fingerprint holds all anchors of a text in order, each as its distance from the one before and its hash, so it grows
with the text and long texts keep the anchors of every passage. Two fingerprints are compared by the anchors that
both have (a hash's occurrences are paired in order) and whose places rise in both alike, against all anchors of both.

Null texts are empty; an empty text has an empty fingerprint, and two empty ones have likeness 1. A text without
a k-mer or syncmer has itself as its only anchor. The order of documents is by descending id, then by the hash
of the text, so rows that repeat an id have a place; null ids come last. Rows that repeat both follow one another.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import materialize, release

K, S = 24, 5
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n characters, by doubling."""
    out, length = c, 1
    done = np.zeros(0, dtype=np.uint64)
    done_length = 0
    while n:
        if n & 1:
            done = out if not done_length else done[: len(done) - length] * np.uint64(pow(_BASE, length, 2**64)) + out[done_length : done_length + len(done) - length]
            done_length += length
        n >>= 1
        if n:
            out = out[: len(out) - length] * np.uint64(pow(_BASE, length, 2**64)) + out[length:]
            length *= 2
    return _mix(done)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    if len(c) >= K:
        inner = _grams(c, S)
        w = K - S + 1
        least, reach = inner, 1
        while reach < w:
            shift = min(reach, w - reach)
            least = np.minimum(least[: len(least) - shift], least[shift:])
            reach += shift
        n = len(c) - K + 1
        spots = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
        if len(spots):
            return spots, (_grams(c, K)[spots] >> np.uint64(32)).astype(np.int64)
    return np.zeros(1, dtype=np.int64), np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))], dtype=np.int64)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors, in order; none for an empty text."""
    return anchors(text) if text else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Twelve hexadecimal digits an anchor: four of its distance from the one before (K - S at most), eight of its hash."""
    out = np.zeros(len(print_[0]), dtype=[("d", ">u2"), ("h", ">u4")])
    out["d"], out["h"] = np.diff(print_[0], prepend=0), print_[1]
    return out.tobytes().hex()


def _keyed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each anchor, its hash with the number of its occurrence, sorted; and the anchors' order by key."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    rank = np.arange(len(ranked)) - np.repeat(start, np.diff([*start, len(ranked)]))
    return ranked.astype(np.uint64) << np.uint64(32) | rank.astype(np.uint64), order


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[1]) or not len(b[1]):
        return float(not len(a[1]) and not len(b[1]))
    (ka, oa), (kb, ob) = _keyed(a[1]), _keyed(b[1])
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    there = ob[ib][np.argsort(oa[ia])]
    chain = len(there)
    if (np.diff(there) < 0).any():
        tails: list[int] = []  # of rising chains, the longest of which has as many members
        for at in there.tolist():
            k = bisect_left(tails, at)
            tails[k : k + 1] = [at]
        chain = len(tails)
    return chain / (len(ka) + len(kb) - len(common))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Bytes of text in a stretch at least, and about how many stretches there are at most (their bounds are broadcast, 16
#: bytes each); beyond, stretches grow, which are sorted on disk and read row by row.
STRETCH_BYTES, MAX_STRETCHES = 16 << 20, 200_000
#: Bytes of fingerprints that are held before they are given away.
OUT_BYTES = 16 << 20
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cuts(keys: DataFrame) -> list[tuple[int | None, int]]:
    """The (id, tie) at which stretches begin, in order. Only keys are sorted here; rows of one id are cut by their ties,
    so an id may hold any number of rows. ``keys``: doc_id, tie, size."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    least = max(STRETCH_BYTES, total // MAX_STRETCHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = least, None
        for batch in batches:
            ids, ties = [], []
            for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= least and (i, t) != last:
                    ids.append(i)
                    ties.append(t)
                    held = 0
                held, last = held + n, (i, t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int64())], names=["i", "t"])

    ranged = keys.repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    found = [(r["i"], r["t"]) for r in ranged.select("doc_id", "tie", "size").mapInArrow(run, "i long, t long").collect()]
    return sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)


def _placer(cuts: list[tuple[int | None, int]]):
    """A function from columns (id, whether it is null, tie) to twice the stretch's number, and one more where the
    stretch begins with this key."""
    rising = cuts[::-1]
    without = np.array([t for i, t in rising if i is None], dtype=np.int64)
    ids = np.array([i for i, _ in rising if i is not None], dtype=np.int64)
    ties = np.array([t for _, t in rising], dtype=np.int64)
    none, last = len(without), len(rising) - 1

    def place(i: np.ndarray, null: np.ndarray, t: np.ndarray) -> np.ndarray:
        low = np.searchsorted(ids, i, side="left") + none
        high = np.searchsorted(ids, i, side="right") + none
        low[null], high[null] = 0, none
        for k in np.flatnonzero(high > low).tolist():
            low[k] += np.searchsorted(ties[low[k] : high[k]], t[k], side="left")
        first = (low < high) & (ties[np.minimum(low, last)] == t)
        return 2 * (last - low) + first

    return place


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, which ends with the start of the next document's text.

    The order of the documents is cut into stretches of about equal bytes; a stretch is sorted in one task and read row
    by row. The first document of each goes to the stretch before it as well, where its text is the next of the
    last one: whole texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = materialize(rows.select("doc_id", "tie", F.octet_length("text").cast("long").alias("size")), "syncmer-keys")
    cuts = _cuts(keys)
    release(keys)
    if not cuts:
        return spark.createDataFrame([], _OUT)
    held = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def stretch(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        place = _placer(held.value)
        for i, null, t in batches:
            yield pd.Series(place(i.to_numpy(dtype=np.int64), null.to_numpy(dtype=bool), t.to_numpy(dtype=np.int64)))

    rows = rows.withColumn("code", stretch(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tie"))
    at = F.expr("cast(code div 2 as int)")
    here = F.struct(at.alias("at"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(at + F.lit(len(cuts) - 1), F.lit(len(cuts))).alias("at"), F.lit(True).alias("extra"))
    places = F.when(F.col("code") % 2 == 1, F.array(here, before)).otherwise(F.array(here))
    dealt = rows.select("doc_id", "text", "tie", F.explode(places).alias("place")).select("doc_id", "text", "tie", "place.at", "place.extra")
    # one stretch a partition
    dealt = dealt.repartitionById(len(cuts), "at").sortWithinPartitions("at", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: id, text, fingerprint, stretch
        out: list[list] = [[] for _ in range(7)]
        size = 0

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for doc_id, text, at, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if extra and held is None:
                    continue  # rows that repeat the first document
                text = text.as_py()
                mine = fingerprint(text)
                if held is not None and held[3] == at:
                    new = edited(held[1], text)
                    second = fingerprint(new)
                    row = (held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), written(held[2]), written(second), likeness(held[2], second), likeness(held[2], mine))
                    for to, x in zip(out, row, strict=True):
                        to.append(x)
                    size += len(row[3]) + len(row[4])
                held = None if extra else (doc_id, text, mine, at)
                if size > OUT_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return dealt.select("doc_id", "text", "tie", "at", "extra").mapInArrow(run, _OUT)
