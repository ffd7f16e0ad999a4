"""Benchmark decontamination by a generalised suffix automaton over words.

The normalised test items form automata of bounded size on the driver, which are broadcast one after the other.
Documents are streamed word by word; the automaton tracks the longest match that ends at each word, and
a match of ``window`` words (or of a whole shorter item) marks its words as hit. There is no shuffle.

Nulls and empty texts have no words and no hits; repeated rows are judged one by one; an empty benchmark
hits nothing; further columns of the input pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import materialize, release

#: Words are runs of digits, ASCII letters (lower-cased) and anything beyond ASCII; on UTF-8 that is a byte map.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
#: The most words of test items in one broadcast automaton (some 300 bytes a word).
MAX_ITEM_WORDS = 1_000_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the word ids of all items, with the items that reach each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for key, item in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item]
            last = 0
            for c in codes:
                last = self._extend(last, c)
            coded.append((str(key), codes))
        #: items whose windows end in a state: full windows by state, shorter whole items by state and length
        self.items: list[set[str]] = [set() for _ in self.next]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for key, codes in coded:
            state = 0
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                if n >= window:
                    at = state
                    while at > 0 and self.length[at] >= window and key not in self.items[at]:
                        self.items[at].add(key)
                        at = self.link[at]
            if 0 < len(codes) < window:
                self.short.setdefault(state, []).append((len(codes), key))
        self.least = min([window, *(n for found in self.short.values() for n, _ in found)])

    def _extend(self, last: int, c: int) -> int:
        following = self.next
        if c in following[last]:
            q = following[last][c]
            return q if self.length[last] + 1 == self.length[q] else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = following[p][c]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._clone(p, c, q)
        else:
            self.link[new] = 0
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items that occur."""
        if not tokens or not self.vocabulary:
            return [], set()
        known = self.vocabulary.get
        ids = np.array([known(w, -1) for w in tokens], dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:  # an unknown word ends every match, so shorter runs can't hold a window
                self._run(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _run(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        following, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        state = long = 0
        for i, c in enumerate(ids, at + 1):
            while state and c not in following[state]:
                state = link[state]
                long = length[state]
            if c in following[state]:
                state = following[state][c]
                long += 1
            reach = 0
            if long >= window:
                reach, top = window, state
                while length[link[top]] >= window:
                    top = link[top]
                found |= self.items[top]
            if short:
                up = state
                while up:
                    for n, key in short.get(up, ()):
                        if n <= long:
                            found.add(key)
                            reach = max(reach, n)
                    up = link[up]
            if reach:
                if spans and spans[-1][1] >= i - reach:
                    start = min(spans[-1][0], i - reach)
                    spans.pop()
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
                else:
                    spans.append((i - reach, i))


def parts(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", most: int | None = None) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items with their words, in lists of ``most`` words at most, one after the other; one list at least.

    A longer item is cut into pieces that overlap by all but one word of a window, so every window is in one."""
    most = max(most or MAX_ITEM_WORDS, window)
    items = benchmark.select(F.col(id_col).cast("string").alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for k, t in items.toLocalIterator():
        found = words(bytes(t))
        for at in range(0, max(min(1, len(found)), len(found) - window + 1), most - window + 1):
            piece = found[at : at + most]
            if size + len(piece) > most:
                yield held
                held, size = [], 0
            held.append((k or "", piece))
            size += len(piece)
    yield held


def united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both lists of spans as one, in which spans that meet are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


#: Columns that carry what the parts of the benchmark before the last one have found.
_STARTS, _ENDS, _ITEMS = "_hit_starts", "_hit_ends", "_hit_items"
_CARRIED = [T.StructField(_STARTS, T.ArrayType(T.LongType())), T.StructField(_ENDS, T.ArrayType(T.LongType())), T.StructField(_ITEMS, T.ArrayType(T.StringType()))]


def _carried(batch: pa.RecordBatch) -> list[tuple[list[tuple[int, int]], set[str]]]:
    if _STARTS not in batch.schema.names:
        return [([], set())] * batch.num_rows
    columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (_STARTS, _ENDS, _ITEMS))
    return [(list(zip(a, b, strict=True)), set(x)) for a, b, x in zip(*columns, strict=True)]


def _before_last(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, Broadcast]:
    """The documents with what all parts of the benchmark but the last have found, and the last one's automaton.

    Every part is one pass over the documents, whose table is written before the next, so an executor holds one
    automaton at a time. A benchmark of one part leaves the documents as they are."""
    at, width = docs.columns.index("text"), len(docs.columns)
    context = docs.sparkSession.sparkContext
    lists = parts(benchmark, window)
    frame, items = docs, next(lists)
    for following in lists:
        model = context.broadcast(SuffixAutomaton(sorted(items), window))

        def scan(batches: Iterator[pa.RecordBatch], model: Broadcast = model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text, (spans, found) in zip(batch.column(at), _carried(batch), strict=True):
                    raw = text.as_py()
                    new, more = model.value.match(words(raw.encode() if isinstance(raw, str) else raw))
                    rows.append((united(spans, new), sorted(found | more)))
                longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
                carried = [pa.array([[x for x, _ in s] for s, _ in rows], longs), pa.array([[y for _, y in s] for s, _ in rows], longs), pa.array([i for _, i in rows], strings)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *carried], names=[*batch.schema.names[:width], _STARTS, _ENDS, _ITEMS])

        new = materialize(frame.mapInArrow(scan, T.StructType([*docs.schema.fields, *_CARRIED])), "decontam")
        model.destroy()
        if frame is not docs:
            release(frame)
        frame, items = new, following
    return frame, context.broadcast(SuffixAutomaton(sorted(items), window))


_REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, occurring items and their digest."""
    frame, model = _before_last(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), benchmark, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.value.match
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, (before, already) in zip(batch.column(1), _carried(batch), strict=True):
                tokens = words(text.as_py())
                spans, found = match(tokens)
                spans, found = united(before, spans), already | found
                n = sum(b - a for a, b in spans)
                for to, x in zip(rows, (len(tokens), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=_REPORT.names)

    return frame.mapInArrow(scan, _REPORT)


def clean(text: str, model: SuffixAutomaton, most: float = 0.5, before: list[tuple[int, int]] | None = None) -> str | None:
    """The text without hit spans (those of ``before`` as well), each span's words and what lies between them; None (drop the document) if
    more than ``most`` of the words are hit."""
    raw = text.encode()
    tokens = words(raw)
    spans, _ = model.match(tokens)
    spans = united(before or [], spans)
    if not spans:
        return text
    if sum(b - a for a, b in spans) > most * len(tokens):
        return None
    starts, at, folded = [], 0, raw.translate(_FOLD)
    for w in tokens:
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = starts[b - 1] + len(tokens[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.5) -> DataFrame:
    """The documents with their columns: hit spans are cut out of the text (``n_chars``, if there, follows), and
    documents with more than ``most`` of their words hit are dropped."""
    frame, model = _before_last(docs, benchmark, window)
    at, width = docs.columns.index("text"), len(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else clean(x, model.value, most, before) for x, (before, _) in zip(batch.column(at).to_pylist(), _carried(batch), strict=True)]
            keep = [not (new is None and old.is_valid) for new, old in zip(texts, batch.column(at), strict=True)]
            columns = batch.columns[:width]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:width])).filter(pa.array(keep, pa.bool_()))

    out = frame.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT s.r, s.i, s.n, v.item_id FROM spots s JOIN wins v ON s.n = v.n AND s.k = v.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.r = h.r LEFT JOIN named m ON d.r = m.r
"""
