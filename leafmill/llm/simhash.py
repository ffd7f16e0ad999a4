"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Each bit position carries a non-zero vector of r + 1 bits; the mask of a non-zero vector v keeps the positions
whose vector is odd against v. Any r positions are all masked out by some v, so two fingerprints within r bits
agree under some of the 2^(r+1) - 1 masks: no pair within the radius is missed.

``components`` links fingerprints within two bits exactly. Fingerprints without company in any table are done.
For the others, x and y are within two bits if and only if flipping at most one bit of each gives the same
word z, so each goes to its z's (only bits outside the mask need flipping) and is linked to the smallest there.
A z has at most 65 different fingerprints, so no group grows with the data, and no pairs are made.

``near_duplicates`` takes texts whose fingerprints are linked so as candidates, and decides by the exact resemblance of
their five-word shingles. Two bits are far less than resemblance 0.8 allows, so texts that share a band of MinHash
values of these shingles are candidates as well; no pair that fingerprints don't link is lost for that.

Nulls and empty texts have fingerprint zero and form one group like any equal texts. Rows that repeat an id with
other texts are deduplicated by their own text; null ids are linked but never name a group if another id can.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import collect_garbage, materialize, release

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def covering_masks(radius: int = 2, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks; signed, as Spark's longs are."""
    top = 2 ** (radius + 1)
    out = []
    for v in range(1, top):
        mask = sum(1 << i for i in range(bits) if ((1 + i % (top - 1)) & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint(text: bytes, ngram: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False)) if len(words) >= ngram else [b" ".join(words)]
    raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 1 << 19):
        bits += np.unpackbits(np.frombuffer(raw[at : at + (1 << 19)], dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits > len(raw) // 8 / 2).view(">i8")[0])


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id and fp (a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), ngram) for t in batch.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between fingerprints (column fp, distinct) that connect exactly those within two bits."""
    masks = covering_masks(2)
    tables = distinct.select("fp", F.posexplode(F.array([F.lit(m) for m in masks])).alias("t", "mask"))
    tables = tables.select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = materialize(tables.groupBy("t", "key").count().where("count > 1").select(F.col("t").alias("bt"), F.col("key").alias("bkey")), "buckets")
    company = tables.join(shared, (F.col("t") == F.col("bt")) & (F.col("key") == F.col("bkey"))).select("fp", "t")
    free = F.array([F.array([F.lit(0)] + [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64) if not m >> i & 1]) for m in masks])
    spots = company.select("fp", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip"))
    spots = spots.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    least = spots.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last")
    # a z has 65 fingerprints at most, so neither side of this join has a hot key
    return spots.join(least.select(F.col("z").alias("lz"), "a"), F.col("z") == F.col("lz")).where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def _settled(step: DataFrame) -> DataFrame:
    """The map (node, root) followed to its end. Roots are followed in strides that double, so a path of n nodes takes
    log n joins; a map whose roots are their own roots takes none."""
    while True:
        later = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        moved = step.select("root").distinct().join(later.where("n2 != r2"), F.col("root") == F.col("n2")).limit(1)
        if not moved.count():
            return step
        new = materialize(step.join(later, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root")), "settled")
        release(step)
        step = new


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches.

    In every round each node takes its smallest neighbour (or itself), these steps are followed to their end, and
    the links move there; links whose ends meet vanish. Every tree of steps has two nodes at least, so the nodes halve
    from round to round. The maps of the rounds are applied one after the other. Every map is written, so a
    lost executor repeats one round at most, and joins have two shuffled sides, whose skew Spark splits.
    """
    current = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v"), "links")
    out = None
    while current.limit(1).count():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = _settled(materialize(both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("root")), "round"))
        left = step.select(F.col("node").alias("lu"), F.col("root").alias("ru"))
        right = step.select(F.col("node").alias("lv"), F.col("root").alias("rv"))
        moved = current.join(left, F.col("u") == F.col("lu")).join(right, F.col("v") == F.col("lv")).where("ru != rv")
        new = materialize(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        release(current)
        current = new
        if out is None:
            out = step
        else:
            later = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            new = materialize(out.join(later, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root")), "map")
            release(out, step)
            out = new
    release(current)
    if out is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).where(F.lit(False))
    return out


def components(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    fps = materialize(fingerprints(docs, ngram), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected(links(distinct.select("fp")))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = materialize(placed.select("fp", "root").join(names.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("fp").alias("named"), "component_id"), "names")
    return fps.join(names, F.col("fp") == F.col("named")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates: candidates by fingerprints, and by banded MinHash for pairs beyond two bits; shingle resemblance decides.

#: Bands a text and minima a band, words in a shingle, the least resemblance, and what the estimate must reach
#: before texts are compared. Texts with resemblance 0.8 share no band in (1 - 0.8^5)^32 = 3 of a million cases, and
#: their estimate from 160 minima is below 0.6 in less than one of ten million.
BANDS, ROWS, NGRAM, SIMILARITY, ESTIMATE = 32, 5, 5, 0.8, 0.6
_MINIMA = BANDS * ROWS
_ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = h + np.uint64((_ODD * (k + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_FACTORS = _mixed(np.arange(_MINIMA, dtype=np.uint64), 1)[:, None] | np.uint64(1)
_SHIFTS = _mixed(np.arange(_MINIMA, dtype=np.uint64), 2)[:, None]


def shingle_set(text: bytes, ngram: int = NGRAM) -> np.ndarray:
    """The distinct hashes of a text's word shingles in order; a shorter text is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    n = max(1, len(h) - ngram + 1)
    s = np.zeros(n, dtype=np.uint64)
    for i in range(min(ngram, len(h))):
        s = s * np.uint64(_ODD) + h[i : i + n]
    return np.unique(_mixed(s, 99))


def content_key(shingles: np.ndarray) -> int:
    """One number for all texts with the same shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63


def sketch(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """The bands of a set of shingles, as signed numbers, and a byte of each of its minima."""
    if not len(shingles):
        return [], bytes(_MINIMA)
    least = np.full(_MINIMA, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048] * _FACTORS + _SHIFTS).min(axis=1))
    bands = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        bands = _mixed(bands * np.uint64(_ODD) + column, 3)
    return bands.view(np.int64).tolist(), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def _resemblance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """What the minima say of the resemblance, before the texts are compared."""
    x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(-1, _MINIMA)
    y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(-1, _MINIMA)
    return (x == y).mean(axis=1)


def _texts_of(docs: DataFrame, keys: DataFrame, ngram: int) -> DataFrame:
    """c and text, once for each of the content keys (column need); a table in the shared folder."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task gives a text once, so copies don't meet in one place
        for batch in batches:
            keys, texts = [], []
            for x in batch.column(0):
                key = content_key(shingle_set(x.as_py(), ngram))
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(x.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["c", "text"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(keyed, "c long, text binary")
    return materialize(texts.join(keys.hint("merge"), F.col("c") == F.col("need"), "left_semi").groupBy("c").agg(F.first("text").alias("text")), "pool")


def _verified(pool: DataFrame, pairs: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """Which of the pairs (a, b) of content keys resemble each other in fact, by the shingles of their texts in ``pool``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = mine = None  # rows of one lead mostly follow one another
        for batch in batches:
            same = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if mine is None or a != last:
                    last, mine = a, shingle_set(x.as_py(), ngram)
                other = shingle_set(y.as_py(), ngram)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                same.append(both / max(1, len(mine) + len(other) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_())], names=["a", "b", "same"])

    left = pool.select(F.col("c").alias("ca"), F.col("text").alias("text1")).hint("merge")
    right = pool.select(F.col("c").alias("cb"), F.col("text").alias("text2")).hint("merge")
    out = pairs.join(right, F.col("b") == F.col("cb")).join(left, F.col("a") == F.col("ca")).select("a", "b", "text1", "text2")
    return materialize(out.mapInArrow(judge, "a long, b long, same boolean"), "verified")


#: Counters in each of the two tables that say how frequent a shingle is in the pool; the tables are broadcast.
COUNTERS = 1 << 20


def _spots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64), (shingles >> np.uint64(40) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _prefixes(pool: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """Of each text (c) with n shingles the first ones in an order common to all texts, rare ones first: key, c, n and
    the place (at) in this order.

    Two texts whose resemblance reaches ``similarity`` share one of the first n - similarity * n + 1 of both, as what
    is left behind would be too little. Any order is exact; counts that collide only make the places less rare.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * COUNTERS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(1):
                one, two = _spots(shingle_set(x.as_py(), ngram))
                np.add.at(total, one, 1)
                np.add.at(total, two + COUNTERS, 1)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 100_000]), pa.array(total[some[k : k + 100_000]])], names=["spot", "k"])

    found = pool.mapInArrow(count, "spot long, k long").groupBy("spot").agg(F.sum("k").alias("k")).where("k > 1")
    found = found.select(F.col("spot").cast("int"), F.least("k", F.lit(2**31 - 1)).cast("int").alias("k")).toArrow()  # 2 * COUNTERS rows at most
    table = np.ones(2 * COUNTERS, dtype=np.int32)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    counts = pool.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                keys, owners, sizes, places = [], [], [], []
                for c, x in zip(batch.column(0)[k : k + 64].to_pylist(), batch.column(1)[k : k + 64], strict=True):
                    found = shingle_set(x.as_py(), ngram)
                    n = len(found)
                    one, two = _spots(found)
                    often = np.minimum(counts.value[one], counts.value[two + COUNTERS])
                    first = found[np.lexsort((found, often))[: n - math.ceil(similarity * n) + 1]]
                    keys.append(first.view(np.int64))
                    owners.append(np.full(len(first), c, dtype=np.int64))
                    sizes.append(np.full(len(first), n, dtype=np.int64))
                    places.append(np.arange(len(first), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (keys, owners, sizes, places)], names=["key", "c", "n", "at"])

    return materialize(pool.mapInArrow(run, "key long, c long, n long, at long"), "prefixes")


def _linked_texts(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts (c) and their fingerprints (fp): the texts of each component of linked fingerprints (key, c); and the
    text that each is first compared with (c, a): the smallest of its own fingerprint, or else that of the smallest
    fingerprint within two bits. Texts whose fingerprints have no company are in neither."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("c").alias("lead"), F.max("c").alias("last")), "distinct")
    near = materialize(links(distinct.select("fp")), "near")
    roots = connected(near)
    company = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").where("root is not null or lead < last")
    company = materialize(company.select(F.col("fp").alias("cfp"), "lead", F.coalesce("root", "fp").alias("key")), "company")
    linked = materialize(prints.join(company.hint("merge"), F.col("fp") == F.col("cfp")).select("key", "c", "lead"), "linked")
    least = near.groupBy("b").agg(F.min("a").alias("a"))
    least = least.join(company.select("cfp", F.col("lead").alias("lead_a")).hint("merge"), F.col("a") == F.col("cfp")).select("b", "lead_a")
    least = least.join(company.select("cfp", F.col("lead").alias("c")).hint("merge"), F.col("b") == F.col("cfp")).select("c", F.col("lead_a").alias("a"))
    first = materialize(linked.select("c", F.col("lead").alias("a")).unionByName(least).where("c != a").distinct(), "first")
    members = materialize(linked.select("key", "c").distinct(), "linked")
    release(distinct, near, roots, company, linked)
    return members, first


def text_groups(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c, t) of every row, c the content key of its text and t the hash of the text as it is; and
    (c, root, group_id): texts that resemble each other, directly or over others, share a root and the smallest id of
    them all.

    Texts with equal shingles are one from the start. At first every text is compared with one other: one whose fingerprint
    is within two bits, or where there is none, the smallest that it shares a band with. This settles most groups. The
    texts of components of fingerprints and of bands that still hold several groups go on: their
    rare shingles make buckets, so that texts meet by what is particular to them and not by what all copies share, and
    the places of a shared shingle bound the resemblance before anything is compared. In every round, each bucket
    names leads, four times as many as in the last one and first those that have company, and every member of another
    group is compared with them. Then leads leave the bucket, as they have been compared with all members; the
    others stay, linked or not. A bucket ends when what is left of it is one group, so no unlinked pair stays
    undecided, and the work is linear where a bucket holds one group. Pairs whose estimate is far below ``similarity``
    are refused by it; the texts of all others are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, found = [], [], []
            for t in batch.column(2):
                text = t.as_py()
                shingles = shingle_set(text, ngram)
                keys.append(content_key(shingles))
                prints.append(fingerprint(text))
                found.append(sketch(shingles))
            made = [pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array([b for b, _ in found], pa.list_(pa.int64())), pa.array([m for _, m in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "t", "c", "fp", "bands", "sig"])

    least = similarity - (SIMILARITY - ESTIMATE)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = _resemblance(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= least if batch.num_rows else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_())], names=["a", "b", "same"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("t"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    all_docs = materialize(rows.mapInArrow(run, "doc_id long, t long, c long, fp long, bands array<long>, sig binary"), "sketches")
    texts = materialize(all_docs.groupBy("c").agg(F.min("doc_id").alias("first_id"), F.min("sig").alias("sig"), F.min("bands").alias("bands")), "texts")
    rows = materialize(all_docs.select("doc_id", "c", "t"), "rows")
    prints = materialize(all_docs.select("c", "fp").distinct(), "prints")  # texts with equal shingles can differ in repeats
    release(all_docs)
    linked, first = _linked_texts(prints)
    release(prints)
    members = texts.select("c", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("key").alias("skey"), "lo").hint("merge")
    bands = materialize(members.join(shared, F.col("key") == F.col("skey")).select("key", "c", "lo"), "bands")
    members = bands.select("key", "c").unionByName(linked)
    signatures = texts.select(F.col("c").alias("sc"), "sig")
    decided: list[DataFrame] = []
    roots = pool = None

    def decide(pairs: DataFrame) -> None:
        """Compares the pairs (a, b) that no round has compared, and joins the groups of those that resemble each other."""
        nonlocal roots
        if decided:  # in one join, as each would make all pairs of a round anew
            old = reduce(DataFrame.unionByName, decided).select(F.col("a").alias("da"), F.col("b").alias("db"))
            pairs = pairs.join(old.hint("merge"), (F.col("a") == F.col("da")) & (F.col("b") == F.col("db")), "left_anti")
        pairs = pairs.join(signatures.hint("merge"), F.col("b") == F.col("sc")).select("a", "b", F.col("sig").alias("sig1"))
        pairs = pairs.join(signatures.hint("merge"), F.col("a") == F.col("sc")).select("a", "b", "sig1", "sig")
        judged = materialize(pairs.mapInArrow(judge, "a long, b long, same boolean"), "judged")
        near = judged.where("same").select("a", "b")
        if near.limit(1).count():
            texts = pool if pool is not None else _texts_of(docs, near.select(F.explode(F.array("a", "b")).alias("need")).distinct(), ngram)
            verified = _verified(texts, near, ngram, similarity)
            new = materialize(judged.where("not same").unionByName(verified), "decided")
            release(judged, verified, texts if pool is None else None)
            judged = new
        decided.append(judged)
        edges = judged.where("same").select("a", "b")
        if roots is not None:
            edges = edges.unionByName(roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
        new = materialize(connected(edges), "roots")
        release(roots)
        roots = new

    def open_buckets(left: DataFrame) -> DataFrame:
        """The members (key, c, and what else there is) with their groups, of buckets that hold several groups."""
        more = [x for x in left.columns if x in ("n", "at")]
        left = left.join(roots.hint("merge"), F.col("c") == F.col("node"), "left")
        left = materialize(left.select("key", "c", F.coalesce("root", "c").alias("root"), F.col("root").isNull().alias("alone"), *more), "left")
        mixed = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("key").alias("mkey")).hint("merge")
        new = materialize(left.join(mixed, F.col("key") == F.col("mkey")).select("key", "c", "root", "alone", *more), "members")
        release(left)
        return new

    if members.limit(1).count():
        others = bands.groupBy("c").agg(F.min("lo").alias("a")).where("a < c")
        others = others.join(first.select(F.col("c").alias("fc")).hint("merge"), F.col("c") == F.col("fc"), "left_anti")
        decide(first.unionByName(others).select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct())
        members = open_buckets(members)
        release(bands, linked, first)
        pool = _texts_of(docs, members.select(F.col("c").alias("need")).distinct(), ngram)
        release(members)
        prefixes = _prefixes(pool, ngram, similarity)
        members = open_buckets(prefixes)
        release(prefixes)
        collect_garbage(docs.sparkSession)
    wanted = 1
    while members.limit(1).count():
        # part by part, so that the leads of a large bucket are not looked for in one task
        part = F.pmod("c", F.lit(wanted)).alias("part")
        leads = members.groupBy("key", part).agg(F.min(F.struct("alone", "c", "root", "n", "at")).alias("x"))
        leads = materialize(leads.select(F.col("key").alias("lkey"), F.col("x.c").alias("lead"), F.col("x.root").alias("lead_root"), F.col("x.n").alias("lead_n"), F.col("x.at").alias("lead_at")), "leads")
        # the first shingle that both have leaves this much to share
        most = F.least(F.col("n") - F.col("at"), F.col("lead_n") - F.col("lead_at"))
        enough = most * (1 + similarity) >= similarity * (F.col("n") + F.col("lead_n")) - 1e-6
        pairs = members.join(leads.hint("merge"), (F.col("key") == F.col("lkey")) & (F.col("root") != F.col("lead_root")) & enough)
        decide(pairs.select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct())
        done = leads.select("lkey", "lead").hint("merge")
        new = open_buckets(members.join(done, (F.col("key") == F.col("lkey")) & (F.col("c") == F.col("lead")), "left_anti").select("key", "c", "n", "at"))
        release(leads, members)
        members, wanted = new, wanted * 4
        collect_garbage(docs.sparkSession)
    release(pool)
    release(members, bands, linked, first, *decided)
    plain = texts.select("c", "first_id", F.col("c").alias("root"))
    if roots is not None:
        plain = texts.select("c", "first_id").join(roots, F.col("c") == F.col("node"), "left").select("c", "first_id", F.coalesce("root", "c").alias("root"))
    plain = materialize(plain, "placed")
    names = plain.groupBy("root").agg(F.min("first_id").alias("group_id")).withColumnRenamed("root", "r").hint("merge")
    groups = materialize(plain.join(names, F.col("root") == F.col("r")).select("c", "root", "group_id"), "groups")
    release(plain, roots, texts)
    return rows, groups


def text_key() -> Column:
    """The hash of the text column; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id): the smallest id of the texts that resemble a document, directly or over others; one
    row for each id."""
    rows, groups = text_groups(docs, ngram, similarity)
    groups = groups.withColumnRenamed("c", "pc").hint("merge")
    return rows.join(groups, F.col("c") == F.col("pc")).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def deduplicate(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with their columns, of which one of each group of texts stays: that with the smallest id, and
    of texts that share this id the one with the smallest keys. Null ids come last. Rows that repeat an id and a text
    are one; where no row does, the step that removes them is left out, as it would change nothing."""
    rows, groups = text_groups(docs, ngram, similarity)
    each = rows.groupBy("doc_id", "c", "t").agg(F.count("*").alias("n"))
    each = materialize(each.join(groups.withColumnRenamed("c", "pc").hint("merge"), F.col("c") == F.col("pc")).select("doc_id", "c", "t", "n", "root"), "near")
    release(rows, groups)
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c", "t")).alias("best"))
    best = best.select(F.col("root").alias("r"), "best").hint("merge")
    lost = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("t") == F.col("best.t")))
    # what goes grows with the input, so it is never broadcast
    gone = materialize(each.join(best, F.col("root") == F.col("r")).where(lost).select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")), "gone").hint("merge")
    repeated = each.where("n > 1").limit(1).count() > 0
    release(each)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("t"))
    kept = kept.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left_anti")
    return (kept.dropDuplicates(["id", "t"]) if repeated else kept).select("row.*")
