"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words counts common subsequences of two and three letters, the words' ends among them, with up to
two letters skipped between them; each skipped letter halves the weight. A letter put into an insult, repeated
or left out therefore leaves most of its value. Letters set apart ("i d i o t", "i.d.i.o.t") are joined first, and
words that signs glue together are taken apart as well as together. Landmarks are words that the labels associate with
toxic documents, and the clean words closest to them; K_mm^(-1/2) maps a word's values to Nystroem features, of the
kernel and of its eighth power, which sees all but equal words only: the machine learns by both which insults stand
alone, so that their edits are insults too, and which have clean neighbours. Scores are map-only.

The machine is trained on labelled sentences, each a bag of its words and as toxic as the worst of them: all sentences
of clean documents count as clean; of a toxic document those count as toxic that hold an associated word, and the one
that the machine finds worst, round after round. Sentences whose insult has one letter more or less stand beside them.
A document's score is a logistic function, fitted to the documents, of its worst sentence's margin, of the sum of its
positive margins and of its length. The fit runs in one executor task over a written table; the driver sees the
landmarks and the weights only.

Null and empty texts score like a document without any landmark's word. Without labels of both kinds there
is no model and every score is 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import crc_mod, materialize, release

#: The most labelled documents of each kind that training takes, those whose ids hash lowest, and the most close
#: words of clean documents' sentences, documents being taken whole, by their hash.
MAX_TOXIC, MAX_CLEAN, MAX_CLEAN_WORDS = 2_000, 6_000, 40_000
LANDMARKS, NEAR_LANDMARKS = 96, 48
#: Words below FLOOR with all associated landmarks are no company for them, and are not looked at any further.
FLOOR, DECAY, SKIP, PAIR = 0.45, 0.5, 2, 0.5
THRESHOLD = 0.7
#: The kernel's power of the second half of the features.
POWER = 8
#: The margin asked for where an insult has been edited (1 and -1 for sentences as they are), and how much more toxic
#: documents weigh in the logistic function.
EDITED, TOXIC_WEIGHT = 2.0, 2.5
#: A word this close to a landmark of at least this association (in bits) counts as toxic in a toxic document.
CLOSE, CERTAIN = 0.85, 3.0
#: Longer words are looked at in windows of this many letters, longer sentences in parts of this many words.
LONG, SENTENCE = 24, 50
MAX_CACHED = 500_000

_SIGNS = "$@0123456789.,;:!?\"'()[]{}<>*#%&|/\\-_+=~^`"
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LOOKALIKE = str.maketrans("01345@$", "oieasas")


def letters(raw: str) -> str:
    """The letters of a word without what stands between them."""
    raw = raw.strip(_SIGNS)
    return raw.lower() if raw.isalpha() else _NOT_LETTER.sub("", raw.lower().translate(_LOOKALIKE))


def forms(raw: str) -> list[str]:
    """What a run of characters without blanks may stand for: its letters as one word, and its parts."""
    inner = raw.strip(_SIGNS)
    if inner.isalpha():
        found = [inner.lower()]
    else:
        parts = [p for p in _NOT_LETTER.split(inner.lower().translate(_LOOKALIKE)) if p]
        found = ["".join(parts), *parts] if len(parts) > 1 else parts
    first = raw[: len(raw) - len(raw.lstrip(_SIGNS))][-1:]
    if found and first and first in "01345@$":  # a sign may stand for the first letter, too
        found.append(first.translate(_LOOKALIKE) + found[0])
    out = []
    for w in found:
        out += [w] if len(w) <= LONG else [w[k : k + LONG] for k in range(0, len(w) - LONG // 2, LONG // 2)]
    return [w for w in out if len(w) > 1]


_APART = re.compile(r"(?<!\S)\w(?:\s+\w(?!\S)){2,}")


def spaced_out(text: str) -> list[str]:
    """Runs of three and more single letters, joined, also without one-letter words at their start."""
    out = []
    for m in _APART.finditer(text):
        joined = "".join(m[0].split())
        out += [joined[k:] for k in range(min(3, len(joined) - 2))]
    return out


_END = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> Iterator[str]:
    """Sentences and lines; long ones in parts."""
    for s in _END.split(text):
        found = s.split()
        if len(found) <= SENTENCE:
            yield s
        else:
            for k in range(0, len(found), SENTENCE):
                yield " ".join(found[k : k + SENTENCE])


class Kernel:
    """Values of words with the landmarks, 1 for equal words. The first ``toxic`` landmarks are the associated ones."""

    def __init__(self, landmarks: list[str], toxic: int | None = None):
        self.size, self.toxic = len(landmarks), len(landmarks) if toxic is None else toxic
        tok, feature, weight = _subsequences(landmarks)
        key, inverse = np.unique(tok.astype(np.int64) << 18 | feature, return_inverse=True)
        sums = np.bincount(inverse, weight)
        norm = np.sqrt(np.bincount(key >> 18, sums**2, minlength=self.size))
        # for each subsequence the landmarks that have it, with their weights
        order = np.lexsort((key >> 18, key & 0x3FFFF))
        self.landmark = (key >> 18)[order]
        self.weight = (sums / np.maximum(norm, 1e-12)[key >> 18])[order]
        count = np.bincount(key & 0x3FFFF, minlength=1 << 18)
        self.count, self.start = count, np.cumsum(count) - count
        mine = self.landmark < self.toxic
        self.most = np.zeros(1 << 18)
        np.maximum.at(self.most, (key & 0x3FFFF)[order][mine], self.weight[mine])

    def values(self, found: list[str], floor: float = FLOOR) -> np.ndarray:
        """A row for each word; zeros where no associated landmark reaches the floor."""
        out = np.zeros((len(found), self.size), dtype=np.float32)
        for at in range(0, len(found), 4000):
            out[at : at + 4000] = self._values(found[at : at + 4000], floor)
        return out

    def _values(self, found: list[str], floor: float) -> np.ndarray:
        n = len(found)
        out = np.zeros((n, self.size), dtype=np.float32)
        tok, feature, weight = _subsequences(found)
        if not len(tok):
            return out
        least = np.sqrt(np.bincount(tok, weight**2, minlength=n))  # equal subsequences only make the true norm larger
        # no landmark's value is over the sum of the largest weights, so most words are done here
        some = (np.bincount(tok, weight * self.most[feature], minlength=n) >= floor * least) & (least > 0)
        mine = some[tok]
        tok, feature, weight = tok[mine], feature[mine], weight[mine]
        if not len(tok):
            return out
        place = np.cumsum(some) - 1
        rows = np.flatnonzero(some)
        key, inverse = np.unique(place[tok] << 18 | feature, return_inverse=True)
        sums = np.bincount(inverse, weight)
        tok, feature = key >> 18, key & 0x3FFFF
        norm = np.sqrt(np.bincount(tok, sums**2, minlength=len(rows)))
        hit = np.flatnonzero(self.count[feature])
        times = self.count[feature[hit]]
        where = np.repeat(self.start[feature[hit]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        spot = np.repeat(tok[hit] * self.size, times) + self.landmark[where]
        values = np.bincount(spot, np.repeat(sums[hit], times) * self.weight[where], minlength=len(rows) * self.size).reshape(len(rows), self.size) / norm[:, None]
        close = values[:, : self.toxic].max(axis=1) >= floor
        out[rows[close]] = values[close]
        return out


def _subsequences(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all subsequences of two and three letters with at most SKIP letters between them;
    a word's ends are letters of their own."""
    reach = 2 * (SKIP + 1)
    c = np.frombuffer(("\x02" + ("\x03" + "\0" * (SKIP + 1) + "\x02").join(found) + "\x03" + "\0" * reach).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(c < 4, c * (c > 0), np.where((c >= 97) & (c <= 122), c - 93, 30 + c % 34)).astype(np.int32)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + SKIP + 3
    n = max(0, len(c) - reach)
    word = np.repeat(np.arange(len(found), dtype=np.int32), lengths)
    word = np.concatenate([word, np.full(max(0, n - len(word)), max(0, len(found) - 1), dtype=np.int32)])[:n]
    a = c[:n]
    parts = []
    for i in range(1, SKIP + 2):
        b = c[i : i + n]
        two = (a > 0) & (b > 0)
        ok = np.flatnonzero(two)
        parts.append((word[ok], a[ok] << 12 | b[ok] << 6, np.full(len(ok), PAIR * DECAY ** (i - 1))))
        for j in range(1, SKIP + 3 - i):
            d = c[i + j : i + j + n]
            ok = np.flatnonzero(two & (d > 0))
            parts.append((word[ok], a[ok] << 12 | b[ok] << 6 | d[ok], np.full(len(ok), DECAY ** (i + j - 2))))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Reader:
    """What ``fold`` makes of the values of a text's words with the landmarks, kept from text to text."""

    def __init__(self, kernel: Kernel, fold):
        self.kernel, self.fold = kernel, fold
        self.known: dict[str, object] = {}

    def of(self, raws: list[str]) -> list:
        """What is kept of each word that has a value, as often as it occurs."""
        known = self.known
        todo = [r for r in set(raws) if r not in known]
        if len(known) + len(todo) > MAX_CACHED:
            self.known = known = {}
            todo = list(set(raws))
        if todo:
            # words as they are stand for themselves, others for the forms that they may have
            other = {r: forms(r) for r in todo if not (r.isalpha() and r.islower() and 1 < len(r) <= LONG)}
            parts = [r for r in todo if r not in other]
            parts += {f for found in other.values() for f in found if f not in known}.difference(parts)
            known.update(dict.fromkeys(parts))
            for at in range(0, len(parts), 20_000):
                values = self.kernel.values(parts[at : at + 20_000])
                some = np.flatnonzero(values.any(axis=1))
                for k, x in zip(some.tolist(), self.fold(values[some]), strict=True):
                    known[parts[at + k]] = x
            for r, found in other.items():
                best = None
                for x in map(known.__getitem__, found):
                    best = x if best is None else best if x is None else np.maximum(best, x)
                known[r] = best
        return [x for x in map(known.__getitem__, raws) if x is not None]


@dataclass
class Model:
    landmarks: list[str]
    toxic: int
    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def probability(self, margins: list[float], n_words: int) -> float:
        z = float((_evidence(np.array([max(margins, default=0.0)]), np.array([sum(max(0.0, m + self.bias) for m in margins)]), np.array([n_words]), self.bias) @ self.logistic)[0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _evidence(worst: np.ndarray, total: np.ndarray, n_words: np.ndarray, bias: float) -> np.ndarray:
    """What the logistic function takes of documents: the worst margin, the sum of the positive ones, and the length."""
    return np.stack([np.maximum(worst, 0) + bias, np.log1p(total), np.log(n_words + 30.0), np.ones(len(worst))], axis=1)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc, y and text of a bounded number of labelled documents outside the held-out fold."""
    ids = labels.where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("y"))
    order = (F.xxhash64(F.col("label_id"), F.lit(29)), F.col("label_id"))
    some = ids.where("y = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(ids.where("y = 0").orderBy(*order).limit(MAX_CLEAN))
    return docs.join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select(F.col("label_id").cast("string").alias("doc"), "y", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _landmarks(sample: DataFrame) -> tuple[list[tuple[str, float]], list[str]]:
    """Words by their association with toxic documents, and the words of clean ones that are closest to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, found = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = {w for raw in set(text.split()) for w in forms(raw) if 3 <= len(w) < LONG}
                found += distinct
                ys += [y] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ys, pa.int32())], names=["word", "y"])

    per = materialize(sample.select("y", "text").mapInArrow(run, "word string, y int").groupBy("word").agg(F.sum("y").cast("long").alias("dp"), F.sum(1 - F.col("y")).cast("long").alias("dn")), "words")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    lift = F.log2(((F.col("dp") + 0.5) / (pos + 1)) / ((F.col("dn") + 0.5) / (neg + 1)))
    enough = max(3, pos // 1000)
    top = per.withColumn("lift", lift).where((F.col("dp") >= enough) & (F.col("lift") >= CERTAIN)).orderBy((F.col("lift") * F.sqrt("dp")).desc(), "word").limit(LANDMARKS).collect()
    toxic = [(r["word"], r["lift"]) for r in top]
    if not toxic or not neg:
        return [], []
    kernel = Kernel([w for w, _ in toxic])

    def closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = kernel.values(batch.column(0).to_pylist()).max(axis=1, initial=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value * np.log1p(batch.column(1).to_numpy()), pa.float64())], names=["word", "close"])

    clean = per.where(F.col("dp") * neg <= 2 * F.col("dn") * pos).select("word", "dn").mapInArrow(closeness, "word string, close double")
    near = [r["word"] for r in clean.where("close > 0").orderBy(F.col("close").desc(), "word").limit(NEAR_LANDMARKS).collect()]
    release(per)
    return toxic, near


def _edits(word: str) -> list[str]:
    """The word with a letter put in, repeated, and left out inside it."""
    out = [word[:k] + "xqzkv"[k % 5] + word[k:] for k in range(1, len(word))]
    out += [word[:k] + word[k] + word[k:] for k in range(len(word))]
    return out + ([word[:k] + word[k + 1 :] for k in range(1, len(word) - 1)] if len(word) > 4 else [])


def _fit_machine(x: np.ndarray, s: np.ndarray, each: np.ndarray, penalty: float = 5e-5) -> tuple[np.ndarray, float]:
    """A linear machine by the squared hinge loss with accelerated gradient steps. ``s`` holds the margins asked for."""
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    sign, far, each = np.sign(s).astype(np.float32), np.abs(s).astype(np.float32), each.astype(np.float32)
    w = v = np.zeros(x1.shape[1], dtype=np.float32)
    step = np.float32(1 / (2 * np.linalg.norm((x1 * each[:, None]).T @ x1, 2) + penalty))
    for k in range(400):
        gap = np.maximum(0, far - sign * (x1 @ v))
        new = v - step * (np.float32(penalty) * v - 2 * x1.T @ (each * sign * gap))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic function's weights, by Newton steps; the margin's never falls below a tenth."""
    w, each = np.array([1.0, 0.0, 0.0, 0.0]), np.where(y == 1, TOXIC_WEIGHT, 1.0)
    ridge = np.diag([1e-3, 1e-3, 1e-3, 1e-9]) * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        move = np.linalg.solve((x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (each * (p - y)) + ridge @ w)
        w = w - move * min(1.0, 2 / max(1e-12, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    w[0], w[1] = max(w[0], 0.1), max(w[1], 0.0)
    return w


def features(values: np.ndarray) -> np.ndarray:
    return np.hstack([values, values**POWER])


def _whitened(k: np.ndarray) -> np.ndarray:
    """k^(-1/2), without the directions that hardly vary."""
    values, vectors = np.linalg.eigh(k.astype(np.float64))
    keep = values > 1e-3
    return (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)


def _fit(doc: np.ndarray, y: np.ndarray, n_words: np.ndarray, rows: np.ndarray, words: list[str], lift: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the landmarks' features, the bias, and the logistic function. ``doc`` numbers the rows' documents;
    a document without any close word has one row of zeros."""
    kernel = Kernel(words, len(lift))
    k = kernel.values(words, 0.0)
    plain, sharp = _whitened(k), _whitened(k**POWER)
    whiten = np.zeros((2 * len(words), plain.shape[1] + sharp.shape[1]), dtype=np.float32)
    whiten[: len(words), : plain.shape[1]], whiten[len(words) :, plain.shape[1] :] = plain, sharp
    heads = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    labels = y[heads]
    edits = [(e, i) for i in range(len(lift)) for e in _edits(words[i])]
    near = kernel.values([e for e, _ in edits], 0.0)
    own = near[np.arange(len(edits)), [i for _, i in edits]]
    # an edit that is a clean word, or closer to one, is no insult
    apart = near[:, len(lift) :].max(axis=1, initial=0) < own
    variants = features(near[apart]) @ whiten
    # insults of many documents weigh most
    held = ((rows[:, : len(lift)] >= CLOSE) & (y == 1)[:, None]).sum(axis=0) + 1.0
    weight = (held**2)[[i for _, i in edits]][apart]
    sure = (y == 1) & (rows[:, : len(lift)].max(axis=1, initial=0) >= CLOSE)  # words that make their sentence toxic
    z = features(rows) @ whiten
    margin = (rows[:, : len(lift)] * lift).max(axis=1, initial=0).astype(np.float64)
    w, bias = np.zeros(z.shape[1]), 0.0
    for _ in range(3):
        worst = (margin >= np.repeat(np.maximum.reduceat(margin, heads), np.diff([*heads, len(doc)]))) & rows.any(axis=1)
        use = (y == 0) | sure | (worst & (y == 1))
        good, bad = max(1, (y[use] == 0).sum()), max(1, (y[use] == 1).sum())
        x = np.concatenate([z[use], variants])
        asked = np.concatenate([np.where(y[use] == 1, 1, -1), np.full(len(variants), EDITED)])
        share = np.concatenate([np.where(y[use] == 1, 0.3 / bad, 0.55 / good), 0.15 * weight / max(1.0, weight.sum())])
        w, bias = _fit_machine(x, asked, share)
        margin = z @ w
    top = np.maximum.reduceat(margin, heads)
    total = np.add.reduceat(np.maximum(0, margin + bias), heads)
    return whiten.astype(np.float64) @ w, bias, _calibrate(_evidence(top, total, n_words[heads], bias), labels.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = materialize(_sample(docs, labels), "toxic-sample")
    toxic, near = _landmarks(sample)
    if not toxic:
        release(sample)
        return None
    words, lift = [*(w for w, _ in toxic), *near], np.array([v for _, v in toxic], dtype=np.float32)
    kernel = Kernel(words, len(lift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kernel, lambda values: list(values.copy()))
        for batch in batches:
            names, ys, sizes, out = [], [], [], []
            for name, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = [x.tobytes() for s in sentences(text) for x in reader.of(s.split() + spaced_out(s))] or [b""]
                names += [name] * len(found)
                ys += [y] * len(found)
                sizes += [len(text.split())] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc", "y", "n", "x"])

    rows = materialize(sample.mapInArrow(run, "doc string, y int, n long, x binary"), "toxic-rows")
    chance = min(1.0, MAX_CLEAN_WORDS / max(1, rows.where("y = 0").count()))
    # one chance for all rows of a document, as the sum of its margins counts
    some = rows.where((F.col("y") == 1) | (F.pmod(F.xxhash64("doc", F.lit(31)), F.lit(1_000_000)) < int(chance * 1_000_000)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ys, sizes, xs = [], [], [], []
        for batch in batches:
            for to, column in zip((names, ys, sizes, xs), batch.columns, strict=True):
                to += column.to_pylist()
        order = sorted(range(len(xs)), key=lambda k: (ys[k], names[k], xs[k]))
        none = bytes(4 * len(words))
        x = np.frombuffer(b"".join(xs[k] or none for k in order), dtype=np.float32).reshape(-1, len(words))
        y, n = (np.array([v[k] for k in order], dtype=np.int64) for v in (ys, sizes))
        number = {name: i for i, name in enumerate(sorted(set(names)))}
        doc = np.array([number[names[k]] * 2 + ys[k] for k in order], dtype=np.int64)
        w, bias, logistic = _fit(doc, y, n, x, words, lift)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias]), pa.array([logistic.tolist()], pa.list_(pa.float64()))], names=["w", "bias", "logistic"])

    found = some.coalesce(1).mapInArrow(fit, "w array<double>, bias double, logistic array<double>").first()
    release(rows, sample)
    return Model(words, len(lift), np.array(found["w"]), found["bias"], np.array(found["logistic"]))


def _scorer(model: Model | None):
    """A function from a text to its score, to be made once in each task."""
    if model is None:
        return lambda text: 0.0
    weights = model.weights.astype(np.float32)
    reader = Reader(Kernel(model.landmarks, model.toxic), lambda values: (features(values) @ weights).tolist())

    def of(text: str) -> float:
        raws = text.split()
        return model.probability(reader.of(raws + spaced_out(text)), len(raws))

    return of


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, with their columns, that score below the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py() or "") < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
