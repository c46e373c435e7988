"""Quality classifier: random-indexing word vectors, pooled, and a small network.

1. ``word_vectors``: every word has a sparse random index vector (a few +1 and
   -1 among ``DIMS`` places); a word's vector is the sum of the index vectors of
   the words around all its occurrences in the corpus, itself included. A word
   is two tokens, its letters in lower case and its form (case and punctuation),
   both hashed to one of ``ROWS`` rows, so the table has a fixed size whatever
   the vocabulary. One Spark pass: tasks add up their rows in integers, which
   are summed by blocks of rows. Rows are then freed of the corpus mean and
   scaled to length one.
2. ``pool``: a document's mean vector of letters, mean vector of forms, spread
   of the letters' vectors and logarithm of its length.
3. ``train``: a two-layer network in numpy on a bounded sample of labelled
   documents (``PER_LABEL`` of each label, those with the smallest hash of
   their id; weights give back the labels' shares). A fifth of the sample is
   held apart: it picks the round to stop at and the temperature that divides
   the logit, by least log loss, so scores are calibrated probabilities.
4. ``Model.score`` scores all documents.

Label, language, source and id of a document are no inputs of its score.

Edge cases: a null or blank text has the pooled vector 0 and is scored; labels
of missing documents, null labels and null ids are left out; an id with several
labels has the least of them, one with several rows the text with the smallest
hash; with less than two labels in the sample every score is that label's (0.5
without any); repeated rows are scored each; a text of any length is worked on
in bounded slices cut at blanks (words beside a cut are not neighbours); an
empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_blobs, materialize

ROWS = 1 << 14            # rows of the word-vector table
DIMS = 64
ONES = 4                  # entries of an index vector that are not 0
BLOCK = 256               # rows sent together
SLICE = 1_000_000         # bytes of text worked on at once
LEXICON = 200_000         # words a task keeps hashed
PER_LABEL = 8_000         # most labelled documents of a label the network is fitted on
HIDDEN = 32
EPOCHS = 300
DECAY = 1e-4

_CORE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def index_vectors() -> np.ndarray:
    """The index vectors, the same in every process."""
    rng = np.random.default_rng(2024)
    out = np.zeros((ROWS, DIMS), np.int8)
    places = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :ONES]
    out[np.arange(ROWS)[:, None], places] = np.array([1, -1] * (ONES // 2), np.int8)
    return out


def _kind(core) -> bytes:
    return (b"9" if core.isdigit() else b"x" if core == core.lower() else
            b"XX" if len(core) > 1 and core == core.upper() else
            b"Xx" if core[1:] == core[1:].lower() else b"xX")


def letters_and_form(word: bytes) -> tuple[bytes, bytes]:
    """A word's letters and digits in lower case, and its form: case (``Xx``,
    ``x``, ``XX``, ``xX``, ``9``) with the punctuation (at most three bytes) on
    either side."""
    if word.isascii():
        core = word.strip(_MARKS)
        if not core:
            return b"", word[:4]
        low, at = core.lower(), word.index(core)
        return (low if low.isalnum() else b"".join(_CORE.findall(low)),
                word[:at][:3] + _kind(core) + word[at + len(core):][:3])
    core = word.strip(_MARKS)
    text, at = core.decode("utf-8", "replace"), word.index(core)
    return (b"".join(_CORE.findall(text.lower().encode())),
            word[:at][:3] + _kind(text) + word[at + len(core):][:3])


class Lexicon(dict):
    """Dense numbers of the words met so far, with their two rows."""

    def __init__(self):
        super().__init__()
        self.core, self.form = array("i"), array("i")

    def __missing__(self, word: bytes) -> int:
        core, shape = letters_and_form(word)
        self.core.append(zlib.crc32(core) % ROWS)
        self.form.append(zlib.crc32(shape, 0x5EED) % ROWS)
        at = self[word] = len(self)
        return at

    def trim(self) -> None:
        if len(self) > LEXICON:
            self.clear()
            self.core, self.form = array("i"), array("i")

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def rows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.core, np.int32)[numbers], np.array(self.form, np.int32)[numbers]


def _segments(texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    """(document, text) with long texts cut at blanks."""
    for i, t in enumerate(texts):
        t, at = t or b"", 0
        while len(t) - at > SLICE:
            cut = max(t.rfind(c, at + 1, at + SLICE) for c in (b" ", b"\n"))
            if cut < 0:
                break
            yield i, t[at:cut]
            at = cut
        yield i, t[at:] if at else t


def _slices(texts: list[bytes | None], words: Lexicon
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, starts, word numbers) of bounded runs of segments that have words."""
    docs, starts, flat, size = [], [], [], 0
    for i, t in _segments(texts):
        tokens = t.split()
        if tokens:
            docs.append(i)
            starts.append(len(flat))
            flat += tokens
            size += len(t)
        if size >= SLICE:
            yield np.array(docs), np.array(starts), words.numbers(flat)
            docs, starts, flat, size = [], [], [], 0
            words.trim()
    if flat:
        yield np.array(docs), np.array(starts), words.numbers(flat)
        words.trim()


def _contexts(index: np.ndarray, core: np.ndarray, shape: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of index vectors at a place (twice) and at the two beside it, as
    (DIMS, places)."""
    own = index.take(core, axis=1)
    own += index.take(shape, axis=1)
    beside = np.ones(len(core), np.int8)
    beside[starts] = 0                            # no neighbour before a text's first word
    out = own * np.int8(2)
    out[:, 1:] += own[:, :-1] * beside[1:]
    out[:, :-1] += own[:, 1:] * beside[1:]
    return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their columns of ``values``."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")          # ROWS fit; a radix sort
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order[first]], np.add.reduceat(values.take(order, axis=1), first, axis=1, dtype=np.int32)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The (ROWS, DIMS) table of unit vectors, from all texts."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, words = np.ascontiguousarray(index_vectors().T), Lexicon()
        total = np.zeros((ROWS, DIMS + 1), np.int64)     # the last place counts
        part = TaskContext.get().partitionId()
        for b in batches:
            for _, starts, numbers in _slices(b.column(0).cast(pa.binary()).to_pylist(), words):
                both = words.rows(numbers)
                around = _contexts(index, *both, starts)
                for at in both:
                    rows, sums = _grouped(at, around)
                    total[rows, :DIMS] += sums.T
                    total[:, DIMS] += np.bincount(at, minlength=ROWS)
        wide = np.abs(total).max() >= 2 ** 31
        for block in range(0, ROWS, BLOCK):
            own = total[block:block + BLOCK]
            if own.any():
                blob = b"8" + own.tobytes() if wide else b"4" + own.astype(np.int32).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                     "blob": pa.array([blob], pa.binary())})

    def read(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.int64 if blob[:1] == b"8" else np.int32, offset=1).astype(np.int64)

    sums = add_blobs(docs.select(F.col(f"`{text}`").cast("string").alias("text"))
                     .mapInArrow(learn, "part int, block int, blob binary"),
                     lambda a, b: b"8" + (read(a) + read(b)).tobytes())
    total = np.zeros((ROWS, DIMS + 1))
    for r in sums.collect():                      # ROWS / BLOCK rows
        total[r.block:r.block + BLOCK] = read(r.blob).reshape(-1, DIMS + 1)
    n = total[:, DIMS:]
    mean = total[:, :DIMS].sum(axis=0) / max(1.0, n.sum())
    v = total[:, :DIMS] - n * mean
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0).astype(np.float32)


class Pool:
    """Pooled vectors of texts by the word-vector table."""

    def __init__(self, vectors: np.ndarray):
        self.first = np.ascontiguousarray(vectors.T)          # (DIMS, ROWS): a text's places lie together
        self.second = self.first * self.first
        self.words = Lexicon()

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        """One row for each text."""
        n = np.zeros((len(texts), 1))
        sums = np.zeros((3, len(texts), DIMS))
        for docs, starts, numbers in _slices(texts, self.words):
            core, shape = self.words.rows(numbers)
            for k, (table, rows) in enumerate(((self.first, core), (self.first, shape), (self.second, core))):
                # a long text is several segments of a slice or of slices
                np.add.at(sums[k], docs, np.add.reduceat(table.take(rows, axis=1), starts, axis=1).T)
            np.add.at(n[:, 0], docs, np.diff([*starts, len(numbers)]))
        mean, forms, squares = sums / np.maximum(n, 1.0)
        spread = np.sqrt(np.maximum(squares - mean * mean, 0.0))
        return np.hstack([mean, forms, spread, np.log1p(n)]).astype(np.float32)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str
            ) -> tuple[DataFrame, dict[int, int]]:
    """(id, y, text): at most ``PER_LABEL`` labelled documents of each label, and
    how many documents each label has."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(
        F.col(key).alias("id")).agg(F.min(label).cast("int").alias("y"))
    here = docs.select(F.col(f"`{key}`").alias("id")).where("id is not null").distinct()
    known = materialize(spark, known.join(here, "id", "left_semi"), "known")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in sorted(sizes):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_LABEL)
        picked = own if picked is None else picked.unionAll(own)
    if picked is None:
        picked = known.limit(0)
    rows = docs.select(F.col(f"`{key}`").alias("id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # at most 2 * PER_LABEL ids; one row of an id leaves a task
    rows = rows.join(F.broadcast(picked), "id").groupBy("id", "y").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return materialize(spark, rows.select("id", "y", F.col("least.text").alias("text")), "labelled"), sizes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _log_loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * (np.logaddexp(0, z) - y * z)).sum() / w.sum())


@dataclass
class Network:
    """Pooled vector -> calibrated probability of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    first: np.ndarray     # (inputs + 1, HIDDEN)
    second: np.ndarray    # (HIDDEN + 1,)
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.shift) / self.scale) @ self.first[:-1] + self.first[-1])
        return h @ self.second[:-1] + self.second[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, apart: np.ndarray, seed: int = 5) -> Network:
    """Adam on the weighted log loss of rows not ``apart``; those pick the round
    and the temperature."""
    rng = np.random.default_rng(seed)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - shift) / scale, np.ones((len(x), 1), x.dtype)])
    fit, own = np.flatnonzero(~apart), np.flatnonzero(apart)
    first = rng.standard_normal((z.shape[1], HIDDEN)) / np.sqrt(z.shape[1])
    params = [first, np.zeros(HIDDEN + 1)]
    params[1][:-1] = rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)
    share = np.average(y[fit], weights=w[fit])
    params[1][-1] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    moved = [[np.zeros_like(p) for p in params] for _ in range(2)]
    best, least, step = [p.copy() for p in params], np.inf, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(fit)
        for s in range(0, len(order), 512):
            rows = order[s:s + 512]
            h = np.tanh(z[rows] @ params[0])
            out = h @ params[1][:-1] + params[1][-1]
            gap = w[rows] * (_sigmoid(out) - y[rows]) / w[rows].sum()
            back = np.outer(gap, params[1][:-1]) * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * params[0],
                     np.concatenate([h.T @ gap + DECAY * params[1][:-1], [gap.sum()]])]
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS)
            for p, g, a, b in zip(params, grads, *moved):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        loss = _log_loss(np.tanh(z[own] @ params[0]) @ params[1][:-1] + params[1][-1], y[own], w[own])
        if loss < least:
            best, least = [p.copy() for p in params], loss
        elif epoch > 40 and loss > 1.5 * least:
            break
    net = Network(shift, scale, best[0], best[1], 1.0)
    raw = net.logit(x[own])
    grid = np.exp(np.linspace(np.log(0.2), np.log(20.0), 200))
    net.temperature = float(min(grid, key=lambda t: _log_loss(raw / t, y[own], w[own])))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    constant: float       # the score where there is no network

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """All documents with their score as a further column."""
        known = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network, self.constant))

        @F.arrow_udf("double")
        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vectors, network, constant = known.value
            pool = Pool(vectors)
            for b in batches:
                if network is None:
                    yield pa.array(np.full(len(b), constant))
                else:
                    yield pa.array(network.probability(
                        pool(b.cast(pa.binary()).to_pylist())).astype(np.float64))

        return docs.withColumn(out, scores(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """Word vectors of all ``docs`` and the network fitted to ``labels``."""
    sample, sizes = _sample(docs, labels, key, text, label)
    vectors = word_vectors(docs, text)
    if len(sizes) < 2:
        return Model(vectors, None, float(next(iter(sizes), 0.5)))
    known = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(known.value)
        for b in batches:
            if b.num_rows:
                x = pool(b.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {"order": b.column("hash"), "y": b.column("y"),
                     "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = (sample.select(F.xxhash64("id", F.lit(1)).alias("hash"), "y", "text")
            .mapInArrow(pooled, "order bigint, y int, x binary").collect())   # at most 2 * PER_LABEL
    rows.sort(key=lambda r: (r.order, r.x))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    y = np.array([r.y for r in rows], np.float64)
    drawn = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    w = np.array([sizes[int(v)] / drawn[int(v)] for v in y])
    apart = np.array([r.order % 5 == 0 for r in rows])
    if apart.all() or len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.arange(len(y)) % 5 == 0        # a very small sample
        if len(set(y[~apart])) < 2 or not apart.any():
            return Model(vectors, None, float(np.average(y, weights=w)))
    return Model(vectors, train(x, y, w, apart), float(np.average(y, weights=w)))
