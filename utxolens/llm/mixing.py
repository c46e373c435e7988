"""Mixing documents to domain targets with soft memberships.

A classifier fitted on a bounded sample of labelled documents gives every
document posteriors p over domains. With n tokens, a document drawn at rate w
adds ``w * n * p`` expected tokens to the domains. Rates are fitted to target
totals T by projected gradient least squares: with ``r`` the gap of the totals,
``w <- max(0, w - p . G^-1 r)``, G being the sum of ``n p p'``; this is the
gradient in the metric in which its step is one, so rates depend on membership
and not on length, and clipping at zero is the projection.

A step needs all gaps so far and the document's own row only. So an iteration
is one pass over the narrow posterior table that replays the gaps and returns
one number per domain; no rates are stored or shuffled between iterations.

A rate is made copies by its whole part, and one more where a hash of the
document's id and text in [0, 1) is below the rest: the expected copies are the
rate, so what is made meets the targets too, up to the spread of the draws.
Rows equal in id and text would draw alike; they are spread over [0, 1) by their
places in the written table of posteriors (``mix``), so batches play no part, or
by their places in a batch (``resample``, which moves no text).

Edge cases: null or blank texts have no tokens and the class shares as
posteriors; labels of missing documents, null labels and null ids are left out;
repeated rows each have their rate; without labels there is one domain,
``all``; an empty table stays empty; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import materialize, small_batches, spare, text_or_empty

PER_DOMAIN = 1_500        # most labelled documents of a domain the classifier is fitted on
MAX_DOMAINS = 32
FEATURES = 500            # most tokens the classifier looks at
GAP = 0.02                # least difference of a domain to the rest in the share with a token
SURE = 4.0                # that difference in standard errors, at least
ROUNDS = 600              # rounds of the classifier's fit
STEPS = 60                # most gradient steps
CLOSE = 1e-6              # gap, as a share of the target, at which the steps end

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def sample(docs: DataFrame, domains: DataFrame, key: str, text: str
           ) -> tuple[DataFrame, dict[str, int]]:
    """Labelled documents (domain, text), at most ``PER_DOMAIN`` of each: those
    with the smallest hash of their id, so the same at every run. Of several rows
    of an id the text with the smallest hash is taken. Also how many ids of the
    documents are labelled with each domain; labels of other ids are left out."""
    spark = docs.sparkSession
    known = domains.where(f"`{key}` is not null and domain is not null").groupBy(key).agg(
        F.min("domain").alias("domain"))
    here = docs.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    known = materialize(spark, known.join(here, F.col(key) == F.col("_key"), "left_semi"), "known")
    sizes = {r.domain: r["count"] for r in
             known.groupBy("domain").count().limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    picked = None
    for name in sorted(sizes):
        own = known.where(F.col("domain") == name).orderBy(F.xxhash64(key), key).limit(PER_DOMAIN)
        picked = own if picked is None else picked.union(own)
    if picked is None:
        return spark.createDataFrame([], "domain string, text string"), sizes
    ids = picked.select(F.col(key).alias("_key"), "domain")
    # at most MAX_DOMAINS * PER_DOMAIN ids, and as many rows: one of an id leaves a task
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("text")).join(
        F.broadcast(ids), "_key")
    return materialize(spark, rows.groupBy("_key", "domain").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
        .select("domain", F.col("least.text").alias("text")), "labelled"), sizes


def fit(labelled: DataFrame, known: Mapping[str, int]) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Domain names, the tokens looked at, and weights (tokens + 1, domains) of
    a multinomial logistic regression over which tokens a document has. The
    sample is even over domains; ``known``, the labelled documents of each,
    gives back their shares."""
    def seen(batches: Iterator) -> Iterator:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("domain"), pa.array([sorted(set(tokens(t))) for t in
                                               b.column("text").to_pylist()], pa.list_(pa.string()))],
                names=["domain", "tokens"])

    sets = materialize(labelled.sparkSession,
                       labelled.mapInArrow(seen, "domain string, tokens array<string>"), "token_sets")
    sizes = {r.domain: r["count"] for r in sets.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return names or ["all"], {}, np.zeros((1, max(1, len(names))))
    # each domain's share of documents with a token against that of the rest,
    # in standard errors, so that a small domain does not hide the others
    total, every = sum(sizes.values()), F.count(F.lit(1))
    spread = sets.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(
        every.alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}")
                            for i, d in enumerate(names)])
    pool = F.greatest(F.col("n") / total * (1 - F.col("n") / total), F.lit(1e-6))
    gaps = [F.abs(F.col(f"n{i}") / sizes[d] - (F.col("n") - F.col(f"n{i}")) / (total - sizes[d]))
            for i, d in enumerate(names)]
    sure = [F.when(g >= GAP, g / F.sqrt(pool * (1 / sizes[d] + 1 / (total - sizes[d])))).otherwise(0.0)
            for g, d in zip(gaps, names)]
    spread = spread.withColumn("sure", F.greatest(*sure))
    vocabulary = [r.token for r in spread.where(F.col("sure") >= SURE)
                  .orderBy(F.desc("sure"), "token").limit(FEATURES).collect()]
    place = {t: i for i, t in enumerate(vocabulary)}
    marks = F.array(*[F.lit(t) for t in vocabulary]) if vocabulary else F.array().cast("array<string>")
    rows = sets.select("domain", F.array_sort(F.array_intersect("tokens", marks)).alias("has")).collect()
    rows.sort(key=lambda r: (r.domain, r.has))
    x = np.zeros((len(rows), len(place) + 1), np.float32)
    x[:, -1] = 1
    y = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[t] for t in r.has]] = 1
        y[i, names.index(r.domain)] = 1
    w = np.zeros((x.shape[1], len(names)), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):                     # Adam with a falling step
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        grad = x.T @ (z - y) / len(y) + 1e-5 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w = w - 0.1 * (1 - t / ROUNDS) * (first / (1 - 0.9 ** t)) / (
            np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    w[-1] += np.log([known[n] for n in names]) - np.log(y.sum(axis=0))
    return names, place, w


def _judge(texts: list[str], place: dict[str, int], w: np.ndarray, domains: int) -> np.ndarray:
    z = np.empty((len(texts), domains))
    for i, t in enumerate(texts):
        at = sorted(place[x] for x in set(tokens(t)) if x in place)
        z[i] = w[at].sum(axis=0) + w[-1]
    if not len(z):
        return z
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _mark(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), text_or_empty(text))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)          # the golden section of 2^64


def _turns(marks: np.ndarray) -> np.ndarray:
    """Number of each of a batch's rows among those with its mark, from 0."""
    at = np.argsort(marks, kind="stable")
    ordered = marks[at]
    starts = np.r_[True, ordered[1:] != ordered[:-1]] if len(at) else np.zeros(0, bool)
    place = np.arange(len(at))
    turn = np.empty(len(at), np.int64)
    turn[at] = place - np.maximum.accumulate(np.where(starts, place, 0))
    return turn


def _copies(rates: np.ndarray, marks: np.ndarray, turns: np.ndarray | None = None) -> np.ndarray:
    """Copies of rows: the rate's whole part, one more where the draw is below
    the rest. The draw is the mark as a number in [0, 1), moved on by the golden
    section as many times as the row's turn says (by default, its turn among
    the rows of a batch that have its mark)."""
    turns = _turns(marks) if turns is None else turns
    draw = ((marks.astype(np.int64).view(np.uint64) + turns.astype(np.int64).view(np.uint64) * _GOLDEN)
            >> np.uint64(11)) * 2.0 ** -53
    whole = np.floor(rates)
    return (whole + (draw < rates - whole)).astype(np.int32)


def posteriors(docs: DataFrame, model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, p, mark): word count and domain posteriors of each
    document, and the hash of its id and text."""
    names, place, w = model
    kind = dict(docs.dtypes)[key]

    def judge(batches: Iterator) -> Iterator:
        for b in batches:
            texts = b.column("text").to_pylist()
            n = np.array([len(t.split()) for t in texts], np.int64)
            z = _judge(texts, place, w, len(names))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n), pa.array(list(z), pa.list_(pa.float64())),
                 b.column("mark")], names=["key", "n_tokens", "p", "mark"])

    return (docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"),
                        _mark(key, text).alias("mark"))
            .mapInArrow(judge, f"key {kind}, n_tokens bigint, p array<double>, mark bigint")
            .withColumnRenamed("key", key))


def _arrays(b) -> tuple[np.ndarray, np.ndarray]:
    p = b.column("p")
    n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
    return n, p.flatten().to_numpy().reshape(len(n), -1)


def _replay(p: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Rates of documents after the steps ``turns`` (each G^-1 r)."""
    w = np.ones(len(p))
    for y in turns:
        w = np.maximum(0.0, w - p @ y)
    return w


def _totals(table: DataFrame, each, size: int) -> np.ndarray:
    """Sum over all documents of ``each(n, p)``, an array of ``size`` numbers."""
    def add(batches: Iterator) -> Iterator:
        total = np.zeros(size)
        for b in batches:
            total += each(*_arrays(b))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))],
                                         names=["x"])

    parts = table.select("n_tokens", "p").mapInArrow(add, "x array<double>")
    row = parts.agg(*[F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(size)]).first()
    return np.array([x or 0.0 for x in row])


def fit_rates(table: DataFrame, target: np.ndarray) -> np.ndarray:
    """Steps of the projected gradient, to be replayed by ``_replay``."""
    size = len(target)
    gram = _totals(table, lambda n, p: np.einsum("i,ij,ik->jk", n, p, p).ravel(), size * size)
    inverse = np.linalg.pinv(gram.reshape(size, size), rcond=1e-10)
    turns = np.zeros((0, size))
    for _ in range(STEPS):
        now = turns
        gap = _totals(table, lambda n, p: (_replay(p, now) * n) @ p, size) - target
        if np.abs(gap).max() <= CLOSE * max(1.0, target.max()):
            break
        turns = np.vstack([turns, inverse @ gap])
    return turns


def _fitted(docs: DataFrame, domains: DataFrame, target: Mapping[str, float], key: str, text: str):
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(*sample(docs, domains, key, text))
    table = materialize(spark, posteriors(docs, model, key=key, text=text).withColumn(
        "_row", F.monotonically_increasing_id()), "posteriors")
    present = _totals(table, lambda n, p: n @ p, len(model[0]))
    turns = fit_rates(table, present * np.array([target.get(x, 1.0) for x in model[0]]))
    return model[0], table, turns, model


def resample(docs: DataFrame, domains: DataFrame, target: Mapping[str, float], *,
             key: str = "doc_id", text: str = "text", half_up: bool = False) -> DataFrame:
    """The documents, each as often as its copies say. The model judges each row
    where it is, so texts are not moved. ``half_up`` rounds the rate half up: that
    misses targets, but repeats or drops no document whose rate is near one."""
    _, _, turns, model = _fitted(docs, domains, target, key, text)
    names, place, w = model

    @arrow_udf(T.IntegerType())
    def copies(texts: pa.Array, marks: pa.Array) -> pa.Array:
        p = _judge(texts.to_pylist(), place, w, len(names))
        rates = _replay(p, turns)
        return pa.array(np.floor(rates + 0.5).astype(np.int32) if half_up
                        else _copies(rates, marks.to_numpy(zero_copy_only=False)))

    n, one = spare(docs, "_copies"), spare(docs, "_copy")
    return (docs.withColumn(n, copies(text_or_empty(text), _mark(key, text))).where(F.col(n) > 0)
            .withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*docs.columns))


def mix(docs: DataFrame, domains: DataFrame, target: Mapping[str, float], *,
        key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, domain, posterior, rate, copies, p) of every document.

    ``target`` gives each domain's wanted total as a share of its expected
    tokens now (1 if not named). ``copies`` has the rate as its expectation."""
    names, table, turns, _ = _fitted(docs, domains, target, key, text)
    kind = dict(docs.dtypes)[key]

    def rate(batches: Iterator) -> Iterator:
        for b in batches:
            _, p = _arrays(b)
            w = _replay(p, turns)
            top = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("n_tokens"), pa.array([names[i] for i in top], pa.string()),
                 pa.array(p[np.arange(len(p)), top]), pa.array(w),
                 pa.array(_copies(w, b.column("mark").to_numpy(zero_copy_only=False),
                                  b.column("_turn").to_numpy(zero_copy_only=False))),
                 b.column("p")],
                names=["key", "n_tokens", "domain", "posterior", "rate", "copies", "p"])

    # rows equal in id and text have one mark: their place in the written table
    # tells them apart; written, so that a very common mark can be split in the join
    equal = materialize(docs.sparkSession, table.groupBy("mark").count().where("count > 1")
                        .select(F.col("mark").alias("_same")), "equal_rows")
    table = table.join(equal, F.col("mark") == F.col("_same"), "left").withColumn(
        "_turn", F.when(F.col("_same").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("_row"))).drop(
        "_same", "_row")
    return table.mapInArrow(rate, f"key {kind}, n_tokens bigint, domain string, posterior double, "
                                  "rate double, copies int, p array<double>"
                            ).withColumnRenamed("key", key)


def label_domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Domains of the labels table: ``toxic``, ``junk`` or ``clean``."""
    return labels.where("quality is not null and toxic is not null").select(
        key, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk")
        .otherwise("clean").alias("domain"))
