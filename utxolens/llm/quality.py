"""Quality rules: plain document counts and a hashed n-gram likelihood ratio.

Two multinomials over ``buckets`` hashed unigrams and bigrams are counted in
one pass over all documents: one of the trusted target (documents whose ids
are given as trusted), one of the whole raw corpus. A document's verdict is
its log-likelihood ratio divided by its number of n-grams, held against a
fixed threshold; nothing is sampled, so equal texts get equal verdicts.

With ``once``, as the queries have it, all documents count but each text weighs
once in both multinomials, however many copies it has: the equal texts share a
weight of one (trusted if one of their rows is), and so do near copies. A copy
group would else shift the raw side alone and reject itself. Texts count as near
copies by their ``MARKS`` smallest hashes of ``RUN`` words in a row: the middle
one of the numbers of texts with each mark is the size of the group, so one
passage in common does not make texts near copies.

Only built-in Spark functions run here. Counting explodes the hashed n-grams
and sums them per bucket (map-side first, at most ``buckets`` rows per task);
scoring is a projection without a shuffle, against the model of ``buckets``
numbers, which is the only thing that passes the driver.

Edge cases: a null or blank text has no words, fails the base rules and has a
null ratio; without any trusted document both multinomials are flat on the
target side and the ratio is measured against the uniform one; repeated rows
are scored each; all columns but the named ones are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, spare, text_or_empty, words

BUCKETS = 10_000          # hashed n-gram classes of both multinomials
SMOOTHING = 1.0           # pseudo-count of each class
THRESHOLD = -0.1          # least log-likelihood ratio per n-gram of a kept document
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8                # words of a window that counts as repeated
RUN = 4                   # words of a run that near copies have in common
MARKS = 8                 # run hashes kept of a text

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def ngram_buckets(text: str, buckets: int = BUCKETS) -> Column:
    """Buckets of the lower-cased tokens (word or punctuation runs) and their
    bigrams, as an array with one entry per n-gram."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(_TOKEN), F.lit(0))

    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        one = F.transform(t, lambda a: F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"))
        two = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n),
                         lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
        return F.concat(one, two)

    return let(tokens, both)


def run_marks(text: str) -> Column:
    """The ``MARKS`` smallest hashes of the text's runs of ``RUN`` words."""
    def pairs(h: Column, step: int) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n),
                          lambda a, b: F.xxhash64(a, b))

    one = F.transform(words(text), lambda w: F.xxhash64(w))
    runs = let(one, lambda h: let(pairs(h, 1), lambda g: pairs(g, RUN // 2)))
    return F.slice(F.sort_array(F.array_distinct(runs)), 1, MARKS)


def text_weights(docs: DataFrame, keys: DataFrame, *, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(_hash, _weight, _target) of each distinct text: the weight of each of its
    rows, and whether a row of it is trusted. ``keys`` has the trusted ``_key``.

    Only hashes are moved; tables are written so that the rows of one id or one
    mark can be split in the joins."""
    spark = docs.sparkSession
    rows = materialize(spark, docs.select(
        F.col(key).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_hash"),
        run_marks(text).alias("_marks")), "text_hashes")
    texts = rows.join(keys, F.col("_id") == F.col("_key"), "left").groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_target").alias("_target"))
    marked = materialize(spark, rows.select("_hash", F.explode("_marks").alias("_mark")).distinct(),
                         "text_marks")
    shared = materialize(spark, marked.groupBy("_mark").agg(F.count(F.lit(1)).alias("_texts"))
                         .where("_texts > 1").withColumnRenamed("_mark", "_other"),
                         "shared_marks").hint("shuffle_hash")
    near = (marked.join(shared, F.col("_mark") == F.col("_other"), "left").groupBy("_hash")
            .agg(F.sort_array(F.collect_list(F.coalesce("_texts", F.lit(1)))).alias("n"))
            .select(F.col("_hash").alias("_same"),
                    F.get("n", F.floor(F.size("n") / 2).cast("int")).alias("_group")))
    return materialize(spark, texts.join(near, F.col("_hash") == F.col("_same"), "left").select(
        "_hash", (1.0 / (F.col("_rows") * F.coalesce("_group", F.lit(1)))).alias("_weight"),
        "_target"), "text_weights")


def fit_ratio(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text",
              buckets: int = BUCKETS, smoothing: float = SMOOTHING, once: bool = False) -> list[float]:
    """``buckets`` log ratios of target to raw class probabilities.

    ``trusted`` has the keys of the target documents. All documents count:
    the raw side is every document, the target side every trusted one; with
    ``once`` the copies of a text, near ones too, weigh as one document."""
    # written, so that many rows with one (or no) id can be split in the join
    keys = materialize(docs.sparkSession, trusted.select(F.col(key).alias("_key"))
                       .where("_key is not null").distinct(), "trusted").withColumn(
        "_target", F.lit(1)).hint("shuffle_hash")
    if once:
        weights = text_weights(docs, keys, key=key, text=text).withColumnRenamed(
            "_hash", "_same").hint("shuffle_hash")
        rows = (docs.select(F.xxhash64(text_or_empty(text)).alias("_hash"), F.col(text).alias("_text"))
                .join(weights, F.col("_hash") == F.col("_same"), "left"))
    else:
        rows = (docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
                .join(keys, F.col("_id") == F.col("_key"), "left").withColumn("_weight", F.lit(1.0)))
    feats = rows.select("_target", "_weight", F.explode(ngram_buckets("_text", buckets)).alias("bucket"))
    counts = feats.groupBy("bucket").agg(
        F.sum("_weight").alias("raw"),
        F.sum(F.when(F.col("_target") == 1, F.col("_weight")).otherwise(0.0)).alias("target")).collect()
    raw, target = [smoothing] * buckets, [smoothing] * buckets
    for r in counts:                                   # at most ``buckets`` rows
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    lr, lt = math.log(sum(raw)), math.log(sum(target))
    return [(math.log(t) - lt) - (math.log(r) - lr) for t, r in zip(target, raw)]


def with_ratio(docs: DataFrame, model: list[float], *, text: str = "text",
               out: str = "llr") -> DataFrame:
    """Adds the length-normalised log-likelihood ratio of each document."""
    weights = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    score = let(ngram_buckets(text, len(model)), lambda f: F.when(
        F.size(f) > 0,
        F.aggregate(f, F.lit(0.0), lambda s, b: s + F.get(weights, b)) / F.size(f)))
    return docs.withColumn(out, score)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in
    the array ``w`` (windows are compared by a 64-bit hash)."""
    n = F.size(w) - (window - 1)

    def covered(s: Column) -> Column:                  # s: sorted (hash, place)
        twice = F.filter(s, lambda x, i: F.coalesce(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]),
            (x["h"] == F.get(s, i - 1)["h"]), (x["h"] == F.get(s, i + 1)["h"]), F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(
                F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    def from_hashes(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
                covered))

    def hashes(hw: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(
            *[F.get(hw, i + j) for j in range(window)]))

    return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: let(hashes(hw), from_hashes)))


def with_rules(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds the plain counts (``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``) and ``base_failed``."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = spare(docs, "_words")
    counted = docs.withColumn(own, words(text)).select(
        *[F.col(c) for c in docs.columns],
        F.size(own).cast("bigint").alias("n_words"),
        F.length(F.array_join(own, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .alias("n_dup_lines"),
        repeated_words(F.col(own)).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def trusted_keys(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic by every label row they have."""
    return (labels.groupBy("doc_id")
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .where("q = 1 and t = 0").select("doc_id"))


def quality(docs: DataFrame, labels: DataFrame, *, text: str = "text",
            threshold: float = THRESHOLD, buckets: int = BUCKETS, once: bool = False) -> DataFrame:
    """Documents with their counts, ``llr`` and the verdict ``kept``; ``once``
    as in ``fit_ratio``."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "llr", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c in own])
    model = fit_ratio(docs, trusted_keys(labels), text=text, buckets=buckets, once=once)
    return with_ratio(with_rules(docs, text=text), model, text=text).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
