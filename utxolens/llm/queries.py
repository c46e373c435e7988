"""Registered queries of the training-data operators.

Each applies its operator, with production parameters, to a whole given table
and derives the contract's columns from the operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, licences, mixing, phrases, quality, secretscan, sharding, simhash, suffixes,
               tokenfile, whitening, wordvectors)
from .common import materialize, table, text_or_empty

SHARDS = 40
#: wanted totals of the mixing query, as shares of the expected tokens now
TARGETS = {"junk": 0.3, "toxic": 0.1}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                           once=True)
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept", "llr")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t = text_or_empty("text")
    rows = docs.select("doc_id", (F.octet_length(t) + 16).cast("bigint").alias("size"),
                       F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    weights = [1.0] * SHARDS
    grown = sharding.assign(sharding.assign(rows, "doc_id", weights), "doc_id", [*weights, 1.0],
                            "grown_shard")
    return sharding.with_slots(grown, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"),
                       mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "n_tokens", "domain", "posterior", "rate", "copies", "p")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path(), ["doc_id"]).select(
        "doc_id", "digest.*")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, rows = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    # written, so that the rows of a text with very many copies can be split in the join
    found = materialize(spark, cut.select(
        "tkey", "first", F.octet_length("kept").cast("bigint").alias("n_kept"),
        F.col("n_spans").alias("spans"), F.sha2("kept", 256).alias("sha")), "kept")
    suffixes.drop_tables(spark)
    is_first = F.col("key").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    covered = ~is_first & (F.col("n_bytes") >= suffixes.LENGTH)      # a later copy goes whole
    return rows.join(found, "tkey").select(
        F.col("key").alias("doc_id"), "n_bytes",
        F.when(covered, F.col("n_bytes")).otherwise(F.col("n_bytes") - F.col("n_kept"))
        .alias("n_removed"),
        F.when(covered, F.lit(1).cast("bigint")).otherwise(F.col("spans")).alias("n_spans"),
        F.when(covered, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha"))
        .alias("kept_sha256"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = tokenfile.write(table(spark, sf_dir, "documents"), tokenfile.default_path())
    return tokenfile.read_digests(index, folder)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "spans")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def many(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select("doc_id", many("assign").alias("n_assign"), many("access").alias("n_access"),
                        many("hex").alias("n_hex"),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")

    def held_out(key: str):
        return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))

    model = wordvectors.fit(docs, labels.where(~held_out("doc_id")))
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # from some millions of vectors on a deviation can pass 64 bits: then null there, whole beside it
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"),
                      "whitened", "explained", "identity_error",
                      F.col("deviation").alias("deviation_whole"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_sharding, op3_nearest, op4_mixing, op5_simhash, op6_bpe, op7_suffixes,
    op8_tokenfile, op9_secrets, op10_licences, op11_classifier,
    op12_phrases, op13_whitening, pipeline)}
