"""Training-corpus pipeline: five operators of ``utxolens.llm`` in a row.

``STAGES`` are (name, function) with function(spark, docs, sf_dir); each works
on all that its predecessor kept and returns the columns of documents, but the
last, which returns token ids. In every stage a null text counts as empty (the
base rules reject it), texts are worked on whole whatever their length, repeated
rows are judged each (near-dedup keeps one of them, the smallest doc_id first),
an empty table stays empty, and further columns are handed on as they are,
whatever their names. ``run`` writes each stage to the shared folder
and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utxolens.llm import bpe, mixing, quality, secretscan, simhash
from utxolens.llm.common import materialize, table
from utxolens.session import ship_package

#: toxic tokens go down to a twentieth of what is expected now; others stay
TARGETS = {"toxic": 0.05}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    ship_package(spark)
    kept = quality.quality(docs, table(spark, sf_dir, "labels"), once=True)
    return kept.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secret values replaced; ``n_chars`` follows."""
    ship_package(spark)
    out = secretscan.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate, rounded half up, says."""
    ship_package(spark)
    return mixing.resample(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS,
                           half_up=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token ids."""
    ship_package(spark)
    ids = bpe.encode(docs, bpe.default_path())
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup),
          ("secret scans", secret_scan), ("mixing sources", mix_sources),
          ("BPE encoding", encode_tokens)]

#: fingerprints, classifier and tokenizer are beyond SQL; tests hold the stages
#: against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
