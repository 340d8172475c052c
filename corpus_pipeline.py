"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents; n_chars follows a text that a stage changes. A null or empty text passes the
stages like any other. The last stage returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, lines, simhash, toxicity
from tidelog.llm.common import fresh, scratch, table
from tidelog.llm.queries import vocabulary

#: A document with this score or more is rejected.
TOXIC = 0.3


def _same(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with the columns of docs, n_chars counted anew."""
    return found.select(*[F.length(F.coalesce("text", F.lit(""))).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, unchanged."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (name,) = fresh(docs.columns, "_score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < TOXIC).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share, but for one document that keeps each."""
    return _same(lines.dedup_lines(docs), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, unchanged."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark items hold; those that are benchmark items for more than half go."""
    return _same(decontaminate.cut_leaks(docs, table(spark, sf_dir, "benchmark"), window=8, max_coverage=0.5), docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document the token ids, their number, and the hash of the text that they decode to."""
    path = vocabulary("byte_bpe_50k.json")
    return bpe.roundtrip_documents(docs, path).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: A trained classifier, fingerprint components and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
