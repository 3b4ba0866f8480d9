"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, mixing, quality, secrets
from quarry.llm.common import ship, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor the likelihood ratio rejects.

    Null and empty texts have too few words and go; repeated rows stay or go together; null ids and labels take no part
    in fitting, and such rows are judged like any other.
    """
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the smallest id.

    Rows without words, null texts included, are no copies of each other under different ids; rows with a null id stay;
    rows of one id and text are left once, and the different texts of one id are judged apart.
    """
    ship(spark)
    return jaccard.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; nulls stay null, and repeated rows stay as many as they are."""
    ship(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate takes it.

    A document without words, null texts included, adds no size and is taken like any other of its source; a source
    without words gives nothing; a null source is a source; rows that are equal in id and text are taken equally often.
    """
    ship(spark)
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, for every row of the mix; a null text is empty."""
    ship(spark)
    return bpe.round_trip(docs, memo=40_000, slice_bytes=1 << 20)  # other stages' memory is still in use


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The likelihood ratio and byte-level BPE have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
