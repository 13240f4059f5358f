"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysift.llm import decontaminate as contamination
from quaysift.llm import exact_dedup, language_id, minhash_dedup, packing, token_counts
from quaysift.llm.shared import without, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by models fitted on the labelled documents that came in.

    Texts without a letter (null and empty ones too) are rejected, so they go. Rows are judged by their text alone: repeated rows
    share a fate, and ids may be null.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), model)
    return found.filter(~F.col("rejected")).select("doc_id.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of equal texts; null ids come last, and of rows that repeat id and text one stays."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"))  # fields that are null equal each other
    found = written(exact_dedup.exact_dedup(docs.select(key.alias("doc_id"), "text")).select("doc_id", "kept", "group_size"), "copies")
    left = without(docs.withColumn("_key", key), found.filter(~F.col("kept")).select(F.col("doc_id").alias("_key")), ["_key"])
    again = written(found.filter("kept AND group_size > 1").groupBy(F.col("doc_id").alias("_key")).count().filter("count > 1").select("_key"), "again")
    rows = without(left, again, ["_key"]).unionByName(left.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return rows.drop("_key")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by 80 % of five-word shingles.

    Null and empty texts, and rows of a null id, are linked with nothing and stay. Rows that repeat an id share a fate.
    """
    gone = minhash_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return without(docs, gone, ["doc_id"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in passages of the benchmark.

    Null and empty texts, and rows of a null id (which aren't searched), stay. Rows that repeat an id share a fate.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = contamination.decontaminate(docs, items).filter("contaminated").select("doc_id")
    return without(docs, gone, ["doc_id"])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand in training sequences of 512 to 4096 tokens.

    Rows are packed one by one, whatever their ids; null and empty texts have a row without a sequence.
    """
    return packing.pack(token_counts.token_counts(docs), length_col="n_tokens")


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Language models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
