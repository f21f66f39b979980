"""The corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and gives the columns of
documents, but for the last, whose rows are tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm import bpe, langid, mixing, near_dup, queries, suffix_dedup
from lumiframe.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; null, empty and letterless texts go."""
    dictionaries = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, dictionaries).where("not rejected")
    return out.select(*docs.columns)


#: Near duplicates share this percentage of their five-word shingles, or more.
NEAR_PERCENT = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id. Of rows with equal doc_id (or none) and equal text one stays."""
    key = lambda c: F.xxhash64(F.col(c).cast("long"))
    found = near_dup.kept_texts(docs, percent=NEAR_PERCENT).select(key("doc_id").alias("n_key"), F.col("text_id").alias("n_text")).distinct()
    told = docs.select(key("doc_id").alias("n_key"), near_dup.text_id().alias("n_text"), F.struct("*").alias("n_row"))
    return told.join(found, ["n_key", "n_text"]).dropDuplicates(["n_key", "n_text"]).select("n_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings; a character that loses a byte goes whole, and n_chars is counted anew."""
    out = suffix_dedup.remove_repeats(docs, whole_characters=True)
    changed = F.size("removed") > 0
    text = F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text"))
    size = F.when(changed, F.length(F.col("kept").cast("string"))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    rows = bpe.encode(docs.select("doc_id", "source", "text"), queries.tokenizer())
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing", mix_sources), ("BPE", tokens)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
