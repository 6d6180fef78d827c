"""From raw documents to token ids: language ID, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result as
Parquet to the shared folder and reads it again, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm import bpe, decontaminate, langid, simhash, substring
from staffline.llm._spark import forget, stored, table
from staffline.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: no null, empty or letterless text. The prediction becomes lang."""
    found = langid.identify(docs, langid.fit(docs), pred_col="__pred", score_col="__score")
    return found.filter(F.col("__pred") != langid.UNKNOWN).withColumn("lang", F.col("__pred")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles."""
    return simhash.keep_one(docs, words=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that an earlier document has are cut; n_chars follows the text."""
    return _resized(substring.dedup(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that consist of them for the larger part go."""
    return _resized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return bpe.encode(docs, vocabulary_path())


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("language", language), ("near", near), ("passages", passages), ("benchmark", benchmark), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)  # the next stage's input has been written
        before = docs
    return docs
