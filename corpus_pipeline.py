"""A corpus pipeline out of the operators in kinloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last return the columns
of documents.  Stages give the same rows again: where rows are equal, which of them stays does not show.  Null and empty texts do not
pass the quality stage; every stage takes empty tables, repeated rows and further columns, which are kept whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, common, jaccard, mixing, quality, substring_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label classifier rejects."""
    scored = quality.quality_scores(docs, "doc_id", "text")
    keep = common.col(scored, scored.columns[-1])
    return scored.where(keep).select(*[common.col(docs, c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least id, of each group linked by similarity of their word shingles."""
    return jaccard.keep_one_per_class(docs, "doc_id", "text")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every run of 35 words or more that occurs again, from all its occurrences; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs, "text", window=35)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[common.col(docs, c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their target weights; a document comes once for each repetition."""
    return mixing.mix(docs, "doc_id", "text", "source", mixing.cyclic_weights(3), most_epochs=3.0)


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each document, their number and the text that they decode to."""
    return bpe.bpe_encode_decode(docs, "text", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup_stage),
    ("mix_sources", mix_sources),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: The classifier is trained, so SQL cannot give the rows; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents; each stage's rows are written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
