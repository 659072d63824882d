"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. Extra columns pass through; the stages' own rules for null, empty
and repeated rows are those of their operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontamination, jaccard, quality, recompression
from plumbline.llm.queries import bpe_digests, table
from plumbline.llm.text import written
from plumbline.session import ship_package


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexities exceed their language's thresholds."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates."""
    ship_package(spark)
    return jaccard.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that start earlier; texts without any stay as they are, a text that is nothing else goes."""
    ship_package(spark)
    found = recompression.remove_repeats(docs)
    cut = F.col("n_removed") > 0
    kept = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where(~cut | (F.col("n_removed") < F.col("n_words"))).withColumns(kept).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    ship_package(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text, with digests of the ids and of the text decoded from them."""
    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path))


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

# A trained model decides the first stage and a vocabulary the last: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
