"""A training corpus from ``documents``: five stages, each one operator, each written and read by the next.

Stage 1 drops documents that fail the quality rules, stage 2 keeps the smallest
id of every group of near duplicates, stage 3 cuts repeated passages out of the
texts and drops documents of which nothing is left, stage 4 repeats documents
of domains that are short of their weight, stage 5 tokenises.  All stages but the
last return the columns of ``documents``.  Null texts fail stage 1.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from messlab.llm import bpe, mixing, quality, shingles, suffixes
from messlab.llm.storage import stored
from messlab.llm.workers import importable


#: Shares of clean, poor and toxic tokens; stage 1 has removed the poor ones, so none are asked for.
MIXTURE = (0.93, 0.0, 0.07)
#: Words of a shingle, and the similarity from which texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Differing bits up to which operator 5 links fingerprints.
RADIUS = 3
#: Words of the shortest passage that counts as repeated.
PASSAGE = 50


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that pass the base rules and the calibrated classifier."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, confirmed: one document of each group of near copies, five-word similarity 0.8 and more.

    SimHash links and, for copies further apart than its radius, MinHash keys name the candidates; an exact
    comparison decides.
    """
    importable(spark)
    return shingles.keep_first(docs, width=WIDTH, similarity=SIMILARITY, radius=RADIUS)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 over words: texts without passages of 50 words that also start elsewhere; n_chars follows."""
    importable(spark)
    left = suffixes.remove_passages(docs, words=PASSAGE)
    kept = left.where((F.col("text") != "") & F.col("text").isNotNull())
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as often as their rate says, every one at least once."""
    return mixing.resample(docs, _labels(spark, sf_dir), MIXTURE)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: number of tokens and digests of the ids and of the decoded text."""
    importable(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.digests(F.col("text"), ranks, public_tokenizers.PATTERN)
    return docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good), ("near_duplicates", single), ("repeats", unrepeated), ("mixing", weighted), ("bpe", tokenised)]

#: No stage can be put in SQL: fitted models, hashed shingles and a tokenizer take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
