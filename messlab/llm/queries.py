"""The thirteen operators over their whole tables as queries, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from messlab.llm import (alignment, bpe, embeddings, language, mixing, preference, quality, regions, simhash, suffixes,
                         tokens, toxicity, whitening)
from messlab.llm.workers import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        importable(spark)
        return function(spark, sf)
    QUERIES[function.__name__] = run
    return run


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_preference(spark, sf):
    """Every conversation against the same one with another's answer: prompt and masked completions, turn by turn."""
    chosen, rejected = preference.answer_pairs(load(spark, sf, "conversations"))
    return preference.formatted(chosen, rejected).withColumnRenamed("pair", "conv_id")


ORACLES["op1_preference"] = """
WITH chosen AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
last AS (SELECT conv_id, max(turn) AS at FROM chosen WHERE role = 'assistant' GROUP BY conv_id),
said AS (SELECT c.conv_id, max(c.text) AS text FROM chosen c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.at
         WHERE c.role = 'assistant' GROUP BY c.conv_id),
rejected AS (
  SELECT c.* FROM chosen c LEFT JOIN last l ON c.conv_id = l.conv_id WHERE l.at IS NULL OR c.turn < l.at
  UNION ALL
  SELECT l.conv_id, l.at, 'assistant', s.text FROM last l JOIN said s ON xor(l.conv_id, 1) = s.conv_id),
message AS (
  SELECT conv_id, turn, role, text, bool_or(side = 1) AS a, bool_or(side = 2) AS b
  FROM (SELECT *, 1 AS side FROM chosen UNION ALL SELECT *, 2 AS side FROM rejected) GROUP BY ALL),
border AS (SELECT conv_id, min(turn) AS border FROM message WHERE a <> b GROUP BY conv_id),
placed AS (SELECT m.*, border FROM message m LEFT JOIN border d ON m.conv_id = d.conv_id),
parts AS (
  SELECT conv_id, 'prompt' AS part, turn, role, text FROM placed WHERE border IS NULL OR turn < border
  UNION ALL SELECT conv_id, 'chosen', turn, role, text FROM placed WHERE turn >= border AND a
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM placed WHERE turn >= border AND b)
SELECT conv_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS train_from,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 ELSE 0 END AS train_to
FROM parts
"""


@query
def op2_suffix_dedup(spark, sf):
    return suffixes.removal_digests(load(spark, sf, "documents"), words=50)


@query
def op3_toxicity(spark, sf):
    return toxicity.scores(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op4_language(spark, sf):
    return language.languages(load(spark, sf, "documents"))


@query
def op5_simhash(spark, sf):
    return simhash.near_duplicates(load(spark, sf, "documents"))


@query
def op6_token_counts(spark, sf):
    """Pieces of every text under the public 32k vocabulary, its scores taken as unigram scores."""
    count = tokens.token_counter(tokens.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return load(spark, sf, "documents").select("doc_id", count(F.col("text")).alias("n_tokens"))


@query
def op7_byte_bpe(spark, sf):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.digests(F.col("text"), ranks, public_tokenizers.PATTERN)
    return load(spark, sf, "documents").select("doc_id", found.alias("_found")).select("doc_id", "_found.*")


@query
def op8_mixing(spark, sf):
    """Rates that bring the domains of the labels table to their target weights."""
    return mixing.mixed(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op9_quality(spark, sf):
    return quality.judged(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op10_embeddings(spark, sf):
    return embeddings.near_duplicates(load(spark, sf, "embeddings"))


@query
def op11_html_text(spark, sf):
    return regions.main_texts(load(spark, sf, "pages"))


@query
def op12_whitening(spark, sf):
    return whitening.whitened(load(spark, sf, "embeddings"))


@query
def op13_alignment(spark, sf):
    return alignment.alignments(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))
