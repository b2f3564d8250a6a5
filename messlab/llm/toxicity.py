"""Operator 3, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, pairs of neighbours and pairs with one word
between them, in lower case, each counted once.  Training sees a bounded sample
of labelled documents; per-coordinate rates and L1 leave a short list of
weights, which travels with the tasks (at most 2^bits of them).

Null and empty texts have no features and score the bias.  Rows without a label
teach nothing; without any label every text scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from messlab.llm.linear import Model, fit, labelled, sigmoid

GRAMS = ("word", "pair", "skip")
#: Labelled documents that training sees at most; weight of a toxic one, since they are the fewer.
SAMPLE, POSITIVE = 16_000, 3.0


def remainder(id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(id.cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", id: str = "doc_id",
          text: str = "text", sample: int = SAMPLE) -> Model:
    """The model learnt from labels whose id (column ``id``) is not ``held_out``."""
    return fit(labelled(docs, labels, F.col(label), ~held_out, id, text, sample), GRAMS, 2,
               positive=POSITIVE)[0]


def scorer(model: Model):
    """A column function: text to the probability of the label."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sigmoid(model.margins(texts.tolist())[:, 0]))
    return score.asNondeterministic()


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, F.coalesce(remainder(F.col("id"), 5) == 0, F.lit(False)), id=id, text=text)
    return docs.select(F.col(id).alias(id),
                       F.coalesce(remainder(F.col(id), 5) == 0, F.lit(False)).alias("held_out"),
                       scorer(model)(F.col(text)).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
