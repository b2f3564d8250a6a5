"""Operator 4, language identification by nearest centroid.

A text is a vector of hashed byte n-grams (one to three bytes of the lower-case
text, anything but letters read as one blank), weighted by log frequency and by
inverse document frequency over all learning documents, scaled to length 1.
Each language has several centroids, found by spherical k-means on a bounded
sample; the language of the centroid of highest cosine is predicted.  A text
whose cosine falls short of what the centroid's own members reach is rejected.

Null texts and texts without a letter get ``und`` and score 0; so does every
text if there is nothing to learn from.  Learning rows without a language teach
nothing.  Equal cosines go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from messlab.llm.linear import mix, pieces
from messlab.llm.toxicity import remainder

#: Dimensions; documents of a language that clustering sees at most; centroids of a language; languages at most.
BITS, SAMPLE, CENTROIDS, LANGUAGES = 12, 1500, 4, 1000
#: Share of a centroid's members that its limit of rejection leaves outside, and what the limit allows beyond.
OUTSIDE, SLACK = 0.005, 0.8
UNKNOWN = "und"
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint64)
HAS_LETTER = regex.compile(r"\p{L}")


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """(texts, dimensions) counts of hashed n-grams."""
    size = 1 << BITS
    out = np.zeros((len(texts), size), np.float32)
    for rows, parts in pieces(texts, lower=True):
        data = LETTERS[np.frombuffer(b" ".join(parts) + b"   ", np.uint8)]
        low, back = np.unique(rows, return_inverse=True)
        row = np.repeat(back, [len(p) + 1 for p in parts])
        two = data[:-1] << np.uint64(8) | data[1:]
        three = two[:-1] << np.uint64(8) | data[2:]
        n, total = len(row), np.zeros(len(low) * size, np.int64)
        # Runs of blanks say nothing.
        for grams, blank in ((data[:n], 0x20), (two[:n] | np.uint64(1 << 20), 0x102020),
                             (three[:n] | np.uint64(1 << 30), 0x40202020)):
            some = grams != blank
            place = (mix(grams) >> np.uint64(64 - BITS)).astype(np.int64) + row * size
            total += np.bincount(place[some], minlength=len(total))
        out[low] += total.reshape(len(low), size)
    return out


def unit_vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(gram_counts(texts)) * idf
    length = np.sqrt((weighted * weighted).sum(1, keepdims=True))
    return weighted / np.where(length > 0, length, 1)


def in_groups(texts: list, size: int = 256) -> Iterator[list]:
    for k in range(0, len(texts), size):
        yield texts[k:k + size]


def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: how many texts have each dimension; the row past the last counts the texts."""
    seen = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for texts in in_groups(batch.column("text").to_pylist()):
            seen[:-1] += (gram_counts(texts) > 0).sum(0)
            seen[-1] += len(texts)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])


def centroids(vectors: np.ndarray, count: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out members: (centroids, least cosine accepted)."""
    chosen = [vectors.mean(0)]
    for _ in range(min(count, len(vectors)) - 1):  # the member farthest from all chosen so far
        chosen.append(vectors[(vectors @ np.stack(chosen).T).max(1).argmin()])
    centre = np.stack(chosen)
    for _ in range(rounds):
        centre = centre / np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
        nearest = (vectors @ centre.T).argmax(1)
        centre = np.stack([vectors[nearest == k].mean(0) if (nearest == k).any() else centre[k]
                           for k in range(len(centre))])
    centre = centre / np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
    cosine = vectors @ centre.T
    nearest = cosine.argmax(1)
    limit = [SLACK * np.quantile(cosine[nearest == k, k], OUTSIDE) if (nearest == k).any() else 1.0
             for k in range(len(centre))]
    return centre, np.array(limit)


def train(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE, count: int = CENTROIDS) -> dict:
    """Languages, centroids, limits and weights learnt from documents that are not ``held_out`` (over column id)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(LANGUAGES + 1).toPandas()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    frequency = rows.select("text").mapInArrow(document_frequency, "at long, n long").groupBy("at").agg(
        F.sum("n").alias("n")).toPandas()
    seen = np.zeros((1 << BITS) + 1)
    seen[frequency["at"].to_numpy(int)] = frequency["n"]
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    if not len(sizes):
        return {"languages": [], "centres": np.zeros((0, 1 << BITS)), "limits": np.zeros(0), "idf": idf}

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "text"])
        found, limit = centroids(np.concatenate([unit_vectors(t, idf) for t in in_groups(group.text.tolist())]), count)
        return pd.DataFrame({"lang": group.lang.iloc[0], "limit": limit, "centre": list(found.astype(float))})

    # Bounded: at most LANGUAGES rows of sizes, about ``sample`` rows of each language.
    share = F.create_map(*[F.lit(x) for lang, n in zip(sizes.lang, sizes["rows"])
                           for x in (lang, int(min(1.0, sample / n) * (1 << 30)))])
    order = F.xxhash64(F.lit(31), "id", "text")
    chosen = rows.where(F.pmod(order, F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select(
        "lang", "text", order.alias("order")).distinct()
    found = chosen.groupBy("lang").applyInPandas(cluster, "lang string, limit double, centre array<double>").toPandas()
    found = found.sort_values("lang", kind="stable")
    return {"languages": found.lang.tolist(), "centres": np.stack(found.centre.to_numpy()).astype(np.float32),
            "limits": found.limit.to_numpy(), "idf": idf}


def predictor(model: dict):
    """A column function: text to (lang_pred, score, rejected)."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*model["languages"], UNKNOWN], object)
        for series in batches:
            best, score, rejected = [], [], []
            for texts in in_groups(series.tolist()):
                readable = np.array([t is not None and HAS_LETTER.search(t) is not None for t in texts])
                cosine = unit_vectors(texts, model["idf"]) @ model["centres"].T
                if not cosine.shape[1]:
                    readable[:] = False
                    cosine = np.zeros((len(texts), 1))
                at = cosine.argmax(1)
                own = np.clip(cosine[np.arange(len(texts)), at], 0, 1)
                best.append(names[np.where(readable, at, len(names) - 1)])
                score.append(np.where(readable, own, 0.0))
                limits = model["limits"][at] if len(model["limits"]) else own
                rejected.append(~readable | (own < limits))
            yield pd.DataFrame({"lang_pred": np.concatenate(best) if best else [],
                                "score": np.concatenate(score).astype(float) if score else [],
                                "rejected": np.concatenate(rejected) if rejected else []})
    return predict.asNondeterministic()


def languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected."""
    def held(column: str) -> Column:
        return F.coalesce(remainder(F.col(column), 4) == 2, F.lit(False))

    model = train(docs, held("id"), id, text, lang)
    return docs.select(F.col(id).alias(id), held(id).alias("held_out"),
                       predictor(model)(F.col(text)).alias("_found")).select(id, "held_out", "_found.*")
