"""Operator 10, near-duplicate vectors by iterative quantisation.

Rotations learnt on a bounded sample turn the centred principal axes of unit
vectors into balanced bits.  Every vector is indexed in several tables, each
keyed by its label and some bits of its code; tables come as partitions of the
shuffled bits into disjoint substrings, and no bit is in two tables: where those
of a rotation are used up, the next rotation brings new ones.  The key grows with
the logarithm of the row count, so that buckets keep their size, up to half a
word.  There are as many tables as independent bits would ask for, and more
until made-up partners at the threshold, of the sample's vectors, meet with the
wanted recall; keys get shorter where too many tables would be needed.  Vectors that
meet are ranked by the original components in double precision; links below
the threshold do not exist, and a pair that meets in several tables counts in
the first only.

Equal vectors of a label are one row from the start and link with each other.
Vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing.  Vectors of different length do not
compare; each length has a rotation of its own.  Null ids are kept; a group's
id is its smallest id that is not null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from messlab.llm.blocks import blocked, spanning, whole_runs
from messlab.llm.components import components
from messlab.llm.storage import stored

#: Vectors the rotation is fitted on, rounds of the fit, members of a bucket in one block, pairs scored at once.
SAMPLE, ROUNDS, BLOCK = 4096, 30, 2048
RECALL = 0.995
#: Tables at most, beyond which keys get shorter; made-up partners of each kind that recall is measured on.
TABLES, PARTNERS = 64, 8192


class Rotation:
    """Centre and projection whose signs are the code."""

    def __init__(self, unit: np.ndarray, rounds: int = ROUNDS, seed: int = 7):
        self.centre = unit.mean(0)
        around = unit - self.centre
        bits = min(64, unit.shape[1])
        axes = np.linalg.svd(around.T @ around)[0][:, :bits]
        low = around @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            codes = np.where(low @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ low)
            turn = right.T @ left.T
        self.projection = axes @ turn
        self.bits = bits

    def codes(self, unit: np.ndarray) -> np.ndarray:
        positive = (unit - self.centre) @ self.projection >= 0
        return (positive.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / np.where(scale > 0, scale, 1)
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


class Codes:
    """Words of up to 64 bits, each from rotations of its own; words are learnt when they are asked for."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        axes = min(64, unit.shape[1])
        self.each = 64 // axes
        self.bits = self.each * axes
        self.words: list[list[Rotation]] = []

    def word(self, number: int) -> list[Rotation]:
        while len(self.words) <= number:
            first = 7 + self.each * len(self.words)
            self.words.append([Rotation(self.unit, seed=first + k) for k in range(self.each)])
        return self.words[number]


def word_code(word: list[Rotation], unit: np.ndarray) -> np.ndarray:
    out = np.zeros(len(unit), np.uint64)
    for k, rotation in enumerate(word):
        out |= rotation.codes(unit) << np.uint64(k * rotation.bits)
    return out


def partners(unit: np.ndarray, cosine: float, number: int = PARTNERS, seed: int = 13) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sets of pairs at the cosine: towards any direction, and towards other vectors of the sample."""
    draw = np.random.default_rng(seed)
    from_ = unit[np.arange(number) % len(unit)]
    found = []
    for aim in (draw.normal(size=from_.shape), unit[draw.integers(0, len(unit), number)]):
        aim = aim - (aim * from_).sum(1, keepdims=True) * from_
        length = np.sqrt((aim * aim).sum(1, keepdims=True))
        usable = length[:, 0] > 1e-6
        aim, start = aim[usable] / length[usable], from_[usable]
        found.append((start, cosine * start + math.sqrt(max(0.0, 1 - cosine * cosine)) * aim))
    return found


def tables(codes: Codes, rows: int, cosine: float, recall: float, seed: int = 11) -> list[tuple[int, int]]:
    """(word, bit mask) of each table.

    Independent hyperplanes part a pair at the threshold with the chance
    (angle / pi) per bit, which gives the least number of tables.
    """
    pairs = [(a, b) for a, b in partners(codes.unit, cosine) if len(a)]
    differing: list[list[np.ndarray]] = []
    found: list[tuple[int, int]] = []
    for width in range(min(max(1, codes.bits // 2), max(6, math.ceil(math.log2(max(rows, 2))))), 0, -1):
        agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** width
        least = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1
        generator, found, met = np.random.default_rng(seed), [], [np.zeros(len(a), bool) for a, _ in pairs]
        while len(found) < TABLES:
            word, part = divmod(len(found), codes.bits // width)
            if not part:
                order = generator.permutation(codes.bits)
                if word == len(differing):
                    differing.append([word_code(codes.word(word), a) ^ word_code(codes.word(word), b) for a, b in pairs])
            mask = sum(1 << int(b) for b in order[part * width:(part + 1) * width])
            found.append((word, mask))
            for known, bits in zip(met, differing[word]):
                known |= (bits & np.uint64(mask)) == 0
            if len(found) >= least and all(known.mean() >= recall for known in met):
                return found
    return found


def stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def block_links(masks: list[tuple[int, int]], dim: int, cosine: float):
    """For mapInArrow over blocked rows: (a, b, n): spanning edges with n = 0, and link counts of a with b = a."""
    words = 1 + max(word for word, _ in masks)

    def links(one, two, unit, code, met):
        found = []
        for k in range(0, len(one), 512):
            rows = one[k:k + 512]
            i, j = np.nonzero(unit[rows] @ unit[two].T >= cosine)
            i, j = rows[i], two[j]
            keep = i != j
            for word, mask in met:
                keep &= ((code[i, word] ^ code[j, word]) & np.uint64(mask)) != 0
            found.append((i[keep], j[keep]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["bucket", "label", "key", "block"]):
            member, copies, side, bucket = (table.column(c).to_numpy() for c in ("member", "copies", "side", "bucket"))
            code = stack(table.column("codes"), words).view(np.uint64)
            unit = unit_rows(stack(table.column("embedding"), dim))
            ends = np.append(at[at < len(member)], len(member))
            left, right, number = [np.zeros(0, int)], [np.zeros(0, int)], np.zeros(len(member), np.int64)
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = np.arange(s, e)
                one, two = (own, own) if side[s] == 0 else (own[side[own] == 1], own[side[own] == 2])
                if not len(one) or not len(two):
                    continue
                i, j = links(one, two, unit, code, masks[:bucket[s]])
                np.add.at(number, i, copies[j])
                if side[s]:
                    np.add.at(number, j, copies[i])
                left.append(i)
                right.append(j)
            label = spanning(len(member), np.concatenate(left), np.concatenate(right))
            tied, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([member[tied], member[some]])),
                 pa.array(np.concatenate([member[label[tied]], member[some]])),
                 pa.array(np.concatenate([np.zeros(len(tied), np.int64), number[some]]))], ["a", "b", "n"])
    return run


def distinct_vectors(rows: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """(member, label, embedding, copies, least) of the usable vectors, written out."""
    x = F.col("embedding")
    usable = rows.select(F.col(id).alias("id"), F.col(vector).alias("embedding"), F.col(label).alias("label")).where(
        F.col("label").isNotNull() & (F.size(x) > 0) & F.exists(x, lambda c: c != 0)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    same = usable.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    return stored(same.withColumn("member", F.monotonically_increasing_id()), "vectors")


def fit(vectors: DataFrame, dim: int, sample: int = SAMPLE) -> Codes:
    """The codes learnt on the ``sample`` vectors of lowest hash."""
    chosen = vectors.orderBy(F.xxhash64("embedding"), "member").limit(sample).select("embedding").toArrow()
    return Codes(unit_rows(stack(chosen.column(0), dim)))


def linked(vectors: DataFrame, dim: int, cosine: float, recall: float, sample: int) -> DataFrame:
    """(a, b, n) of all blocks for the distinct vectors of one length."""
    total = vectors.count()
    learnt = fit(vectors, dim, sample)
    masks = tables(learnt, total, cosine, recall)
    words = learnt.words[:1 + max(word for word, _ in masks)]  # without the sample

    @F.pandas_udf("array<long>")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            unit = unit_rows(np.stack(rows.to_numpy())) if len(rows) else np.zeros((0, dim))
            yield pd.Series(list(np.stack([word_code(w, unit) for w in words], 1).view(np.int64)))

    def low(word: int, mask: int):
        return F.col("codes")[word].bitwiseAND(mask - (1 << 64) if mask >> 63 else mask)

    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("bucket"), low(*m).alias("key")) for t, m in enumerate(masks)]))
    coded = vectors.withColumn("codes", code.asNondeterministic()(F.col("embedding")))
    rows = coded.withColumn("_key", keys).select("member", "label", "copies", "embedding", "codes", "_key.*")
    return blocked(rows, ["bucket", "label", "key"], "member", BLOCK).mapInArrow(
        block_links(masks, dim, cosine), "a long, b long, n long")


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = 0.98, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (whether it is the smallest of its component)."""
    vectors = distinct_vectors(rows, id, vector, label)
    lengths = [r[0] for r in vectors.select(F.size("embedding")).distinct().collect()]  # one per vector length
    found = vectors.select(F.col("member").alias("a"), F.col("member").alias("b"), F.lit(0).cast("long").alias("n"))
    for dim in lengths:
        found = found.unionAll(linked(vectors.where(F.size("embedding") == dim), dim, cosine, recall, sample))
    found = stored(found, "links")
    number = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "member")
    groups = components(found.select("a", "b")).withColumnRenamed("node", "member")
    member = vectors.join(number, "member").join(groups, "member")
    lowest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = member.join(lowest, "component").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id")
    given = rows.select(F.col(id).alias("_id"), F.col(vector).alias("_vector"), F.col(label).alias("_own"))
    joined = given.join(answer, (F.col("_own") == F.col("_label")) & (F.col("_vector") == F.col("_embedding")), "left")
    return joined.select(
        F.col("_id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_label").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
