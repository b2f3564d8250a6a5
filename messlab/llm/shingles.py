"""Near copies by the similarity of their word shingles, confirmed exactly.

Two texts are near copies if the Jaccard similarity of their sets of shingles
(runs of ``width`` words, case aside) reaches the threshold; groups are the
connected components.

Candidates come from operator 5, SimHash (:mod:`messlab.llm.simhash`): texts
meet if their fingerprints, over shingles of the same width, link within the
radius.  A similarity of 0.8 is about ten bits, which a small radius seldom
finds, so MinHash adds candidates: a text has one key per band, and texts that
share a key meet.  At similarity 0.8 a pair shares none of the 24 keys with the
chance 7e-5.  Texts joined by links or shared keys, over any number of steps,
form a family, so a text is looked at in one place only.  The exact check
follows: families are compared, in blocks of bounded size of which every pair
meets; in a block an index from shingles to texts counts what one text shares
with all others, until no two texts are left that could still link and are not
in one group.

Texts of the same words are one row from the start.  Null and empty texts have
no shingles and are copies of each other; texts of fewer words than a shingle
have one, of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from messlab.llm.blocks import blocked, whole_runs
from messlab.llm.components import components
from messlab.llm.linear import mix
from messlab.llm.simhash import fingerprint_groups, fingerprint_of, first_of_groups, words_of
from messlab.llm.storage import free, stored

#: Keys of a text, and minima that a key is made of.
BANDS, ROWS = 24, 5
#: Members and shingles of one side of a block; shingles whose minima are taken at once.
BLOCK, HELD, HASHES = 2048, 1 << 20, 4096
SEED = 42
#: Odd factors, one per minimum: products modulo 2^64 order the shingles anew.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    found = np.full(count, width, np.uint64)
    for k in range(width):
        found = mix(found ^ hashes[k:k + count])
    return np.unique(found)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band; texts without shingles have none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(found), HASHES):
        least = np.minimum(least, (found[k:k + HASHES, None] * FACTORS).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ row)
    return key.view(np.int64)


def sketch_of(words: list[bytes], width: int) -> tuple[bytes, np.ndarray, int]:
    print_ = fingerprint_of(words, width)
    return (xxhash.xxh3_128_digest(b" ".join(words)), band_keys(shingles(words, width)),
            print_ - (1 << 64) if print_ >> 63 else print_)


def sketches(width: int):
    """A column function: text to (same, keys, print); ``same`` is a digest of its words."""
    @F.pandas_udf("same binary, keys array<long>, print long")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            # One text at a time: the words of a batch take many times its bytes.
            yield pd.DataFrame([sketch_of(words_of(t), width) for t in texts], columns=["same", "keys", "print"])
    return sketch.asNondeterministic()


def shingle_sets(width: int):
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(words_of(t), width).view(np.int64) for t in texts])
    return sets.asNondeterministic()


def similar(values: np.ndarray, ends: np.ndarray, similarity: float) -> np.ndarray:
    """For each of several sets, laid end to end, the smallest position it links with over any number of steps."""
    sizes = np.diff(ends, prepend=0)
    n = len(sizes)
    number = np.unique(values, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(number, kind="stable")
    holders, at = owner[order], np.append(0, np.cumsum(np.bincount(number)))
    label, open_ = np.arange(n), np.ones(n, bool)
    while True:
        # Pairs of one group, or of which one text has met all others, are settled.
        left = np.flatnonzero(open_)
        groups = np.bincount(label[left], minlength=n)
        other = left[label[left] != groups.argmax()]
        if not len(other):
            return label
        v = other[0]
        open_[v] = False
        mine = number[ends[v] - sizes[v]:ends[v]]
        shared = np.bincount(np.concatenate([holders[at[s]:at[s + 1]] for s in mine]), minlength=n)
        near = np.flatnonzero(shared / (sizes + sizes[v] - shared) >= similarity)
        joined = np.zeros(n, bool)
        joined[label[near]] = True
        label[joined[label]] = label[near].min()


def block_groups(similarity: float):
    """For mapInArrow over blocked rows: edges of a spanning forest of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["family", "block"]):
            member, sets = table.column("member").to_numpy(), table.column("shingles").combine_chunks()
            ends = np.append(at[at < len(member)], len(member))
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own, run_sets = member[s:e], sets.slice(s, e - s)
                label = similar(run_sets.flatten().to_numpy(), np.cumsum(run_sets.value_lengths().to_numpy()), similarity)
                linked = np.flatnonzero(label != np.arange(len(label)))
                one.append(own[linked])
                two.append(own[label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], ["a", "b"])
    return run


def families(members: DataFrame, radius: int) -> DataFrame:
    """(member, family) of ``members(member, keys, print)`` whose print links with another's, or that share a key."""
    # Texts without shingles are one member, similar to no other.
    printed = members.where(F.size("keys") > 0).select("member", "print")
    groups = fingerprint_groups(printed, radius)
    # A print without links is its own group.
    linked = printed.join(groups, "print", "left").select(
        "member", F.struct(F.col("component").isNull(), F.coalesce("component", "print")).alias("key"))
    edges = meeting(linked).unionAll(meeting(members.select("member", F.explode("keys").alias("key"))))
    return components(edges).select(F.col("node").alias("member"), F.col("component").alias("family"))


def meeting(keyed: DataFrame) -> DataFrame:
    """(a, b): the members of ``keyed(member, key)`` that share a key with another one, with the smallest of them."""
    least = keyed.groupBy("key").agg(F.min("member").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(least, "key").select(F.col("member").alias("a"), "b")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
               similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """The documents, all columns, of which one of each group is left: the smallest id, then the smallest text.

    Of rows equal in both, one is left.  ``radius`` is that of the fingerprints, by which candidates are found.
    """
    marked = docs.select(F.col(id).alias("i"), F.xxhash64(text).alias("t"), sketches(width)(F.col(text)).alias("s"))
    first = F.min(F.struct(F.col("i").isNull().alias("n"), "i", "t")).alias("first")
    members = stored(marked.select("i", "t", "s.*").groupBy("same").agg(first, F.first("keys").alias("keys"), F.first("print").alias("print"))
                     .withColumn("member", F.monotonically_increasing_id()), "members")
    related = families(members, radius).join(members.select("member", "first"), "member").select(
        "member", "family", F.col("first.i").alias("i"), F.col("first.t").alias("t"))
    texts = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).join(
        related, F.col("_id").eqNullSafe(F.col("i")) & F.col("_hash").eqNullSafe(F.col("t")))
    sets = stored(texts.select("family", "member", shingle_sets(width)(F.col("_text")).alias("shingles"))
                  .dropDuplicates(["member"]), "shingles")
    edges = blocked(sets, ["family"], "member", BLOCK, F.size("shingles") / HELD).mapInArrow(
        block_groups(similarity), "a long, b long")
    groups = components(edges).withColumnRenamed("node", "member")
    found = members.select("member", "first").join(groups, "member", "left").select(
        "first", F.coalesce("component", "member").alias("group"))
    return first_of_groups(docs, found, id, text)
