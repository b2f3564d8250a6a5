"""Operator 5, near-duplicate documents by bit-sliced SimHash comparison.

A text's fingerprint has a bit where more than half of its shingle hashes have
it.  Fingerprints within the radius link; groups are the connected components.

Equal fingerprints are one row from the start, so copies cost nothing.  The 64
bits are cut into five fields; a pair that differs in three bits agrees on two
whole fields at least, so each fingerprint goes into the ten buckets named by
two fields and no link is lost.  In a bucket the bits are stored as vertical
planes, one machine word for 64 members; XOR of planes feeds carry-save
counters that hold 64 distances each, and a block is given up once every
distance in it has passed the radius.  Buckets emit a spanning forest.

Null and empty texts have fingerprint zero and link like any other; texts of
fewer words than a shingle hash their whole word sequence.  Null ids are kept;
a group's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from messlab.llm.blocks import blocked, spanning, whole_runs
from messlab.llm.components import components
from messlab.llm.storage import free, stored

#: Members of a bucket that one block compares; members of a run that are compared by shifted planes.
BLOCK, SHORT = 2048, 32
SEED = 42
#: Hashes whose bits are counted at once.
HASHES = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # splits at 0x20 and 0x09 to 0x0D


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit fingerprint of one whole text."""
    return fingerprint_of(words_of(text), width)


def fingerprint_of(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts, ends = (ends - lengths)[:len(words) - width + 1].tolist(), (ends - 1)[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), HASHES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + HASHES], ends[k:k + HASHES])],
                          "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(starts)).tolist()))


def fingerprints(width: int):
    """A column function: text to its fingerprint as a signed long."""
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))
    return hashed.asNondeterministic()


def field_masks(radius: int) -> list[int]:
    """Masks of the buckets' bits: two whole fields of radius + 2."""
    fields = radius + 2
    cuts = [64 * k // fields for k in range(fields + 1)]
    field = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(field, 2)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of row b is bit b of value i."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(differing: Iterable[np.ndarray], radius: int) -> np.ndarray | None:
    """Words whose bits are 1 where at most ``radius`` of the planes have 1; None if there is no such bit."""
    counters: list[np.ndarray] = []
    over = None
    for k, carry in enumerate(differing):
        if over is None:
            counters = [np.zeros_like(carry) for _ in range(radius.bit_length())]
            over = np.zeros_like(carry)
        for c in counters:
            c ^= carry
            carry = carry & ~c  # the bit was 1 and is 0 now
        over |= carry
        if k % 8 == 7 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            return None
    more, equal = over, ~over
    for b in reversed(range(radius.bit_length())):
        if radius >> b & 1:
            equal = equal & counters[b]
        else:
            more = more | equal & counters[b]
            equal = equal & ~counters[b]
    return ~more


def set_bits(words: np.ndarray) -> np.ndarray:
    """Positions of the 1 bits in a row of words."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def shifted(row: np.ndarray, d: int) -> np.ndarray:
    """Words whose bit i is bit i + d of the row."""
    skip, bits = divmod(d, 64)
    row = np.append(row[skip:], np.zeros(skip + 1, row.dtype))
    return row[:-1] if not bits else row[:-1] >> np.uint64(bits) | row[1:] << np.uint64(64 - bits)


def short_links(values: np.ndarray, run: np.ndarray, longest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among members of the same run, for many short runs at once: each with the one d places on."""
    rows, left, right = planes(values), [], []
    for d in range(1, longest):
        words = within((row ^ shifted(row, d) for row in rows), radius)
        if words is not None:
            at = set_bits(words)
            at = at[at + d < len(values)]
            at = at[run[at] == run[at + d]]
            left.append(at)
            right.append(at + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def long_links(first: np.ndarray, second: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of values: 64 queries at a time against the planes of the second."""
    rows, left, right = planes(second), [], []
    width = rows.shape[1]
    for k in range(0, len(first), 64):
        queries = first[k:k + 64]
        ones = [np.where(queries >> np.uint64(b) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
                for b in range(64)]
        words = within((rows[b][None, :] ^ ones[b] for b in range(64)), radius)
        if words is not None:
            at = set_bits(np.ascontiguousarray(words).reshape(-1))
            q, s = np.divmod(at, 64 * width)
            left.append(q[s < len(second)] + k)
            right.append(s[s < len(second)])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def block_edges(radius: int):
    """For mapInArrow over blocked rows: edges of a spanning forest of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["bucket", "key", "block"]):
            values = table.column("print").to_numpy().view(np.uint64)
            side = table.column("side").to_numpy()
            sizes = np.diff(np.append(at[at < len(values)], len(values)))
            number = np.repeat(np.arange(len(sizes)), sizes)
            brief = np.repeat((sizes <= SHORT) & (side[np.cumsum(sizes) - sizes] == 0), sizes)
            places = np.flatnonzero(brief)
            i, j = short_links(values[places], number[places], min(SHORT, int(sizes.max(initial=0))), radius)
            found = [(places[i], places[j])]
            starts = np.cumsum(sizes) - sizes
            for s, n in zip(starts[~brief[starts]].tolist(), sizes[~brief[starts]].tolist()):
                own = np.arange(s, s + n)
                one, two = (own, own) if side[s] == 0 else (own[side[own] == 1], own[side[own] == 2])
                if len(one) and len(two):
                    i, j = long_links(values[one], values[two], radius)
                    found.append((one[i], two[j]))
            i, j = (np.concatenate(x) for x in zip(*found))
            label = spanning(len(values), i, j)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)),
                                              pa.array(values[label[linked]].view(np.int64))], ["a", "b"])
    return run


def fingerprint_groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(print, component) for the distinct longs in ``prints.print`` that link with another one."""
    rows = prints.select("print").distinct()
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col("print").bitwiseAND(signed(m)).alias("key"))
                               for k, m in enumerate(field_masks(radius))]))
    rows = rows.select("print", keys.alias("_key")).select("print", "_key.bucket", "_key.key")
    edges = blocked(rows, ["bucket", "key"], "print", BLOCK).mapInArrow(block_edges(radius), "a long, b long")
    return components(edges).withColumnRenamed("node", "print")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3,
                    radius: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = stored(docs.select(F.col(id).alias("id"), fingerprints(width)(F.col(text)).alias("print")), "fingerprints")
    groups = fingerprint_groups(prints, radius)
    least = prints.groupBy("print").agg(F.min("id").alias("least")).join(groups, "print", "left")
    # A fingerprint without links is its own group.
    group = F.struct(F.col("component").isNull(), F.coalesce("component", "print")).alias("group")
    member = least.select("print", "least", group)
    lowest = member.groupBy("group").agg(F.min("least").alias("component_id"))
    answer = member.join(lowest, "group").select("print", "component_id")
    return prints.join(answer, "print").select(F.col("id").alias(id), hexadecimal(F.col("print")).alias("fingerprint"),
                                               "component_id")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The documents, all columns, of which one of each group is left: the smallest id, then the smallest text.

    Of rows equal in both, one is left.
    """
    marked = docs.select(F.col(id).alias("i"), F.xxhash64(text).alias("t"), fingerprints(width)(F.col(text)).alias("print"))
    first = F.min(F.struct(F.col("i").isNull().alias("n"), "i", "t")).alias("first")
    prints = stored(marked.groupBy("print").agg(first), "fingerprints")
    groups = fingerprint_groups(prints.select("print"), radius)
    member = prints.join(groups, "print", "left").withColumn(
        "group", F.struct(F.col("component").isNull().alias("a"), F.coalesce("component", "print").alias("g")))
    return first_of_groups(docs, member, id, text)


def first_of_groups(docs: DataFrame, member: DataFrame, id: str, text: str) -> DataFrame:
    """The documents that come first in the groups of ``member(group, first)``, one of equal rows."""
    i, t = free(docs, "_i"), free(docs, "_t")
    chosen = member.groupBy("group").agg(F.min("first").alias("first")).select(
        F.col("first.i").alias(i), F.col("first.t").alias(t))
    kept = docs.join(chosen, F.col(id).eqNullSafe(F.col(i)) & F.xxhash64(text).eqNullSafe(F.col(t)), "left_semi")
    return kept.dropDuplicates([id, text])


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
