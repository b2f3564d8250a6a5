"""Operator 2, removal of repeated strings by sharded suffix arrays, over bytes or over words.

A byte goes when it lies in a string of ``size`` bytes that also starts
anywhere else in the corpus; over words (:func:`remove_passages`), a word that lies in a run of so many words.  Equal whole texts are one text from the start.

*Sharding.*  The least hash of the 64-byte grams inside a window of ``size``
bytes depends on the window's content only, so equal windows share it.  Each
text is cut into stretches of windows with the same least hash; a stretch whose
hash no other stretch has holds no repeat and is dropped, and the others are
sent, with the bytes their windows cover, to the shard of their hash.  This
loses nothing and needs no comparison between shards of different hashes.  A
stretch can also repeat itself, if its hash occurs twice in it; it stays too.

*Per shard.*  Equal stretches repeat altogether and send one of them; a suffix array is refined
as by Larsson and Sadakane (ranks of tripled prefixes, finished groups left
alone), and Kasai's scan gives common prefixes with the preceding suffix, all
stretches side by side.  A common prefix of ``size`` marks both windows.

*Across shards.*  A hash with more different stretches than a shard takes is dealt over
several shards.  Each also passes on a sorted list of digests of its distinct
windows, cut by digest into as many lists as there are shards; lists of the same
cut are merged by binary search, and digests met twice are repeats.

Null and empty texts have no bytes.  Texts shorter than ``size`` stay whole.
Rows are told apart by content, so repeated rows count as copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from messlab.llm.blocks import whole_runs
from messlab.llm.storage import free, stored

#: Windows looked at in one go.
PIECE = 1 << 18
#: Bytes of short texts looked at side by side; their numbers fit a core's cache.
BUNCH = 1 << 16
#: Stretches of one hash in a shard, on average; symbols of a shard.
STRETCHES, SHARD = 2048, 325_000


@dataclass(frozen=True)
class Unit:
    """What texts consist of: the bytes of a symbol, and the symbols of the grams whose least hash names a window."""

    width: int
    gram: int

    def body(self, text: bytes) -> bytes:
        """A text's symbols, ``width`` bytes each."""
        return text if self.width == 1 else codes_of(text)

    def bodies(self, texts: list[bytes]) -> list[bytes]:
        """:meth:`body` of each text, in one go."""
        if self.width == 1:
            return texts
        joined = b" ".join(texts)
        lengths = np.array([len(t) + 1 for t in texts])
        edges = np.searchsorted(word_borders(np.frombuffer(joined, np.uint8))[0], np.cumsum(lengths)) * self.width
        codes, edges = codes_of(joined), [0, *edges.tolist()]
        return [codes[a:b] for a, b in zip(edges, edges[1:])]

    def symbols(self, body: bytes) -> np.ndarray:
        return np.frombuffer(body, np.uint8 if self.width == 1 else np.uint64)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """A number of 64 mixed bits for each symbol."""
        return BYTE_CODES[symbols] if self.width == 1 else _mix(symbols)


#: Bytes of a text, or words of it by their hashes of 8 bytes (:func:`codes_of`).
BYTES, WORDS = Unit(1, 64), Unit(8, 8)


# ------------------------------------------------------------------ stretches

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


BYTE_CODES = _mix(np.arange(1, 257, dtype=np.uint64))
BASE = 0x5851F42D4C957F2D


def gram_hashes(data: np.ndarray, unit: Unit = BYTES) -> np.ndarray:
    """A mixed polynomial hash of every gram."""
    h, span, base = unit.codes(data), 1, BASE
    while span < unit.gram:
        h = h[:-span] * np.uint64(base) + h[span:]
        span, base = 2 * span, base * base & 0xFFFFFFFFFFFFFFFF
    return _mix(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n, span = len(values) - width + 1, 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:width - span + n])


def stretches(text: bytes, size: int, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, whether several grams have the hash) of the stretches of one text."""
    width, data = size - unit.gram + 1, unit.symbols(text)
    hashes, firsts, lasts, agains = [], [], [], []
    for start in range(0, max(0, len(data) - size + 1), PIECE):
        stop = min(start + PIECE, len(data) - size + 1)
        grams = gram_hashes(data[start:stop + size - 1], unit)
        least = sliding_least(grams, width)
        cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
        runs = np.diff(cuts)
        if runs.max() > width:  # periodic text: one hash for very long
            pieces = -(-runs // width)
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cuts = np.append(np.repeat(cuts[:-1], pieces) + within * width, len(least))
        # A gram has the least hash of some window if the greatest least of its windows is its own hash.
        edge = np.zeros(width - 1, np.uint64)
        ruling = np.sort(grams[~sliding_least(~np.concatenate([edge, least, edge]), width) == grams])
        several = np.unique(ruling[1:][ruling[1:] == ruling[:-1]])
        hashes.append(least[cuts[:-1]])
        firsts.append(cuts[:-1] + start)
        lasts.append(cuts[1:] + start - 1)
        agains.append(np.isin(hashes[-1], several))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(map(np.concatenate, (hashes, firsts, lasts, agains)))


def stretches_of(bodies: list[bytes], size: int, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(text, hash, first window, last window, whether several grams have the hash) of the stretches of short texts, side by side."""
    width, lengths = size - unit.gram + 1, np.array([len(b) // unit.width for b in bodies])
    data, starts = unit.symbols(b"".join(bodies)), np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - size + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64, bool))
    grams = gram_hashes(data, unit)
    least = sliding_least(grams, width)
    text = np.repeat(np.arange(len(bodies)), windows)
    within = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[text] + within  # windows inside one text
    own = least[at]
    cuts = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (within[1:] == 0)) + 1, [len(own)]])
    runs = np.diff(cuts)
    if runs.max() > width:  # periodic text: one hash for very long
        pieces = -(-runs // width)
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = np.append(np.repeat(cuts[:-1], pieces) + inside * width, len(own))
    # A gram has the least hash of some window if the greatest least of its windows is its own hash.
    edge, inner = np.zeros(width - 1, np.uint64), np.zeros(len(least), np.uint64)
    inner[at] = own
    ruling = np.flatnonzero(~sliding_least(~np.concatenate([edge, inner, edge]), width) == grams)
    # Texts and hashes as one number; numbers that meet by chance only send a stretch that need not go.
    number = np.arange(1, len(bodies) + 1).astype(np.uint64) * np.uint64(BASE)
    several = np.sort(_mix(grams[ruling] + number[np.searchsorted(starts, ruling, "right") - 1]))
    several = np.unique(several[1:][several[1:] == several[:-1]])
    first, last = cuts[:-1], cuts[1:] - 1
    again = np.isin(_mix(own[first] + number[text[first]]), several)
    return text[first], own[first], within[first], within[last], again


def find_stretches(size: int, unit: Unit = BYTES):
    """For mapInArrow over (k1, k2, text): the stretches of each text, met copies left out."""
    def found_in(texts: list[bytes], rows: list[int]) -> tuple:
        bodies = unit.bodies(texts)
        if len(bodies) == 1:
            found = stretches(bodies[0], size, unit)
            found = np.zeros(len(found[0]), np.int64), *found
        else:
            found = stretches_of(bodies, size, unit)
        contents = [xxhash.xxh64_intdigest(bodies[t][a * unit.width:(b + size) * unit.width])
                    for t, a, b in zip(*(found[k].tolist() for k in (0, 2, 3)))]
        return np.array(rows)[found[0]], *found[1:], np.array(contents, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, texts = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("text")
            met: set[tuple[int, int]] = set()
            out, some, rows, held = [], [], [], 0
            for r, key in enumerate(zip(k1.tolist(), k2.tolist())):
                if key not in met:
                    met.add(key)
                    text = texts[r].as_py()
                    if some and held + len(text) > BUNCH:
                        out.append(found_in(some, rows))
                        some, rows, held = [], [], 0
                    some.append(text)
                    rows.append(r)
                    held += len(text)
            if some:
                out.append(found_in(some, rows))
                at, h, first, last, again, contents = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k1[at], k2[at], h.view(np.int64), first, last, again,
                                           contents.view(np.int64))],
                    ["k1", "k2", "h", "first", "last", "again", "content"])
    return run


def cut_bodies(size: int, unit: Unit = BYTES):
    """For mapInArrow over texts and the stretches they send: a row per stretch with the symbols its windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "part", "parts", "k1", "k2", "first", "body", "met"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for r in range(batch.num_rows):
                text, k1, k2 = (batch.column(c)[r].as_py() for c in ("text", "k1", "k2"))
                text = unit.body(text)
                for s in batch.column("sent")[r].as_py():
                    parts = -(-s["n"] // STRETCHES)
                    body = text[s["first"] * unit.width:(s["last"] + size) * unit.width]
                    for column, value in zip(out, (s["h"], s["content"] % parts, parts, k1, k2, s["first"], body,
                                                   s["met"])):
                        column.append(value)
                    held += len(body)
                if held > 8_000_000:
                    yield _bodies(out, names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield _bodies(out, names)
    return run


def _bodies(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


# ----------------------------------------------------------- one suffix array

def suffix_array(symbols: np.ndarray, bits_of: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the suffixes, rank of each position, sort key of each position).

    A symbol has ``bits_of`` bits; a sort key is as many symbols as 63 bits hold.
    """
    n, taken = len(symbols), 63 // bits_of
    one = np.zeros(n + taken, np.uint64)
    one[:n] = symbols
    key = one[:n].copy()
    for k in range(1, taken):
        key <<= np.uint64(bits_of)
        key |= one[k:k + n]

    order = np.argsort(key)
    values = key[order]
    head = np.ones(n, bool)
    head[1:] = values[1:] != values[:-1]
    slots, rank = np.arange(n), np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    depth, bits = taken, 21 if n < (1 << 21) - 1 else 32
    while True:
        alone = head & np.append(head[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order, rank, key
        at = order[slots]
        found = rank[at].astype(np.uint64)
        for step in (1, 2) if bits == 21 else (1,):
            after = at + step * depth
            following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(np.uint64)
            found = found << np.uint64(bits) | following
        new = np.argsort(found)
        at, found = at[new], found[new]
        order[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = found[1:] != found[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        depth *= 3 if bits == 21 else 2


def common_prefixes(order: np.ndarray, rank: np.ndarray, key: np.ndarray, starts: np.ndarray, windows: np.ndarray,
                    size: int, bits_of: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Kasai's scan, all stretches side by side: the windows whose common prefix with the preceding suffix is
    ``size``, and those suffixes' positions.

    In a stretch, a position's common prefix is at least the one before less 1.
    """
    before = np.full(len(order), -1)
    before[order[1:]] = order[:-1]
    by_length = np.argsort(-windows, kind="stable")
    starts, windows = starts[by_length], windows[by_length]
    taken = 63 // bits_of
    padded = np.append(key, np.zeros(size + 2 * taken, np.uint64))
    length, ours, theirs = np.zeros(len(starts), np.int64), [], []
    for offset in range(int(windows.max(initial=0))):
        lanes = int(np.searchsorted(-windows, -offset, side="left"))  # stretches with more windows than the offset
        i = starts[:lanes] + offset
        j = before[i]
        own = np.maximum(length[:lanes] - 1, 0)
        own[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (own < size))
        while len(going):
            differing = padded[i[going] + own[going]] ^ padded[j[going] + own[going]]
            same = differing == 0
            if not same.all():
                first, rest = np.zeros((~same).sum(), np.int64), differing[~same]
                for k in range(1, taken):  # leading symbols that agree
                    first += rest >> np.uint64(bits_of * k) == 0
                own[going[~same]] += first
            own[going[same]] += taken
            going = going[same & (own[going] < size)]
        np.minimum(own, size, out=own)
        length[:lanes] = own
        full = own == size
        ours.append(i[full])
        theirs.append(j[full])
    if not ours:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ours), np.concatenate(theirs)


def repeated_windows(bodies: list[bytes], size: int, unit: Unit = BYTES) -> list[np.ndarray]:
    """For distinct stretches: which of their windows occur at another place too."""
    lengths = np.array([len(b) // unit.width for b in bodies])
    # Every stretch ends with symbol 0.
    found = unit.symbols((bytes(unit.width).join(bodies) + bytes(unit.width)))
    if unit.width == 1:
        symbols, bits = found.astype(np.uint16) + np.uint16(1), 9
    else:  # words in the order of their hashes, numbered
        symbols = np.unique(found, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        bits = int(symbols.max()).bit_length()
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols[starts + lengths] = 0
    order, rank, key = suffix_array(symbols, bits)
    windows = np.maximum(lengths - size + 1, 0)
    ours, theirs = common_prefixes(order, rank, key, starts, windows, size, bits)
    marked = np.zeros(len(symbols), bool)
    marked[ours] = True
    marked[theirs] = True
    return [marked[s:s + w] for s, w in zip(starts.tolist(), windows.tolist())]


def joined_spans(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window starts as covered spans."""
    if not len(at):
        return at, at
    gap = np.flatnonzero(at[1:] > at[:-1] + size)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + size


# --------------------------------------------------------------------- shards

#: A distinct window of a split hash: 128 bits for its bytes and, if it awaits an answer, its place, else -1.
WINDOW = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("start", "<i8")])
SOLVED = ["k1", "k2", "start", "stop", "cut", "windows"]


def solve_shards(size: int, unit: Unit = BYTES):
    """For mapInArrow over stretches sorted by (h, part): spans, and for split hashes (k1 is the hash) lists of windows."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in SOLVED]

        def add(*values) -> None:
            for column, value in zip(out, values):
                column.append(value)

        lists: dict[tuple[int, int], list[np.ndarray]] = {}
        for (h, _, parts, k1, k2, first, body, met), marked in zip(rows, repeated_windows([x[6] for x in rows], size, unit)):
            if met:  # its spans are known
                marked = np.ones(len(marked), bool)
            else:
                for start, stop in zip(*(x.tolist() for x in joined_spans(np.flatnonzero(marked), size))):
                    add(k1, k2, first + start, first + stop, None, None)
            if parts > 1:
                own = np.zeros(len(marked), WINDOW)
                digests = b"".join(hashlib.blake2b(body[o * unit.width:(o + size) * unit.width], digest_size=16).digest()
                                   for o in range(len(marked)))
                own["d1"], own["d2"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
                own["k1"], own["k2"], own["start"] = k1, k2, np.where(marked, -1, first + np.arange(len(marked)))
                lists.setdefault((h, parts), []).append(own)
        for (h, parts), found in lists.items():
            own = np.concatenate(found)
            own = own[np.lexsort((own["d2"], own["d1"]))]
            new = np.ones(len(own), bool)  # marked windows repeat here; one of them is enough
            new[1:] = (own["d1"][1:] != own["d1"][:-1]) | (own["d2"][1:] != own["d2"][:-1])
            own = own[new]
            cut = own["d1"] % np.uint64(parts)
            for c in np.unique(cut).tolist():
                add(h, None, None, None, c, own[cut == c].tobytes())
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], SOLVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ["h", "part", "parts", "k1", "k2", "first", "body", "met"]
        held, group, begun = 0, None, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:2] != group:
                    if held > SHARD * unit.width:
                        # The last whole group may pass the mark; it goes with the next shard.
                        yield solve(rows[:begun] or rows)
                        rows = rows[begun:] if begun else []
                        held = sum(len(x[6]) + 1 for x in rows)
                    group, begun = row[:2], len(rows)
                rows.append(row)
                held += len(row[6]) + 1
        if rows:
            yield solve(rows)
    return run


def merge_shards(size: int):
    """For mapInArrow over lists of windows sorted by (hash, cut): spans of the windows that two lists have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches, ["k1", "cut"]):
            lists = table.column("windows").to_pylist()
            ends = [*(x for x in at.tolist() if x < len(lists)), len(lists)]
            for s, e in zip(ends, ends[1:]):
                own = np.frombuffer(b"".join(lists[s:e]), WINDOW)
                merged = np.sort(own["d1"])
                own = own[np.searchsorted(merged, own["d1"], "right") - np.searchsorted(merged, own["d1"], "left") > 1]
                own = own[np.lexsort((own["d2"], own["d1"]))]
                same = (own["d1"][1:] == own["d1"][:-1]) & (own["d2"][1:] == own["d2"][:-1])
                met = np.append(same, False) | np.insert(same, 0, False)
                own = own[met[:len(own)] & (own["start"] >= 0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (own["k1"].copy(), own["k2"].copy(), own["start"].copy(),
                                           own["start"] + size)], SOLVED[:4])
    return run


# ----------------------------------------------------------------- whole tables

def text_keys(text: Column) -> list[Column]:
    """A text's bytes and the 128 bits that stand for them."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(7), whole).alias("k2"), whole.cast("binary").alias("text")]


SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
PLACES = 1 << 16


def word_borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of the words of a text, runs of bytes but space and 0x09 to 0x0D."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]])))
    return edges[::2], edges[1::2]


def codes_of(text: bytes) -> bytes:
    """8 bytes for every word of a text: a mixed polynomial hash."""
    data = np.frombuffer(text, np.uint8)
    starts, stops = word_borders(data)
    if not len(starts):
        return b""
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.concatenate([[1], np.full(min(int(lengths.max()), PLACES) - 1, BASE)]).astype(np.uint64), dtype=np.uint64)
    values = BYTE_CODES[data[~SPACE[data]]] * powers[within % PLACES]
    return _mix(np.add.reduceat(values, first)).tobytes()


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remaining(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeats(rows: DataFrame, size: int = 400, unit: Unit = BYTES, sized: bool = False) -> DataFrame:
    """(k1, k2, whole, text, spans) of the texts with repeats, of rows (k1, k2, text) as :func:`text_keys` makes them.

    ``whole``: the text occurs in several rows and goes altogether, if it has ``size`` symbols; ``text`` and
    ``spans`` are null then.  Otherwise the covered spans, not yet joined.  If ``sized``, ``spans`` of a whole text
    is the one span of all its symbols, null if it has fewer than ``size``.
    """
    if size < 2 * unit.gram:
        raise ValueError(f"size must be {2 * unit.gram} or more")
    # Words have a byte each and one between them; texts of fewer words have no stretches.
    rows = rows.where(F.length("text") >= (size if unit == BYTES else 2 * size - 1))
    found = stored(rows.mapInArrow(find_stretches(size, unit), "k1 long, k2 long, h long, first long, last long, "
                                   "again boolean, content long"), "stretches")
    copies = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    place = F.xxhash64("k1", "k2", "first")
    shared = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("again").alias("again"))
    shared = shared.where("a <> b or again").select("h", F.col("again").alias("self"))
    stretch = stored(found.drop("again").join(shared, "h").distinct().withColumn("place", place), "shared")
    # One of equal stretches is sent to the shard, unless its hash has no other content and it cannot repeat itself.
    equal = stretch.groupBy("h", "content").agg(F.min("place").alias("sender"), F.max("place").alias("top"),
                                                F.max("self").alias("self"))
    number = equal.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.join(number, "h").select("h", "content", "sender", (F.col("sender") != F.col("top")).alias("met"),
                                           "n", (F.col("self") | (F.col("n") > 1)).alias("sent"))
    known = stretch.join(equal.where("met").select("h", "content"), ["h", "content"]).select(
        "k1", "k2", F.col("first").alias("start"), (F.col("last") + size).alias("stop"))
    sends = F.struct("h", "first", "last", "n", "content", "met")
    by_text = stretch.drop("self").join(equal, ["h", "content"]).groupBy("k1", "k2").agg(F.collect_list(
        F.when(F.col("sent") & (F.col("place") == F.col("sender")), sends)).alias("sent"))
    info = stored(copies.join(by_text, ["k1", "k2"], "left").where("copies > 1 or sent is not null"), "texts-info")
    # Of equal texts one is enough; the first of each task, then one for each key.
    wanted = info.where("sent is not null").select("k1", "k2", "copies", "sent")
    texts = stored(rows.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(
        F.first("text").alias("text")).join(wanted, ["k1", "k2"]), "texts")
    cut = cut_bodies(size) if unit == BYTES else cut_bodies(size, unit)
    bodies = texts.where(F.size("sent") > 0).select("k1", "k2", "text", "sent").mapInArrow(
        cut, "h long, part int, parts int, k1 long, k2 long, first long, body binary, met boolean")
    solved = stored(bodies.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(
        solve_shards(size, unit), "k1 long, k2 long, start long, stop long, cut long, windows binary"), "spans")
    lists = solved.where("windows is not null").select("k1", "cut", "windows")
    across = lists.repartition("k1", "cut").sortWithinPartitions("k1", "cut").mapInArrow(
        merge_shards(size), "k1 long, k2 long, start long, stop long")
    spans = solved.where("windows is null").select(*SOLVED[:4]).unionAll(across).unionAll(known)
    listed = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    partly = texts.where("copies = 1").select("k1", "k2", "text").join(listed, ["k1", "k2"])
    wholly = info.where("copies > 1").select("k1", "k2")
    if sized:  # the last window of a text ends with it
        span = F.struct(F.lit(0).cast("long").alias("start"), (F.max("last") + size).alias("stop"))
        wholly = wholly.join(found.groupBy("k1", "k2").agg(F.array(span).alias("spans")), ["k1", "k2"], "left")
    else:
        wholly = wholly.withColumn("spans", F.lit(None).cast(listed.schema["spans"].dataType))
    return wholly.select("k1", "k2", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("text"), "spans").unionAll(
        partly.select("k1", "k2", F.lit(False), "text", "spans"))


def cut_digest():
    """A column function: bytes and spans to (n_removed, n_spans, kept_sha256)."""
    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, found in zip(texts, spans):
                own = [] if text is None else merged(list(found))
                left = hashlib.sha256(b"" if text is None else remaining(text, own)).hexdigest()
                rows.append((sum(b - a for a, b in own), len(own), left))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])
    return digest.asNondeterministic()


def cut_text():
    """A column function: bytes and spans to the remaining text.

    A character of which a span takes some bytes goes too.
    """
    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([None if t is None else remaining(t, merged(list(s))).decode(errors="ignore")
                             for t, s in zip(texts, spans)], dtype=object)
    return cut.asNondeterministic()


def span_counts(spans: Column) -> Column:
    """(spans, symbols in them) of a list of spans, overlapping and touching ones joined."""
    none = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("spans"),
                    F.lit(0).cast("long").alias("symbols"))

    def add(so_far: Column, span: Column) -> Column:
        end = so_far["end"]
        fresh = F.greatest(span["stop"] - F.greatest(span["start"], end), F.lit(0))
        return F.struct(F.greatest(end, span["stop"]).alias("end"),
                        (so_far["spans"] + (span["start"] > end).cast("long")).alias("spans"),
                        (so_far["symbols"] + fresh).alias("symbols"))
    return F.aggregate(F.array_sort(spans), none, add)


def removal_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 400,
                    words: int | None = None) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``words``, n_passages and n_passage_words follow: the passages that :func:`remove_passages` takes out, and
    the words in them.  The columns before are those of strings of ``size`` bytes all the same.
    """
    found = repeats(docs.select(*text_keys(F.col(text))), size).select(
        "k1", "k2", "whole", cut_digest()("text", "spans").alias("cut"))
    k1, k2, body = text_keys(F.col(text))
    rows = docs.select(F.col(id).alias("_id"), k1, k2, body).select(
        "_id", "k1", "k2", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    whole = F.coalesce("whole", F.lit(False))
    joined, passages = rows.join(found, ["k1", "k2"], "left"), []
    if words is not None:
        joined = joined.join(repeats(docs.select(*text_keys(F.col(text))), words, WORDS, sized=True).select(
            "k1", "k2", span_counts(F.col("spans")).alias("passages")), ["k1", "k2"], "left")
        passages = [F.coalesce("passages.spans", F.lit(0)).cast("long").alias("n_passages"),
                    F.coalesce("passages.symbols", F.lit(0)).cast("long").alias("n_passage_words")]
    return joined.select(
        F.col("_id").alias(id), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("cut.n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("cut.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut.kept_sha256", "own")).alias("kept_sha256"),
        *passages)


def remove_repeats(docs: DataFrame, text: str = "text", size: int = 400) -> DataFrame:
    """The documents, all columns, with repeated strings cut from ``text``."""
    one, two, whole, cut = (free(docs, name) for name in ("_k1", "_k2", "_whole", "_cut"))
    found = repeats(docs.select(*text_keys(F.col(text))), size).select(F.col("k1").alias(one), F.col("k2").alias(two),
                                             F.col("whole").alias(whole), cut_text()("text", "spans").alias(cut))
    k1, k2, _ = text_keys(F.col(text))
    joined = docs.join(found, (k1 == F.col(one)) & (k2 == F.col(two)), "left")
    left = F.when(F.coalesce(whole, F.lit(False)), "").otherwise(F.coalesce(cut, F.col(text)))
    return joined.withColumn(text, left).drop(one, two, whole, cut)


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the space behind each of them; none is left at the end if the last goes."""
    starts, stops = word_borders(np.frombuffer(text, np.uint8))
    if not spans:
        return text
    edges = np.append(starts, len(text))
    left = remaining(text, [(int(edges[a]), int(edges[b])) for a, b in spans])
    return left.rstrip(b" \t\n\v\f\r") if spans[-1][1] == len(starts) else left


def cut_words():
    """A column function: text and spans of words to the remaining text; a null list cuts nothing."""
    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([t if s is None or t is None else without_words(t.encode(), merged(list(s))).decode()
                             for t, s in zip(texts, spans)], dtype=object)
    return cut


def remove_passages(docs: DataFrame, text: str = "text", words: int = 50) -> DataFrame:
    """The documents, all columns, without passages of ``words`` words and more that also start anywhere else.

    Words are runs of bytes but space and 0x09 to 0x0D; what lies between them does not matter, so texts with
    equal words are copies of each other and lose all words.  Null texts stay null, shorter texts stay whole.
    """
    one, two, whole, spans = (free(docs, name) for name in ("_k1", "_k2", "_whole", "_spans"))
    k1, k2, body = text_keys(F.col(text))
    found = repeats(docs.select(k1, k2, body), words, WORDS).select(
        F.col("k1").alias(one), F.col("k2").alias(two), F.col("whole").alias(whole), F.col("spans").alias(spans))
    joined = docs.join(found, (k1 == F.col(one)) & (k2 == F.col(two)), "left")
    # Equal texts of fewer words are no passages; only copies are counted here.
    long = F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")) >= words
    left = F.when(F.coalesce(F.col(whole), F.lit(False)), F.when(long, F.lit("")).otherwise(F.col(text))).otherwise(
        cut_words()(F.col(text), F.col(spans)))
    return joined.withColumn(text, left).select(*docs.columns)
