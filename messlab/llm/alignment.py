"""Operator 13, alignment of two tokenizers over the same bytes by sparse incidence products.

Both encodings of a text cover the same bytes, so each is an incidence matrix of
tokens and bytes, here in hand-built CSR form (``Csr``).  Its product with the
transposed other one, built row by row (Gustavson), holds for two tokens the
number of bytes they share: the overlap links.  They form a staircase; where
both tokens change from one link to the next a group ends, which is where both
encodings have a border.  The incidence of ids with groups times that of groups with
the other ids holds for two ids how often their tokens share a group: the
shared-group links.  Long groups are no pairs of occurrences, but counted ids,
and products are formed a bounded number of terms at a time.

A text is cut into pieces where both tokenizers have a border whatever stands
around it (a word's end before a space and a Latin letter); equal pieces have equal alignments, so
a task aligns each once and adds them up by one more such product.

An id pair's count is the number of documents that hold it linked.  Pairs are
written with the documents, counted on the map side and summed; counts of the
most frequent pairs, ``FREQUENT`` at most, and the highest count of each id,
bounded by the vocabulary, travel to the tasks.  Documents with rarer pairs,
which are in few documents each, get those counts by a join.

Null and empty texts, and texts whose bytes one of the tokenizers does not give
back, have no tokens: counts are 0 and the digest is the empty string.  Special
tokens in texts are plain text.  Every row is a document of its own, with
equal ids or texts too, and counts as one; a document's
pairs are held in memory, those of a very long text in one piece.  Only id and text are read.  An
empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from messlab.llm.storage import stored

#: Bytes of text aligned together; terms of a product formed together; pairs counted before they are sent on.
TEXTS, TERMS, COUNTED = 1 << 20, 1 << 21, 1 << 20
#: Pairs whose counts travel to every task, at most.
FREQUENT = 1 << 20
#: Pieces that a task keeps, twice, and the longest of them in characters.
KEPT, KEPT_LENGTH = 1 << 17, 64
#: Texts are cut before a space with a letter of A-Z behind a character that is surely no space.
BORDER = re.compile("(?<=[!-~\u00a1-\u024f])(?= [A-Za-z])")
#: Pieces of letters and signs whose classes all versions of Unicode agree on, and which end before such a border.
JOINED = re.compile("(?s) [A-Za-z](?:[\t\n\r -~\u00a1-\u024f\u2010-\u2027]*[!-~\u00a1-\u024f])?").fullmatch
#: Fixed value: how a byte-level vocabulary's words are cut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ------------------------------------------------------------ sparse products

@dataclass
class Csr:
    """Rows of a sparse matrix: row r has columns at[start[r]:start[r + 1]] with the values there."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray


def by_rows(row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int) -> Csr:
    """A matrix of entries sorted by row."""
    return Csr(np.searchsorted(row, np.arange(rows + 1)), at, value)


def summed(row: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Entries sorted by (row, column), equal places added up."""
    key = row * np.int64(width) + at
    if len(key) > 1 and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    return key // width, key % width, np.add.reduceat(value, first) if len(first) else value


def product(a: Csr, b: Csr, width: int, terms: int = TERMS) -> Iterator[tuple[np.ndarray, ...]]:
    """Gustavson's a * b as blocks of (row, column, value): each row of ``a`` adds up the rows of ``b`` it names.

    ``width``: columns of ``b``.  A block has about ``terms`` terms; only a row is never cut.
    """
    length = np.diff(b.start)
    own = np.repeat(np.arange(len(a.start) - 1), np.diff(a.start))
    upto = np.concatenate([[0], np.cumsum(length[a.at])])
    ends = upto[a.start]
    r = 0
    while r < len(a.start) - 1:
        s = max(r + 1, int(np.searchsorted(ends, ends[r] + terms, "right")) - 1)
        lo, hi = a.start[r], a.start[s]
        counts = length[a.at[lo:hi]]
        within = np.arange(counts.sum()) - np.repeat(upto[lo:hi] - upto[lo], counts)
        place = np.repeat(b.start[a.at[lo:hi]], counts) + within
        yield summed(np.repeat(own[lo:hi], counts), b.at[place], np.repeat(a.value[lo:hi], counts) * b.value[place], width)
        r = s


def token_bytes(lengths: np.ndarray) -> Csr:
    """Incidence of tokens, laid end to end, with the bytes they cover."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int32))


def bytes_token(lengths: np.ndarray) -> Csr:
    """The transpose: each byte has one token."""
    total = int(lengths.sum())
    return Csr(np.arange(total + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(total, np.int32))


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two sequences of token lengths over the same bytes: (token of a, token of b, shared bytes), in order."""
    blocks = list(product(token_bytes(a), bytes_token(b), len(b)))
    if not blocks:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*blocks))


def groups(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of the group of each overlap link: a new one begins where both tokens change."""
    new = np.zeros(len(i), np.int64)
    new[1:] = (i[1:] != i[:-1]) & (j[1:] != j[:-1])
    return np.cumsum(new)


# ----------------------------------------------------------------- tokenizers

class Tokenizers:
    """The two tokenizers of a task, loaded once, with the bytes of their ids."""

    def __init__(self, json_path: str, model_path: str):
        self.paths = json_path, model_path

    def load(self) -> Tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(self.paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.paths[1])
        byte_of = byte_letters()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte_of[c] for c in t) if t and all(c in byte_of for c in t) else (t or "").encode()
                        for t in map(self.a.id_to_token, range(size))]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.b_bits = max(1, (len(self.b_bytes) - 1).bit_length())
        # Both split before a space and a letter behind a character that is no space: A's words end there, and no piece of B goes on.
        self.apart = not any(re.search("[^\u2581]\u2581", self.b.id_to_piece(k)) for k in range(len(self.b_bytes)))
        self.fast = self.ranked()
        # An id after the sign that sets it off: in a group, or first of its side.
        self.signed = [f"{sign}{k}" for sign, n in ((",", size), (";", size), (",", len(self.b_bytes)), ("|", len(self.b_bytes)))
                       for k in range(n)]
        return self

    def ranked(self):
        """The first tokenizer as a tiktoken encoding, if its ids are in the order of its merges and it cuts words at the
        usual places; else None."""
        import tiktoken
        with open(self.paths[0]) as file:
            spec = json.load(file)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        special = {t["id"] for t in spec["added_tokens"]}
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        inverse = {k: t for t, k in model["vocab"].items()}
        usual = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True), spec["normalizer"],
                 spec["post_processor"], model.get("ignore_merges", False)) == ("ByteLevel", False, True, None, None, False)
        if not usual or [inverse.get(256 + k) for k in range(len(merged))] != merged:
            return None
        ranks = {x: k for k, x in enumerate(self.a_bytes) if k not in special}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str], joined: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both tokenizers: the ids of all pieces, each beginning with a space, and how many each has.

        A piece whose bytes one does not give back has none.  The first ``joined`` pieces end where both have a
        border whatever follows; they are encoded as one text.
        """
        whole = "".join(pieces[:joined])
        data, ends = whole.encode(), np.cumsum([len(x.encode()) for x in pieces[:joined]])
        out = []
        if joined > 1:
            first = self.fast.encode_ordinary(whole) if self.fast else self.a.encode(whole, add_special_tokens=False).ids
            for ids, lengths, table in ((first, self.a_lengths, self.a_bytes),
                                        (self.b.encode(whole[1:], num_threads=1), self.b_lengths, self.b_bytes)):
                flat = np.array(ids, np.int64)
                borders = np.cumsum(lengths[flat])
                cuts = np.searchsorted(borders, ends) + 1
                if len(flat) != cuts[-1] or (borders[cuts - 1] != ends).any() or b"".join(map(table.__getitem__, ids)) != data:
                    break
                out.append((flat, np.diff(cuts, prepend=0)))
        if len(out) < 2:
            joined, out = 0, [(np.zeros(0, np.int64),) * 2] * 2
        rest: tuple[list, list] = [], []
        for x, one, two in zip(pieces[joined:], self.a.encode_batch_fast(pieces[joined:], add_special_tokens=False),
                               self.b.encode([x[1:] for x in pieces[joined:]], num_threads=1)):
            one = one.ids
            fits = b"".join(map(self.a_bytes.__getitem__, one)) == x.encode() == b"".join(map(self.b_bytes.__getitem__, two))
            rest[0].append(one if fits else [])
            rest[1].append(two if fits else [])
        return [(np.concatenate([flat, np.fromiter(chain.from_iterable(own), np.int64)]),
                 np.concatenate([counts, np.array([len(x) for x in own], np.int64)])) for (flat, counts), own in zip(out, rest)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the
    others, in order, are letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


# ------------------------------------------------------------------ documents

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


#: Alignment of a piece of text: tokens of both (0 if its bytes are not given back), groups, every group behind a
#: semicolon, and linked id pairs, each followed by how often it is linked, 8 bytes each.  Plain tuples, which the
#: garbage collector need not visit.
Piece = tuple[int, int, int, str, bytes]


def align(tools: Tokenizers, pieces: list[str]) -> list[Piece]:
    """The alignment of each piece of text, a space in front of it included."""
    kind = list(map(JOINED, pieces)) if tools.apart else [None] * len(pieces)
    order = [k for k, own in enumerate(kind) if own] + [k for k, own in enumerate(kind) if not own]
    (flat_a, n_a), (flat_b, n_b) = tools.encode([pieces[k] for k in order], sum(map(bool, kind)))
    of_a, of_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
    i, j, _ = overlaps(tools.a_lengths[flat_a], tools.b_lengths[flat_b])
    group = groups(i, j)
    n_groups = int(group[-1]) + 1 if len(group) else 0
    # Every token lies in one group: that of its first overlap link.
    group_a = group[np.searchsorted(i, np.arange(len(flat_a)))] if n_groups else i
    group_b = np.zeros(len(flat_b), np.int64)
    group_b[j[::-1]] = group[::-1]
    # ids x groups, a row for each id of a piece, and groups x ids.
    wide = np.int64(len(tools.a_bytes))
    row, entry, times = summed(of_a * wide + flat_a, group_a, np.ones(len(flat_a), np.int64), max(1, n_groups))
    rows, row = np.unique(row, return_inverse=True)
    left = by_rows(row, entry, times, len(rows))
    right = by_rows(*summed(group_b, flat_b, np.ones(len(flat_b), np.int64), len(tools.b_bytes)), n_groups)
    links = [(np.zeros(0, np.int64),) * 3]
    links += [(rows[r] // wide, rows[r] % wide << tools.b_bits | k, v) for r, k, v in product(left, right, len(tools.b_bytes))]
    of, pair, times = (np.concatenate(c) for c in zip(*links))
    at = np.searchsorted(of, np.arange(len(pieces) + 1)).tolist()
    n_of = np.bincount(of_a[np.searchsorted(group_a, np.arange(n_groups))], minlength=len(pieces)).tolist()
    texts = group_texts(tools, flat_a, of_a, group_a, flat_b, of_b, group_b, n_a + n_b)
    links = np.stack([pair, times], 1).astype(np.int64).tobytes()
    out: list[Piece] = [()] * len(pieces)
    for k, n, m, g, t, s, e in zip(order, n_a.tolist(), n_b.tolist(), n_of, texts, at, at[1:]):
        out[k] = n, m, g, t, links[16 * s:16 * e]
    return out


def group_texts(tools: Tokenizers, flat_a, of_a, group_a, flat_b, of_b, group_b, n: np.ndarray) -> list[str]:
    """Each piece's groups as text."""
    def first(g):
        return np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)

    size_a, size_b = len(tools.a_bytes), len(tools.b_bytes)
    code = np.concatenate([flat_a + size_a * first(group_a), 2 * size_a + flat_b + size_b * first(group_b)])
    # Groups in order, the first tokenizer's tokens before the other's.
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    signed = list(map(tools.signed.__getitem__, code[order].tolist()))
    ends = np.cumsum(n).tolist()
    return ["".join(signed[s:e]) for s, e in zip([0, *ends], ends)]


class Aligner:
    """Aligns texts by their pieces; short pieces met lately are kept.

    A text's linked pairs are the product of the incidence of texts with pieces and that of pieces with pairs.
    """

    def __init__(self, tools: Tokenizers):
        self.tools, self.young, self.old = tools, {}, {}

    def pieces(self, wanted: list[str]) -> list[Piece]:
        young, old = self.young, self.old
        found = {x: young.get(x) or old.get(x) for x in wanted}
        new = [x for x, own in found.items() if own is None]
        found.update(zip(new, align(self.tools, new) if new else []))
        young.update((x, own) for x, own in found.items() if len(x) <= KEPT_LENGTH)
        if len(young) > KEPT:
            self.young, self.old = {}, young
        return list(found.values())

    def rows(self, texts: list[str]) -> list[tuple]:
        """A row of ``ALIGNED`` for each text.  ``pairs``: its linked id pairs, ``times``: how often each is linked."""
        gc.disable()  # many small objects, none of them in cycles
        try:
            return self._rows(texts)
        finally:
            gc.enable()

    def _rows(self, texts: list[str]) -> list[tuple]:
        cut = [(BORDER.split(" " + t) if self.tools.apart else [" " + t]) if t else [] for t in texts]
        number = {x: k for k, x in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        pieces = self.pieces(list(number))
        places = list(map(number.__getitem__, chain.from_iterable(cut)))
        borders = np.cumsum([0, *map(len, cut)]).tolist()
        at, of = np.array(places, np.int64), np.repeat(np.arange(len(texts)), np.diff(borders))
        n_a, n_b, n_groups, groups_of, links_of = zip(*pieces) if pieces else ((),) * 5
        counts = np.array([n_a, n_b, n_groups], np.int64).T
        failed = np.bincount(of, counts[at, 0] == 0, len(texts)) > 0
        at, of = at[~failed[of]], of[~failed[of]]
        totals = [np.bincount(of, counts[at, c], len(texts)).astype(np.int64).tolist() for c in range(3)]
        by_text = by_rows(*summed(of, at, np.ones(len(at), np.int64), max(1, len(pieces))), len(texts))
        linked = np.frombuffer(b"".join(links_of), np.int64).reshape(-1, 2)
        by_piece = Csr(np.cumsum([0, *map(len, links_of)]) >> 4, linked[:, 0], linked[:, 1])
        links = [(np.zeros(0, np.int64),) * 3]
        links += product(by_text, by_piece, len(self.tools.a_bytes) << self.tools.b_bits)
        doc, pair, times = (np.concatenate(c) for c in zip(*links))
        ends = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        out = []
        for k, (s, e) in enumerate(zip(ends, ends[1:])):
            whole = "" if failed[k] else "".join(map(groups_of.__getitem__, places[borders[k]:borders[k + 1]]))
            digest = hashlib.sha256(whole[1:].encode()).hexdigest() if whole else ""
            out.append((*(t[k] for t in totals), int(times[s:e].sum()), digest, pair[s:e].tobytes(), times[s:e].tobytes()))
        return out


@lru_cache(maxsize=1)
def aligner_of(paths: tuple[str, str]) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(Tokenizers(*paths).load())


def aligned(paths: tuple[str, str]):
    """For mapInArrow over (id, text): the id with a row of ``ALIGNED``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(paths)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            ids, texts, start = batch.column("id"), batch.column("text"), 0
            while start < batch.num_rows:
                some, held, stop = [], 0, start
                while stop < batch.num_rows and (not some or held < TEXTS):
                    some.append(texts[stop].as_py() or "")
                    held += len(some[-1])
                    stop += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), *[pa.array(c, k) for c, k in zip(zip(*aligner.rows(some)), kinds)]],
                    ["id", *[c.split()[0] for c in ALIGNED.split(", ")]])
                start = stop
    return run


# -------------------------------------------------------------- corpus counts

def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (pairs): pairs with their number of documents, added up over ``COUNTED`` pairs at a time."""
    pair, docs, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def added():
        new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
        one, at = np.unique(np.concatenate([pair, new]), return_inverse=True)
        return one, np.bincount(at, np.concatenate([docs, times]), len(one)).astype(np.int64)

    for batch in batches:
        for found in batch.column("pairs"):
            waiting.append(np.frombuffer(found.as_py(), np.int64))
            held += len(waiting[-1])
            if held >= COUNTED:
                pair, docs = added()
                waiting, held = [], 0
                if len(pair) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs)], ["pair", "docs"])
                    pair, docs = pair[:0], docs[:0]
    pair, docs = added()
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs)], ["pair", "docs"])


def frequent_from(counts: DataFrame, most: int) -> tuple[int, bool]:
    """(least count such that at most ``most`` pairs have it or more, whether any pair has less), by powers of two."""
    level = F.floor(F.log2("docs")).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least - 1 >= 0 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least, held < sum(sizes.values())


def look_up(pair: np.ndarray, docs: np.ndarray, best: np.ndarray, bits: int):
    """For mapInArrow over stored documents: counts of their frequent pairs, and their other pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best_links, sums, rare, rare_times = [], [], [], []
            for code, times in zip(batch.column("pairs"), batch.column("times")):
                code, times = np.frombuffer(code.as_py(), np.int64), np.frombuffer(times.as_py(), np.int64)
                at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
                known = pair[at] == code if len(pair) else np.zeros(len(code), bool)
                count, linked = docs[at[known]], times[known]
                best_links.append(int(linked[count == best[code[known] >> bits]].sum()))
                sums.append(int((count * linked).sum()))
                rare.append(code[~known])
                rare_times.append(times[~known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in CARRIED] + [pa.array(best_links, pa.int64()), pa.array(sums, pa.int64()),
                                                   pa.array(rare, pa.list_(pa.int64())),
                                                   pa.array(rare_times, pa.list_(pa.int64()))],
                [*CARRIED, "n_best", "count_sum", "rare", "rare_times"])
    return run


CARRIED = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def alignments(docs: DataFrame, json_path: str, model_path: str, id: str = "doc_id", text: str = "text",
               frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    bits = max(1, (sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size() - 1).bit_length())
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(rows.mapInArrow(aligned((json_path, model_path)), f"id {kind}, {ALIGNED}").withColumn("row", F.monotonically_increasing_id()),
                   "aligned")
    counts = stored(found.select("pairs").mapInArrow(count_pairs, "pair long, docs long").groupBy("pair").agg(
        F.sum("docs").alias("docs")), "pair-counts")
    first = F.shiftright("pair", bits)
    tops = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("docs")).toArrow()  # bounded by the vocabulary
    best = np.zeros(int(max(tops.column("a").to_pylist(), default=0)) + 1, np.int64)
    best[tops.column("a").to_numpy()] = tops.column("docs").to_numpy()
    least, rest = frequent_from(counts, frequent)
    known = counts.where(F.col("docs") >= least).toArrow()  # at most ``frequent`` rows
    order = np.argsort(known.column("pair").to_numpy())
    lookup = look_up(known.column("pair").to_numpy()[order], known.column("docs").to_numpy()[order], best, bits)
    looked = found.mapInArrow(lookup, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                              "groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if rest:
        looked = stored(looked, "looked-up")
        each = looked.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("p")).select(
            "row", F.col("p.rare").alias("pair"), F.col("p.rare_times").alias("times"))
        tops = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("top"))
        few = counts.where(F.col("docs") < least).withColumn("a", first).join(F.broadcast(tops), "a").select("pair", "docs", "top")
        more = each.join(few, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("docs") == F.col("top"), F.col("times")).otherwise(0)).alias("best_more"),
            F.sum(F.col("docs") * F.col("times")).alias("sum_more"))
        looked = looked.join(more, "row", "left").withColumn(
            "n_best", F.col("n_best") + F.coalesce("best_more", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("sum_more", F.lit(0)))
    return looked.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
