"""op2's passages of over 50 words that are shorter than its strings of 400 bytes, beside its columns by bytes."""

import hashlib
import random
import re
from collections import Counter

import pytest

from messlab.llm import queries, suffixes

WORD = re.compile("[^\x20\x09-\x0D]+")


def counts(texts, size=50):
    """(passages, words in them) of each text; every window of ``size`` words is counted over the corpus."""
    lists = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k:k + size]) for w in lists for k in range(len(w) - size + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k:k + size])] > 1:
                gone[k:k + size] = [True] * size
        out.append((sum(a and not b for a, b in zip(gone, [False, *gone])), sum(gone)))
    return out


def by_bytes(texts, size=400):
    """(n_bytes, n_removed, kept_sha256) of each text; every string of ``size`` bytes is counted over the corpus."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + size] for b in bodies for k in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k:k + size]] > 1:
                gone[k:k + size] = b"\x01" * size
        left = bytes(x for x, y in zip(b, gone) if not y)
        out.append((len(b), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


def planted():
    """Documents with a passage of 51 to 78 words and under 400 bytes each of which another has too, then others."""
    draw = random.Random(4)

    def words(n):
        return ["".join(draw.choices("abcdeé", k=draw.randrange(3, 6))) for _ in range(n)]
    texts = []
    for n in range(51, 79, 3):
        passage = words(n)
        texts += [" ".join(words(30) + passage + words(20)), "\n".join(words(10) + passage + words(40))]
    clean = [" ".join(words(90)) for _ in range(12)]
    long = " ".join(words(200))
    odd = [long, long, long.replace(" ", "\n"), f"{long} {long}", " ".join(["a"] * 300), " ".join(words(49)) + " ", None,
           None, "", " \n", "short", "short", "x" * 500, "x" * 500, "\t".join(["w"] * 50), "w " * 60]
    return texts, clean, odd


def test_query_counts_passages(spark, tmp_path):
    texts, clean, odd = planted()
    rows = texts + clean + odd
    ids = [None if k % 9 == 4 else k // 2 for k in range(len(rows))]  # repeated and null ones
    docs = spark.createDataFrame(list(zip(ids, rows, range(len(rows)))), "doc_id long, text string, k int")
    docs.drop("k").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op2_suffix_dedup"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]
    wanted = Counter((k, *b, *c) for k, b, c in zip(ids, by_bytes(rows), counts(rows)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256, r.n_passages, r.n_passage_words)
                   for r in found.collect()) == wanted


def test_planted_are_told_from_clean():
    """The rows above hold what they say, so the test before fails where passages are not seen."""
    texts, clean, odd = planted()
    found = counts(texts + clean + odd)
    assert all(n == 1 and w >= 51 for n, w in found[:len(texts)])
    assert all(x == (0, 0) for x in found[len(texts):len(texts) + len(clean)])
    assert all(removed == 0 for _, removed, _ in by_bytes(texts))


@pytest.mark.parametrize("spans,wanted", [([], (0, 0)), ([(0, 50)], (1, 50)), ([(50, 100), (0, 50)], (1, 100)),
                                          ([(3, 60), (10, 62), (4, 55), (100, 150)], (2, 109)), (None, None)])
def test_span_counts(spark, spans, wanted):
    table = spark.createDataFrame([(spans,)], "s array<struct<start: long, stop: long>>")
    row = table.select(suffixes.span_counts(table.s).alias("c")).first().c
    assert wanted == (row and (row.spans, row.symbols))
