"""The pipeline's near-copy stage against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from messlab.llm import blocks, shingles
from messlab.llm.workers import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def brute_set(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_first(rows):
    """The smallest ids of the groups of (id, text); every pair is compared."""
    sets, group = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (len(a & b) / len(a | b) if a or b else 1) >= 0.8 and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [x if g == y else g for g in group]
    return sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))


def made(seed=12):
    """Texts with copies of 200 words in which 1 to 6 words are new, in chains and in one large group."""
    draw = random.Random(seed)

    def word():
        return "".join(draw.choices("abcdefghij", k=6))

    texts = []
    for _ in range(60):
        words = [word() for _ in range(200)]
        for changes in range(7):
            copy = list(words)
            for at in draw.sample(range(200), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
        words = texts[-1].split()
        words[100] = word()
        texts.append(" ".join(words))
    base = [word() for _ in range(200)]
    for k in range(150):
        copy = list(base)
        copy[k] = word()
        texts.append(" ".join(copy))
    draw.shuffle(texts)
    return [(k, t) for k, t in enumerate([*texts, None, "", " ", "one two", "One  TWO", "one three"])]


@pytest.mark.parametrize("block", [8, shingles.BLOCK])
def test_stage_keeps_one_of_each_group(spark, sf, monkeypatch, block):
    """8: families are dealt over many blocks.  A similarity of 0.8 is about ten bits of a fingerprint."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rows = made()
    found = corpus_pipeline.single(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in found.collect()) == brute_first(rows)


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = corpus_pipeline.single(spark, docs, sf)
    assert found.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in found.collect()) == brute_first(rows)


def test_candidates_at_the_threshold():
    """Pairs of a similarity of exactly 0.8: 40 of 50 shingles in common."""
    draw, missed = np.random.default_rng(3), 0
    for _ in range(3000):
        found = draw.integers(0, 1 << 64, 50, np.uint64)
        one, two = (shingles.band_keys(np.sort(found[s])) for s in (slice(0, 45), slice(5, 50)))
        missed += not (one == two).any()
    assert missed <= 3


def test_weighted_blocks(spark):
    rows = spark.createDataFrame([(0, k, 1.0 if k < 4 else 0.0) for k in range(10)], "bucket long, member long, w double")
    dealt = blocks.blocked(rows, ["bucket"], "member", 100, rows["w"]).collect()
    met = {(a.member, b.member) for a in dealt for b in dealt if a.block == b.block}
    assert len(met) == 100 and len({r.block for r in dealt}) > 1
