"""Recall of the tables of op10 for keys as wide as a large input asks for."""

import math

import numpy as np
import pytest

from messlab.llm import embeddings


@pytest.mark.parametrize("dim, rows", [(64, 100_000), (64, 10**7), (64, 10**8), (32, 10**6), (24, 10**7), (16, 10**5)])
def test_recall_of_large_tables(dim, rows):
    """Pairs at cosines 0.98 to 0.985 that are not those the tables were chosen by."""
    draw = np.random.default_rng(dim)
    codes = embeddings.Codes(embeddings.unit_rows(draw.normal(size=(2000, dim))))
    tables = embeddings.tables(codes, rows, 0.98, embeddings.RECALL)
    one = embeddings.unit_rows(draw.normal(size=(20_000, dim)))
    off = draw.normal(size=one.shape)
    off = embeddings.unit_rows(off - (off * one).sum(1, keepdims=True) * one)
    cosine = draw.uniform(0.98, 0.985, (len(one), 1))
    two = cosine * one + np.sqrt(1 - cosine * cosine) * off
    met = np.zeros(len(one), bool)
    for word, mask in tables:
        differing = embeddings.word_code(codes.word(word), one) ^ embeddings.word_code(codes.word(word), two)
        met |= (differing & np.uint64(mask)) == 0
    assert met.mean() >= 0.99
    # Keys stay wide enough for buckets that do not hold a fixed part of the rows, and share no bit.
    assert all(m.bit_count() >= min(codes.bits // 2, math.log2(rows)) - 4 for _, m in tables)
    assert all(a[0] != b[0] or not a[1] & b[1] for k, a in enumerate(tables) for b in tables[:k])


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_few_dimensions(dim):
    draw = np.random.default_rng(dim)
    codes = embeddings.Codes(embeddings.unit_rows(draw.normal(size=(300, dim))))
    tables = embeddings.tables(codes, 10**6, 0.98, embeddings.RECALL)
    for one, two in embeddings.partners(codes.unit, 0.98, seed=5):
        met = [(embeddings.word_code(codes.word(w), one) ^ embeddings.word_code(codes.word(w), two)) & np.uint64(m) == 0
               for w, m in tables]
        assert not len(one) or np.any(met, 0).mean() > 0.99


def test_off_centre_vectors():
    """Far from the origin a small angle is a wide one around the centre."""
    draw = np.random.default_rng(9)
    codes = embeddings.Codes(embeddings.unit_rows(draw.normal(size=(2000, 64)) + 1.5))
    tables = embeddings.tables(codes, 10**6, 0.98, embeddings.RECALL)
    for one, two in embeddings.partners(codes.unit, 0.98, seed=5):
        met = [(embeddings.word_code(codes.word(w), one) ^ embeddings.word_code(codes.word(w), two)) & np.uint64(m) == 0
               for w, m in tables]
        assert np.any(met, 0).mean() > 0.99
