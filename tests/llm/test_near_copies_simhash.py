"""The pipeline's near-copy stage takes its first candidates from operator 5 and confirms them exactly."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from messlab.llm import shingles, simhash
from messlab.llm.workers import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def test_sketch_holds_the_fingerprint_of_operator_5():
    for text in ("", "one two", "A b c d E f g", " ".join(map(str, range(300)))):
        same, keys, value = shingles.sketch_of(shingles.words_of(text), 5)
        assert value % (1 << 64) == simhash.fingerprint(text, 5) and len(keys) == (shingles.BANDS if text else 0)


def test_families_follow_links_and_keys(spark):
    """1-2: three bits; 2-3: three more; 4-5: equal prints; 6: four bits from 1; 7-8: a key; 9: no shingles."""
    rows = [(1, [11], 0), (2, [12], 0b111), (3, [13], 0b111111), (4, [14], -1), (5, [15], -1),
            (6, [16], 0b1111 << 40), (7, [17, 20], 0x5555 << 20), (8, [18, 20], 0x3333 << 44), (9, [], 0)]
    found = shingles.families(spark.createDataFrame(rows, "member long, keys array<long>, print long"), 3)
    assert {tuple(r) for r in found.select("member", "family").collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 7)}


def test_stage_uses_operator_5_and_confirms(spark, monkeypatch):
    """No two texts share a MinHash key here, so all candidates are links of fingerprints."""
    draw = random.Random(5)

    def words(n):
        return ["".join(draw.choices("abcdefghij", k=7)) for _ in range(n)]

    def alone(own, width):
        value = simhash.fingerprint_of(own, width)
        key = xxhash.xxh64_intdigest(b" ".join(own)) >> 1
        return xxhash.xxh3_128_digest(b" ".join(own)), np.array([key]), value - (1 << 64) if value >> 63 else value

    monkeypatch.setattr(shingles, "sketch_of", alone)
    base = words(400)
    phrase = words(5) * 50
    texts = [base, [*base[:-1], "other"], phrase + words(20), phrase + words(20)]
    prints = [simhash.fingerprint(" ".join(t), 5) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[2] ^ prints[3]).bit_count() <= 3
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.single(spark, docs, "").collect()) == [0, 2, 3]
