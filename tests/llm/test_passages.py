"""Repeated passages by words against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from messlab.llm import suffixes
from messlab.llm.workers import importable

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def plain(texts, size=50):
    """What is left of each text; every window of ``size`` words is counted over the corpus."""
    windows = Counter()
    for t in texts:
        words = WORD.findall(t or "")
        windows.update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = []
    for t in texts:
        at = list(WORD.finditer(t or ""))
        gone = [False] * len(at)
        for k in range(len(at) - size + 1):
            if windows[tuple(m[0] for m in at[k:k + size])] > 1:
                gone[k:k + size] = [True] * size
        keep, last = [], 0
        for k, m in enumerate(at):
            end = at[k + 1].start() if k + 1 < len(at) else len(t)
            if gone[k]:
                keep.append(t[last:m.start()] if k == 0 or not gone[k - 1] else "")
                last = end
        left = None if t is None else "".join(keep) + t[last:]
        out.append(left.rstrip(" \t\n\v\f\r") if at and gone[-1] else left)
    return out


def made(seed=3):
    """Texts with passages of 45 to 80 words put in at several places, periodic texts and copies."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeé", k=draw.randrange(1, 9))) for _ in range(400)]

    def words(n):
        return draw.choices(vocabulary, k=n)

    passages = [words(n) for n in (45, 49, 50, 51, 55, 60, 70, 80) for _ in range(4)]
    texts = []
    for k in range(150):
        own = words(draw.randrange(0, 300))
        for p in draw.sample(passages, draw.randrange(4)):
            at = draw.randrange(len(own) + 1)
            own[at:at] = p
        texts.append("".join(w + draw.choice([" ", " ", " ", "\n", "  "]) for w in own))
    texts += [" ".join(["same"] * 120), " ".join(["a", "b"] * 40), None, "", " \n", "short text", "x" * 90_000,
              " ".join(passages[-1]), "\t".join(passages[-1]) + " ", texts[5], texts[5].replace(" ", "\n")]
    return texts


@pytest.mark.parametrize("stretches", [suffixes.STRETCHES, 3])
def test_passages(spark, monkeypatch, stretches):
    """3: hashes are dealt over shards, whose windows are merged."""
    cut = suffixes.cut_bodies

    def smaller(*arguments):
        run = cut(*arguments)

        def inner(batches):
            suffixes.STRETCHES = stretches
            return run(batches)
        return inner
    monkeypatch.setattr(suffixes, "cut_bodies", smaller)
    texts = made()
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, k1 int, _spans int")
    found = suffixes.remove_passages(table.repartition(4))
    assert found.columns == table.columns
    assert [r.text for r in found.orderBy("doc_id").collect()] == plain(texts)


def test_stage_on_documents(spark, sf):
    """Passages of 51 to 80 words in two documents each go; others keep every word."""
    draw = random.Random(8)
    rows = [list(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    planted = []
    for n in range(51, 81, 3):
        passage = " ".join(f"p{n}x{draw.randrange(10 ** 6)}" for _ in range(n))
        for r in draw.sample(rows[:150], 2):
            r[1] = f"{r[1]} {passage} {draw.random()}"
        planted.append(passage)
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in corpus_pipeline.unrepeated(spark, docs, sf).collect()}
    wanted = {k: t for (k, _), t in zip(rows, plain([t for _, t in rows])) if t}
    assert {k: r.text for k, r in found.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert not any(p in r.text for p in planted for r in found.values())


def test_words():
    assert len(suffixes.codes_of("a  b\x0bc\x00d é".encode())) == 32 and suffixes.codes_of(b" \n") == b""
    one, two = suffixes.codes_of(b"ab ba " + b"x" * 70_000), suffixes.codes_of(b"ab\nab")
    assert one[:8] == two[:8] == two[8:] != one[8:16]


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_passages(table).count() == 0
