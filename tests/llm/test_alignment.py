"""Token alignment against a plain walk over both encodings."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from messlab.llm import alignment
from messlab.llm.workers import importable

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "日本語テキスト 😀😀", "aaaa" * 300, "one two  three\n\n four", "<|endoftext|> and <s> and <0x41>", "Ünï ß ﬁ \x01",
       "▁ under", "null\x00byte", "▁", "١٢٣ ½ ２", "x" + " " * 70 + "y", "one two  three\n\n four", "ab\r\n\tcd e​"]


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def plain(texts):
    """A row for each text: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    found = []
    for text in texts:
        groups, pairs = [], Counter()
        if text:
            whole = (" " + text).encode()
            one = a.encode(" " + text, add_special_tokens=False).ids
            two = b.encode(text)
            one = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in one]
            two = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else
                    b.id_to_piece(k).replace("▁", " ").encode()) for k in two]
            if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two):
                at = [0, 0]
                group = [[], []]
                place = [0, 0]
                while place[0] < len(one) or place[1] < len(two):
                    side = 0 if at[0] <= at[1] else 1
                    token = (one, two)[side][place[side]]
                    place[side] += 1
                    at[side] += len(token[1])
                    group[side].append(token[0])
                    if at[0] == at[1]:
                        groups.append(group)
                        group = [[], []]
                for x, y in groups:
                    pairs.update((p, q) for p in x for q in y)
        found.append((groups, pairs))
    docs = Counter(pair for _, pairs in found for pair in pairs)
    top = {}
    for (p, _), n in docs.items():
        top[p] = max(top.get(p, 0), n)
    rows = []
    for groups, pairs in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(pairs.values()),
                     sum(n for pair, n in pairs.items() if docs[pair] == top[pair[0]]),
                     sum(n * docs[pair] for pair, n in pairs.items()),
                     hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


def rows_of(found):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()}


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 300, 0])
def test_documents(spark, sf, frequent):
    """Fewer frequent pairs: the others are joined."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10 ** 6 + k, t) for k, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = rows_of(alignment.alignments(table, JSON, MODEL, frequent=frequent))
    wanted = dict(zip([k for k, _ in rows], plain([t for _, t in rows])))
    assert found == wanted
    assert wanted[10 ** 6 + 1] == (0, 0, 0, 0, 0, 0, "") and wanted[10 ** 6 + 4][0] > 0


def test_small_blocks(monkeypatch):
    """Products in many blocks, pieces forgotten at once, whole texts as pieces: the same rows."""
    texts = [*(t or "" for t in ODD), "Zwei Wörter, drei\nWörter und  vier. " * 9]
    whole = alignment.Aligner(alignment.Tokenizers(JSON, MODEL).load()).rows(texts)
    monkeypatch.setattr(alignment.product, "__defaults__", (3,))
    monkeypatch.setattr(alignment, "KEPT", 2)
    tools = alignment.Tokenizers(JSON, MODEL).load()
    aligner = alignment.Aligner(tools)
    assert [aligner.rows([t])[0] for t in texts] == whole and aligner.rows(texts) == whole
    assert tools.apart
    tools.apart = False
    assert alignment.Aligner(tools).rows(texts) == whole


def test_products():
    draw = np.random.default_rng(4)
    for _ in range(20):
        m, k, n = draw.integers(1, 12, 3)
        x, y = (draw.integers(0, 3, s) * (draw.random(s) < 0.4) for s in ((m, k), (k, n)))
        a, b = (alignment.by_rows(*np.nonzero(z), z[np.nonzero(z)], len(z)) for z in (x, y))
        got = np.zeros((m, n), int)
        for r, c, v in alignment.product(a, b, n, terms=4):
            got[r, c] += v
        assert (got == x @ y).all()


def test_overlaps_and_groups():
    i, j, shared = alignment.overlaps(np.array([2, 3, 1, 4]), np.array([1, 4, 1, 1, 3]))
    assert list(zip(i, j, shared)) == [(0, 0, 1), (0, 1, 1), (1, 1, 3), (2, 2, 1), (3, 3, 1), (3, 4, 3)]
    assert alignment.groups(i, j).tolist() == [0, 0, 0, 1, 2, 2]


def test_awkward_tables(spark):
    table = spark.createDataFrame([(None, "one two", 1, 2), (None, "one two", 1, 2), (4, None, 1, 2)],
                                  "doc_id long, text string, row int, pairs int")
    found = alignment.alignments(table, JSON, MODEL).collect()
    assert sorted((r.n_links, r.n_best, r.count_sum) for r in found) == [(0, 0, 0), (2, 2, 4), (2, 2, 4)]
    assert alignment.alignments(table.limit(0), JSON, MODEL).count() == 0


def test_very_long_text(spark):
    text = "word " * 100_000 + "a" * 100_000
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows_of(alignment.alignments(table, JSON, MODEL))[1] == plain([text])[0]
