"""Stretches of several texts in one go are those of each text alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from messlab.llm import suffixes


@pytest.mark.parametrize("bunch", [suffixes.BUNCH, 700])
@pytest.mark.parametrize("size,unit", [(400, suffixes.BYTES), (50, suffixes.WORDS)])
def test_side_by_side(monkeypatch, size, unit, bunch):
    draw = random.Random(6)
    texts = [" ".join(draw.choices(["é", "b", "cd", "x\x00"], k=draw.randrange(0, 500))).encode() for _ in range(60)]
    texts += [b"", b" \n", b"a" * 900, b"a" * 399, b"a" * 400, b"x " * 300, b"w " * 49, b"w" * 70_000, b"q r " * 20_000]
    texts += [texts[0] * 2, b" " + texts[1], texts[2] + b"\t"]
    draw.shuffle(texts)
    keys = pa.array(range(len(texts)))
    monkeypatch.setattr(suffixes, "BUNCH", bunch)
    batch = pa.RecordBatch.from_arrays([keys, keys, pa.array(texts, pa.binary())], ["k1", "k2", "text"])
    found = [b.to_pydict() for b in suffixes.find_stretches(size, unit)(iter([batch]))]
    rows = [x for f in found for x in zip(f["k1"], f["h"], f["first"], f["last"], f["again"])]
    alone = [(k, *x) for k, t in enumerate(texts) for h, *rest in [suffixes.stretches(unit.body(t), size, unit)]
             for x in zip(h.view(np.int64).tolist(), *(c.tolist() for c in rest))]
    assert rows == alone
    assert unit.bodies(texts) == [unit.body(t) for t in texts]
