"""The first ten operators against brute force, public libraries, held-out rows and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from messlab.llm import (blocks, bpe, components, embeddings, language, mixing, preference, quality, queries, simhash,
                         suffixes, tokens, toxicity)
from messlab.llm.workers import importable

ODD_TEXTS = ["", " ", "\n\n  a", "日本語テキスト 😀😀", "a" * 5000, "'s 've're  \t  x", "Ünï ß ﬁ \x00\x01", "١٢٣ ½ ２",
             "x" + "  " * 40 + "y", "UPPER lower\r\n\x0b\x0c"]


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty and long texts, repeated rows, columns named like inner ones."""
    long = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "delta"], k=60_000))
    texts = [None, "", "one two", "one two", long, long + "!", "die Katze", *ODD_TEXTS]
    rows = [(None if k == 6 else k // 2, t, "en" if k % 3 else None, "s", 1, 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, k1 int, "
                                                  "_verdict int, _p int")


def groups_of(ids, linked):
    """Smallest reachable id of each; ``linked`` yields pairs of positions."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    least = {}
    for k, x in enumerate(ids):
        least[find(k)] = min(x, least.get(find(k), x))
    return [least[find(k)] for k in range(len(ids))]


# ------------------------------------------------------------------- 1

def test_preference_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    for name, sql in queries.ORACLES.items():
        found, wanted = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).fetchdf()
        assert sorted(found.columns) == sorted(wanted.columns)
        columns = sorted(found.columns)
        assert sorted(map(tuple, found[columns].values.tolist())) == sorted(map(tuple, wanted[columns].values.tolist()))


def test_preference_cases(spark):
    kind = "pair long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "good"),
                                    (2, 0, "user", "same"), (3, None, None, None), (3, 1, "user", "a"),
                                    (None, 0, "user", "lost")], kind)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"),
                                      (2, 0, "user", "same"), (3, 1, "user", "b")], kind)
    rows = preference.formatted(preference.turns(chosen, "pair"), preference.turns(rejected, "pair")).collect()
    found = sorted((r.pair, r.part, r.rendered[r.train_from:r.train_to]) for r in rows)
    assert found == [(1, "chosen", "good<|end|>\n"), (1, "prompt", ""), (1, "rejected", ""),
                     (1, "rejected", "bad<|end|>\n"), (2, "prompt", ""), (3, "chosen", ""), (3, "chosen", ""),
                     (3, "rejected", "")]
    assert preference.formatted(preference.turns(chosen.limit(0), "pair"), preference.turns(
        rejected.limit(0), "pair")).count() == 0


# ------------------------------------------------------------------- 2

def brute_removal(texts, size=400):
    def digest(b, o):
        return hashlib.blake2b(b[o:o + size], digest_size=12).digest()
    seen = Counter(digest(b, o) for b in texts for o in range(len(b) - size + 1))
    out = []
    for b in texts:
        covered = np.zeros(len(b) + 1, int)
        for o in range(len(b) - size + 1):
            if seen[digest(b, o)] > 1:
                covered[o] += 1
                covered[o + size] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def made_texts(seed=5):
    draw = random.Random(seed)

    def prose(n):
        return " ".join("".join(draw.choices("abcdeéß", k=draw.randint(2, 8))) for _ in range(n))
    shared = [prose(90) for _ in range(3)]
    texts = [prose(60) + draw.choice(shared) + prose(60) + draw.choice(shared)[:draw.randint(300, 450)]
             for _ in range(25)]
    base = prose(150)
    near = [base[:k] + "X" + base[k + 1:] for k in range(5, 600, 23)]
    return texts + near + [base] * 3 + ["ab" * 700, "a" * 900, "a" * 399, "a" * 400, "", (prose(20) + "\n") * 8, "é" * 300]


def removal_rows(found):
    rows = found.orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


@pytest.mark.parametrize("stretches", [suffixes.STRETCHES, 3])
def test_removal_matches_brute_force(spark, monkeypatch, stretches):
    """3: nearly every hash is split over shards, whose lists are merged."""
    monkeypatch.setattr(suffixes, "STRETCHES", stretches)
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = suffixes.cut_bodies

    def smaller(size):
        run = cut(size)

        def inner(batches):
            suffixes.STRETCHES = stretches
            return run(batches)
        return inner
    monkeypatch.setattr(suffixes, "cut_bodies", smaller)
    assert removal_rows(suffixes.removal_digests(docs)) == brute_removal([t.encode() for t in texts])


def test_suffix_array_and_long_text_pieces(monkeypatch):
    draw = random.Random(1)
    symbols = np.array([draw.randint(0, 2) for _ in range(3000)], np.uint16)
    order, rank, _ = suffixes.suffix_array(symbols)
    assert order.tolist() == sorted(range(3000), key=lambda k: symbols[k:].tolist())
    assert (rank[order] == np.arange(3000)).all()
    text = made_texts()[0].encode() * 3
    whole = suffixes.stretches(text, 400)
    monkeypatch.setattr(suffixes, "PIECE", 500)
    cut = suffixes.stretches(text, 400)
    spread = [np.repeat(h, last - first + 1) for h, first, last in (whole[:3], cut[:3])]
    assert (spread[0] == spread[1]).all()


def test_remove_repeats_keeps_columns_and_characters(spark):
    shared = "é" * 300
    docs = spark.createDataFrame([(1, "start " + shared, 7), (2, shared + " end", 8), (3, None, 9)],
                                 "doc_id long, text string, _k1 int")
    rows = suffixes.remove_repeats(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r._k1) for r in rows] == [(1, "start ", 7), (2, " end", 8), (3, None, 9)]


# --------------------------------------------------------------- 3, 4, 8, 9

def test_toxicity_on_held_out_rows(spark, docs, labels):
    words = ["tree", "river", "stone", "cloud", "green", "walk", "house", "light"]
    draw = random.Random(2)
    rows = [(k, " ".join(draw.choices(words, k=30) + (["vile", "scum"] if k % 3 == 0 else [])), int(k % 3 == 0))
            for k in range(900)]
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.scores(own.select("doc_id", "text"), own.select("doc_id", "toxic")).toPandas().merge(
        own.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.held_out.size > 100) and (held.predicted == held.toxic).mean() > 0.98
    assert [zlib.crc32(str(k).encode()) % 5 == 0 for k in found.doc_id] == found.held_out.tolist()
    # Labels of held-out rows change nothing.
    lies = own.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                       1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    again = toxicity.scores(own.select("doc_id", "text"), lies).toPandas().sort_values("doc_id")
    assert (again.score.to_numpy() == found.sort_values("doc_id").score.to_numpy()).all()


def test_language_on_held_out_rows(spark, docs):
    found = language.languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert [zlib.crc32(str(k).encode()) % 4 == 2 for k in found.doc_id] == found.held_out.tolist()
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert found.score.between(0, 1).all()


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts(docs):
    repeated = "one two three four five six seven eight nine\n" * 4 + "x " * 30 + "a b | c"
    for text in [None, repeated, *ODD_TEXTS, *(r.text for r in docs.limit(150).collect())]:
        assert quality.counts(text) == brute_counts(text)


def test_quality_verdicts(docs, labels):
    found = quality.judged(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    failed = (found.n_words < 20) | (100 * found.n_repeat_words > 30 * found.n_words)
    assert (found.base_failed == failed).all() and not (found.kept & found.base_failed).any()
    good = found[(found.quality == 1) & ~found.base_failed]
    assert good.kept.mean() > 0.9
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)


def test_mixing_meets_targets(spark):
    draw = random.Random(8)
    common, own = ["tree", "river", "stone", "cloud", "walk"], [["calm"], ["junk", "spam"], ["vile", "scum"]]
    kinds = [draw.choices([0, 1, 2], [6, 3, 1])[0] for _ in range(900)]
    rows = [(k, " ".join(draw.choices(common, k=draw.randint(5, 60)) + own[d]), "x", int(d != 1), int(d == 2))
            for k, d in enumerate(kinds)]
    table = spark.createDataFrame(rows, "doc_id long, text string, extra string, quality int, toxic int")
    docs, labels = table.select("doc_id", "text", "extra"), table.select("doc_id", "quality", "toxic")
    found = mixing.mixed(docs, labels).toPandas()
    reached = np.array([(found.tokens * found.rate * found[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert np.allclose(reached / reached.sum(), mixing.WEIGHTS, atol=1e-4)
    assert (found.rate >= 0).all()
    again = mixing.resample(docs, labels)
    assert again.select("doc_id").distinct().count() == docs.count() and again.columns == docs.columns


def test_rates_stay_at_the_floor(spark):
    rows = [(100, [0.9, 0.1]), (100, [0.1, 0.9]), (0, [0.5, 0.5]), (50, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    steps, targets = mixing.fit_rates(table, (0.02, 0.98), 100.0)
    rates = [r.rate for r in table.withColumn("rate", mixing.rate_of(F.col("posterior"), steps, 0.0)).collect()]
    assert min(rates) >= 0 and rates[3] == 0
    assert targets.sum() == pytest.approx(100)


# --------------------------------------------------------------------- 5, 10

def brute_print(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, docs):
    extra = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([None, *ODD_TEXTS])], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionAll(extra)
    rows = given.orderBy("doc_id").collect()
    prints = np.array([brute_print(r.text) for r in rows], np.uint64)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    found = simhash.near_duplicates(given).orderBy("doc_id").collect()
    assert [r.fingerprint for r in found] == [f"{int(p):016x}" for p in prints]
    assert [r.component_id for r in found] == groups_of([r.doc_id for r in rows], near.tolist())
    kept = simhash.keep_first(given)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.concatenate([base, *[base ^ (np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)) for _ in "ab"]])
    want = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    i, j = simhash.long_links(values, values, radius)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))
    run = np.repeat([0, 1, 2, 3], 30)
    i, j = simhash.short_links(values, run, 30, radius)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((a, b) for a, b in want.tolist() if a < b and run[a] == run[b])


@pytest.mark.parametrize("size", [4, 1000])
def test_blocks_lose_no_link(spark, monkeypatch, size):
    """4: every bucket of a cluster is dealt over many blocks."""
    monkeypatch.setattr(simhash, "BLOCK", size)
    draw = np.random.default_rng(4)
    centre = draw.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.unique(np.concatenate([centre ^ (np.uint64(1) << draw.integers(0, 64, 3).astype(np.uint64))
                                       ^ (np.uint64(1) << draw.integers(0, 64, 3).astype(np.uint64)) for _ in range(25)]))
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    want = groups_of(values.view(np.int64).tolist(), near.tolist())
    found = dict(simhash.fingerprint_groups(spark.createDataFrame([(int(v),) for v in values.view(np.int64)],
                                                                  "print long")).collect())
    assert [found.get(v, v) for v in values.view(np.int64).tolist()] == want


def test_components_of_chains_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (205, 201), (201, 203), (7, 7), (205, 201)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 201: 201, 203: 201, 205: 201}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert blocks.spanning(4, np.array([2, 0]), np.array([3, 2])).tolist() == [0, 1, 0, 0]


def vector_table(spark, seed=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(60, 24))
    rows = [(k, [float(x) for x in centres[k % 60] + draw.normal(size=24) * 0.1], int(k % 60 % 3)) for k in range(600)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(5)] + [(1100, rows[0][1], 1), (1101, rows[0][1], None)]
    rows += [(1200, None, 0), (1201, [], 0), (1202, [0.0] * 24, 0), (1203, [float("nan")] * 24, 0),
             (1204, [None] * 24, 0), (1205, [float("inf")] * 24, 0), (1206, rows[0][1][:5], 0), (1207, rows[0][1][:5], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [8, embeddings.BLOCK])
def test_embeddings_recall(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    table = vector_table(spark)
    rows = table.orderBy("vec_id").collect()
    usable = [r.label is not None and bool(r.embedding) and None not in r.embedding
              and bool(np.isfinite(r.embedding).all()) and any(r.embedding) for r in rows]
    links = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and usable[i] and usable[j] and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding), np.array(b.embedding)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
    found = embeddings.near_duplicates(table).orderBy("vec_id").collect()
    number = Counter(i for i, _ in links)
    assert all(r.n_links <= number[k] for k, r in enumerate(found))
    assert sum(r.n_links for r in found) >= 0.99 * len(links) > 500
    want = groups_of([r.vec_id for r in rows], links)
    assert np.mean([r.component_id == w for r, w in zip(found, want)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


# ---------------------------------------------------------------------- 6, 7

@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_match_the_library(docs, fallback):
    vocabulary = tokens.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("no such piece", 0.0), *vocabulary], 0, fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = [*ODD_TEXTS, *(r.text for r in docs.collect())]
    own = tokens.Counter(vocabulary, fallback)
    assert [own.total(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_count_ties():
    own = tokens.Counter((("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)), False)
    assert own.total("aa") == 2  # ▁a + a and ▁ + aa and ▁ + a + a score alike; the piece that starts first wins
    assert own.total("a") == 1 and own.total("bb") == 2 and own.total("") == 0


def test_byte_bpe_matches_the_library(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, *ODD_TEXTS, "b" * 3000 + " c", *(r.text for r in docs.collect())]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bpe.serialise(ranks)
    rows = table.select("doc_id", bpe.digests(F.col("text"), ranks, public_tokenizers.PATTERN).alias("d")).select(
        "doc_id", "d.*").orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        ids = library.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    pattern = public_tokenizers.PATTERN
    back = table.select(bpe.decoder(model, pattern)(bpe.encoder(model, pattern)(F.col("text"))).alias("b"), "text")
    assert all(bytes(r.b).decode() == (r.text or "") for r in back.collect())


# ------------------------------------------------------------- awkward tables

def doc_queries(docs, labels):
    return {"removal": suffixes.removal_digests(docs), "toxicity": toxicity.scores(docs, labels),
            "language": language.languages(docs), "simhash": simhash.near_duplicates(docs),
            "mixing": mixing.mixed(docs, labels), "quality": quality.judged(docs, labels)}


def test_awkward_rows(spark, awkward, labels):
    for name, found in doc_queries(awkward, labels).items():
        assert found.count() == awkward.count(), name
    assert {r.lang_pred for r in language.languages(awkward).where("doc_id is null or doc_id = 0").collect()} >= {"und"}
    assert quality.keep_good(awkward, labels).columns == awkward.columns
    assert mixing.resample(awkward, labels).columns == awkward.columns
    assert suffixes.remove_repeats(awkward).count() == awkward.count()


def test_empty_tables(spark, docs, labels):
    for name, found in doc_queries(docs.limit(0), labels.limit(0)).items():
        assert found.count() == 0, name
    nothing = toxicity.scores(docs.limit(5), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_pipeline(spark, sf, docs):
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, sf)
        assert given.columns == docs.columns
    final = corpus_pipeline.STAGES[-1][1](spark, given, sf)
    found = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, final.collect()))
    assert 0 < found.select("doc_id").distinct().count() < docs.count()
    assert set(queries.QUERIES) == {q for q in queries.QUERIES if re.match(r"op([1-9]|1[0-3])_", q)} and len(queries.QUERIES) == 13
