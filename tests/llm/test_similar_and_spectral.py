"""Fingerprint components, whitening and phrases against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from answerlake.llm import collocations, simhash, whitening
from answerlake.llm.common import LOWER
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius=3):
    """Smallest id reachable for (id, code) pairs."""
    of = {i: i for i, _ in codes}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids, values = [i for i, _ in codes], np.array([c for _, c in codes], np.uint64)
    for n, (i, c) in enumerate(codes):
        for m in np.flatnonzero(np.bitwise_count(values[:n] ^ np.uint64(c)) <= radius):
            x, y = sorted((root(i), root(ids[m])))
            of[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_equal_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    codes = sorted((i, plain_fingerprint(t)) for i, t in texts.items())
    want = plain_components(codes)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{c:016x}", want[i]) for i, c in codes}
    assert len(set(want.values())) < len(want)


def test_fingerprint_of_long_text_in_slices(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text.decode())


@pytest.fixture
def planted_codes():
    """A dense ball, chains, pairs at 3 and 4 bits, codes that share their first bits, noise."""
    r = random.Random(3)
    flip = lambda c, k: c ^ sum(1 << b for b in r.sample(range(64), k))
    center, codes = r.getrandbits(64), [0, (1 << 64) - 1]
    codes += [flip(center, r.randrange(4)) for _ in range(700)]
    for _ in range(40):
        c = r.getrandbits(64)
        codes += [c, flip(c, 3), flip(r.getrandbits(64), 4)]
        for _ in range(8):
            c = flip(c, 3)
            codes.append(c)
    lead = r.getrandbits(16) << 48
    codes += [lead | r.getrandbits(48) for _ in range(900)] + [r.getrandbits(64) for _ in range(900)]
    return sorted(set(codes))


@pytest.mark.parametrize("chunk, blocks", [(4096, 4), (64, 4), (97, 5)])
def test_gray_index_finds_every_link(spark, monkeypatch, planted_codes, chunk, blocks):
    """Nodes that fit a chunk and nodes in many pieces, and either choice of bit orders."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    orders = simhash.bit_orders(blocks, 3)
    monkeypatch.setattr(simhash, "bit_orders", lambda *_: orders)
    monkeypatch.setattr(simhash, "_fingerprints", lambda width: lambda: lambda texts: {
        "fp": __import__("pyarrow").array(np.array([int(t) for t in texts], np.uint64).view(np.int64))})
    docs = spark.createDataFrame([(i, str(c)) for i, c in enumerate(planted_codes)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(docs.repartition(5)).collect()}
    assert got == plain_components(list(enumerate(planted_codes)))


def test_bit_orders_leave_no_pair_out():
    r = random.Random(1)
    for blocks in (4, 5):
        orders = simhash.bit_orders(blocks, 3)
        for _ in range(200):
            a = r.getrandbits(64)
            b = a ^ sum(1 << x for x in r.sample(range(64), 3))
            same = 0
            for lead, moves in orders:
                x, y = (sum(((c >> s) & ((1 << w) - 1)) << t for s, w, t in moves) for c in (a, b))
                assert int(simhash._restored(np.array([x], np.uint64), moves)[0]) == a
                same += x >> (64 - lead) == y >> (64 - lead)
            assert same


def test_simhash_of_odd_documents(spark, odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    zero = "0" * 16
    assert len(rows) == odd_docs.count()
    assert by[1] == by[2] == by[3] == {(zero, 1)} and by[4] == by[5] and {c for _, c in by[4]} == {4}
    assert {c for _, c in by[8] | by[9]} == {8} and by[6] == {(by[7].copy().pop()[0], 6)}
    assert by[None] == {(zero, 1), (by[4].copy().pop()[0], 4)}
    assert simhash.simhash_components(no_docs).count() == 0
    alone = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.simhash_components(alone).first().component_id is None


def plain_whitening(vectors, count=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    c = off / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return e, u, c, (off * off).sum(axis=1), e / np.trace(c.T @ c / n)


def check_whitening(rows, ids, vectors, count=8):
    e, u, c, deviation, explained = plain_whitening(vectors, count)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * len(e)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    assert rows[0].residual < 1e-12
    for k in range(len(e)):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        want = c @ u[:, k] / np.sqrt(e[k])
        want *= np.sign(mine @ want)
        assert np.abs(mine - want).max() < 1e-7
    for i, d in zip(ids, deviation):
        assert got[i, 1].deviation == d and got[i, 1].n == len(ids)
        assert abs(got[i, 1].explained / explained[0] - 1) < 1e-9


def test_whitening_equals_dense_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    given = table.collect()
    check_whitening(whitening.whiten(table).collect(), [r.vec_id for r in given], [r.embedding for r in given])


@pytest.mark.parametrize("dim, size", [(3, 40), (20, 9), (150, 400)])
def test_whitening_of_other_shapes(spark, dim, size):
    r = np.random.default_rng(dim)
    vectors = (r.standard_normal((size, dim)) * (1 + np.arange(dim)[::-1])).tolist()
    count = min(8, dim, size - 1)
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    check_whitening(whitening.whiten(df).collect(), list(range(size)), vectors, count)


def test_whitening_drops_bad_vectors(spark):
    r = random.Random(2)
    good = [(i, [r.random() for _ in range(4)]) for i in range(30)] + [(None, [0.5, 0.1, 0.9, 0.3])]
    bad = [(40, None), (41, [1.0, None, 2.0, 3.0]), (42, [float("nan")] * 4), (43, [float("inf"), 0.0, 0.0, 0.0]),
           (44, [1e30] * 4), (45, []), (46, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, id string, x long"
    df = spark.createDataFrame([(*row, "extra", 1) for row in good + bad], schema)
    rows = whitening.whiten(df).collect()
    assert {r.vec_id for r in rows} == {i for i, _ in good} and {r.n for r in rows} == {31}
    assert {r.component for r in rows} == {1, 2, 3, 4} and rows[0].identity_error < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0  # no direction varies
    line = spark.createDataFrame([(i, [i / 8, i / 4]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_solver_without_forming_the_matrix():
    """Wide operators, equal eigenvalues and a bounded subspace."""
    r = np.random.default_rng(4)
    for values in (np.linspace(1, 2, 300) ** 4, np.r_[np.full(6, 9.0), np.linspace(0, 1, 194)], np.r_[5.0, np.zeros(40)]):
        q, _ = np.linalg.qr(r.standard_normal((len(values), len(values))))
        widest = [0]

        def product(w):
            widest[0] = max(widest[0], w.shape[1])
            return q @ (values[:, None] * (q.T @ w))
        got, u, size = whitening.jacobi_davidson(product, len(values), 8)
        top = np.sort(values)[::-1][:8]
        assert np.abs(got - top).max() < 1e-12 * top[0] and size.max() < 1e-12 * top[0]
        assert np.abs(u.T @ u - np.eye(8)).max() < 1e-12 and widest[0] <= 16


def plain_phrases(rows, least, inside=50, first=2000):
    import re
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        longer = max([b for (x, q), b in cand.items() if x == lang and len(q) > len(p) and p in (q[:2], q[1:])], default=0)
        if longer and 100 * longer >= inside * a:
            continue
        score, k, l, r = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items()
            for rank, (score, a, p, l, r) in enumerate(sorted(found)[:first], 1)}


@pytest.mark.parametrize("chunk, bits", [(1 << 20, 1 << 29), (50, 64)])
def test_phrases_equal_plain_counts(spark, monkeypatch, chunk, bits):
    """Also with chunks that cut texts, and with a bit table so full that it admits nearly all."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "MIN_BITS", 64)
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    r = random.Random(8)
    rows = [(r.choice(["en", "fr", None, "und"]),
             "".join(r.choice(["New York City", "new york", "a a a a", "Ünder", "the", "the old man", "x\ty", "the  old"])
                     + r.choice([" ", " ", " ", ", ", ".\n", "!", "\x0b"]) for _ in range(r.randrange(1, 60)))) for _ in range(120)]
    rows += [("en", None), ("fr", ""), (None, None), ("de", "... , ;"), ("en", "a b " * 2000)]
    df = spark.createDataFrame([(*row, 1, "x", 2, "y") for row in rows],
                               "lang string, text string, f int, w1 string, a long, phrase string")
    got = collocations.collocations(df.repartition(3), least=5, first=60).collect()
    assert {tuple(x) for x in got} == plain_phrases(rows, 5, first=60) and len(got) > 100
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10 ** 12, 4 * 10 ** 12, 5 * 10 ** 12)], "a long, l long, r long")
    got = rows.select(collocations._score("a", "l", "r").alias("s")).first().s
    assert got == 10 ** 6 * 9 // 20
    assert rows.select(collocations._score("a", "l", "r").alias("s")).schema["s"].dataType == T.LongType()
    assert rows.select(F.col("a")).count() == 1


def test_ngram_tasks_work_on_small_pieces():
    """What a task holds and returns at once does not grow with the rows of a batch."""
    import pyarrow as pa
    from answerlake.llm import jaccard_join as J
    n = 2 * J.ROWS + 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"a b c{i}" for i in range(n)])], names=["doc", "text"])
    out = [b for b in J._first_pass(3)([batch]) if b.num_rows and b.column("doc").null_count == 0]
    assert [b.num_rows for b in out] == [J.ROWS, J.ROWS, 7]
    assert [x for b in out for x in b.column("doc").to_pylist()] == list(range(n))
