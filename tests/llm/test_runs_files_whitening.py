"""Periodic runs, packed token files and whitening against brute force and plain loops."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from timbral.llm import packing, queries, runs, shared, whitening


def brute_runs(words, least_length, least_exponent):
    """All runs by trying each period at each place; a period is smallest if no divisor is one."""
    a, found = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, int), []
    n = len(a)
    for p in range(1, n // least_exponent + 1):
        edge = np.diff(np.r_[0, (a[:-p] == a[p:]).astype(int), 0])
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            own = a[i : j + p]
            smaller = any(p % q == 0 and (own[q:] == own[:-q]).all() for q in range(1, p))
            if len(own) >= max(least_length, least_exponent * p) and not smaller:
                found.append((i, len(own), p))
    return sorted(found)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_all_runs_by_brute_force(exponent):
    rng = random.Random(exponent)
    for i in range(800):
        texts = [[rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(45))] for _ in range(rng.randint(1, 3))]
        if i % 3 == 0:
            texts[0] = fibonacci(rng.randrange(90))
        if i % 4 == 0:
            root = [rng.randrange(2) for _ in range(rng.randint(1, 6))]
            texts[-1] = (root * 12)[: rng.randrange(45)] + texts[-1]
        bounds = np.cumsum([0, *map(len, texts)])
        got = runs.runs_of(np.array(sum(texts, []), np.int64), bounds, 2, exponent)
        want = [(int(b) + s, m, p) for b, t in zip(bounds, texts, strict=False) for s, m, p in brute_runs(t, 2, exponent)]
        assert [tuple(r) for r in got.tolist()] == want, texts


@pytest.mark.parametrize("words", [[0] * 4000, fibonacci(4000), [0, 1, 0, 0, 1] * 800, [*range(2000), *range(2000)]])
def test_work_is_linear(words):
    """Words are compared at most a few times each, also where everything repeats."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    padded = Counted([-2, *words, -1])
    ends, shared_ = runs.lyndon_edges(padded)
    edges = [i for i in range(len(words), 0, -1) if padded[i - 1] == padded[ends[i] - 1]]
    runs.left_matches(padded, ends, edges)
    assert Counted.reads < 25 * len(words)


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, "a b " * 8, 7), (1, "a b " * 8, 7), (2, None, 7), (3, "", 7), (4, " \n\t", 7), (None, "x\x0by\u00a0 x", 7), (5, "z " * 60000, 7), (6, "A a " * 3, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = runs.periodic_runs(docs.repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 3), (1, 16), (1, 16), (2, 0), (3, 0), (4, 0), (5, 60000), (6, 6)]
    by = {r.doc_id: r for r in got}
    assert by[1].asDict() == {"doc_id": 1, "text": "a b " * 8, "runs": 7, "n_words": 16, "runs_": by[1].runs_, "collapsed": "a b"}
    assert [tuple(x) for x in by[1].runs_] == [(0, 16, 2)] and by[5].collapsed == "z" and by[6].runs_ == []
    assert by[2].collapsed == by[3].collapsed == by[4].collapsed == "" and by[None].collapsed == "x y\u00a0 x"
    assert runs.periodic_runs(docs.limit(0)).count() == 0 and runs.run_digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least_exponent=1)


def test_run_query_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs, some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), 0
    for r in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words, 6, 4)
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        some += len(found)
        assert (r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None) == tuple(got[r.doc_id])[:6]
        assert got[r.doc_id].runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert got[r.doc_id].collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert len(got) == len(docs) and some


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packed_ids_are_read_at_any_place(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 64, 4095, 4096, 10_001):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        cut = np.array([0, n // 3, n // 3, n])
        body = packing.packed_file(ids, cut, [-4, None, 9], bits, 3, 77) + packing.TRAILER.encode()
        file = packing.PackedFile(body)
        plain = [int("".join(str((v >> k) & 1) for k in range(bits - 1, -1, -1)), 2) for v in ids[:65].tolist()]
        assert plain == file.ids(0, 65).tolist() and file.ids(0, n).tolist() == ids.tolist()
        assert len(body) - 8 - 64 - 8 * (len(file.offsets) + 4) - 27 == -(-n // 64) * 8 * bits
        for a, b in rng.integers(0, n + 1, (20, 2)):
            assert file.ids(a, b).tolist() == ids[a:b].tolist()
        places = rng.integers(0, n, 50) if n else np.zeros(0, int)
        assert file.at(places).tolist() == ids[places].tolist()
        assert [file.document(k).tolist() for k in range(3)] == [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        with pytest.raises(ValueError):
            packing.PackedFile(body[:-3])
    with pytest.raises(ValueError):
        packing.pack(np.array([1 << bits], np.uint64), bits)
    assert [packing.bits_for(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


ODD = ["á ́ b", "x y  z　w", "don't 'S it’s 've", "<|endoftext|> a<|endoftext|>b", "İstanbul ΣΑΣ", "\x00\x01 \x1c\x85q", "ﬁ ½", "a\tb\nc\x0bd\x0ce\rf"]


@pytest.mark.parametrize("by_words", [True, False])
def test_token_files(spark, monkeypatch, by_words):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "FILE_IDS", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [(i * 3 - 20, " ".join(rng.choices(ODD + ["Words", "of", "no", "moment"], k=rng.randrange(90))), 1) for i in range(50)]
    rows += [(1000 + i, t, 1) for i, t in enumerate(ODD)] + [(7000, None, 1), (7001, "", 1), (7002, "word " * 40_000, 1), (7003, "tie", 1), (7003, "tie", 1), (7003, "other", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    folder = shared.new_path(spark, "ids")
    packing.write_ids(docs.repartition(5), folder, path, end=2, by_words=by_words)
    whole = packing.read_documents(spark, folder).collect()
    own = {}
    for r in whole:
        own.setdefault(r.doc_id, []).append(r.ids)
    for i in {r[0] for r in rows}:
        assert sorted(own[i]) == sorted([*plain.encode(t or "", add_special_tokens=False).ids, 2] for k, t, _ in rows if k == i)
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in whole)
    spans = packing.token_spans(spark, folder).orderBy("start").collect()
    ordered = [r.doc_id for r in spans]
    assert ordered[0] is None and ordered[1:] == sorted(ordered[1:]) and len(ordered) == len(rows)
    assert [r.start for r in spans] == [0, *np.cumsum([r.n_tokens for r in spans])[:-1].tolist()]
    empty = shared.new_path(spark, "ids")
    packing.write_ids(docs.limit(0), empty, path, end=2)
    assert packing.token_spans(spark, empty).count() == 0


def test_token_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = queries.op12_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    for r, g in zip(docs, got, strict=True):
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(g) == (r.doc_id, start, len(ids), zlib.crc32(ids))
        start += len(ids)


def plain_whitening(vectors):
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit) - np.array(sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], e[::-1], u[:, ::-1], np.array(x) - np.array(sums) / n


def test_whitening_query(spark):
    got = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    rows = [r for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, deviation, e, u, centred = plain_whitening([r.embedding for r in rows])
    assert len(got) == 4 * len(rows)
    for c in range(4):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: r.vec_id)
        assert [(r.vec_id, r.n, r.deviation) for r in own] == [(r.vec_id, n, d) for r, d in zip(rows, deviation, strict=True)]
        white, want = np.array([r.whitened for r in own]), centred @ u[:, c] / np.sqrt(e[c])
        assert min(abs(white - want).max(), abs(white + want).max()) < 1e-8
        assert abs(own[0].explained - e[c] / e.sum()) < 1e-9 and {r.identity_error for r in own} == {own[0].identity_error} and own[0].identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.5, -0.25], [-0.001, 2.0, 3.5], [4.0, -1.0, 0.0], [1e5, 7.0, 1.0], [1.0, 0.5, -0.25]]
    rows = [(i, v, 1) for i, v in enumerate([*good, None, [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    n, deviation, e, _, _ = plain_whitening(good)
    got = whitening.whiten(table, components=2).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in range(5) for c in (1, 2)]
    assert [int(r.deviation) for r in got[::2]] == deviation and {r.n_ for r in got} == {n} and {r.n for r in got} == {1}
    assert got[0].whitened == got[8].whitened and abs(got[0].explained - e[0] / e.sum()) < 1e-9
    same = whitening.whiten(table.where("vec_id in (0, 4)"))
    assert same.count() == 0 and same.columns == whitening.whiten(table.limit(0)).columns == ["vec_id", "embedding", "n", "component", "n_", "deviation", "whitened", "explained", "identity_error"]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
