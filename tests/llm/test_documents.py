"""Operators over documents against brute force, with nulls, empty and odd texts, and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from timbral.llm import bpe, components, jpeg, lines, mixing, passages, ppm, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "of", "tion", "Straße", "été", "inging", "A", "b.", "x,y"]
    out = [(0, None, "a"), (1, "", "b"), (2, " \n\t", None), (3, "one", "a"), (4, "one", "a"), (5, "ONE two", "a"), (5, "ONE two", "a"), (None, "one two three four", "b")]
    common = ["This line stands in many of the documents.", "  THIS line stands in many of the documents. \r"]
    for i in range(6, 80):
        text = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            text.insert(rng.randint(0, len(text)), common[i % 2])
        out.append((i, "\n".join(text), rng.choice(["a", "b", "c", None])))
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(400))
    out += [(100 + i, base.replace(" w1", f" q{i}", 1), "d") for i in range(12)]
    out += [(200, "word " * 20000 + "end", "d"), (201, "x" * 30000, "e"), (202, "\x00\x1c\u0085 　 a​ 'll 12³ \U0001f600", "e")]
    return out


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if root(x) != x}
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("dense", [1, 128])
def test_simhash(spark, rows, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(i, t): brute_fingerprint(t) for i, t, _ in rows}
    ids = sorted({i for i, _, _ in rows if i is not None})
    by_id = {i: f for (i, _), f in prints.items() if i is not None}
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if group[b] < group[a] and (by_id[a] ^ by_id[b]).bit_count() <= 2:
                    group[a], changed = group[b], True
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == by_id[r.doc_id] and r.component_id == group[r.doc_id]
    kept = simhash.simhash_near_dedup(docs_of(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if group[i] == i} | {None}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("stars", [0, 2])
def test_similar_documents(spark, rows, monkeypatch, stars):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "STARS", stars)
    rng = random.Random(8)
    copies = []
    for g in range(12):
        body = [f"v{rng.randint(0, 10**6)}" for _ in range(300)]
        copies.append((1000 + 10 * g, " ".join(body), "s"))
        for i, changes in enumerate((1, 2, 3, 4, 5, 6, 7, 9), 1):  # similarities from 0.97 to 0.74
            other = list(body)
            for at in rng.sample(range(5, 290, 10), changes):
                other[at] = f"n{rng.randint(0, 10**6)}"
            copies.append((1000 + 10 * g + i, " ".join(other), "s"))
    rows = [*copies, *[r for r in rows if r[0] != 5]]
    sets = {}
    for i, t, _ in rows:
        words = [w.lower() for w in WORD.findall((t or "").encode())]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(i for i in sets if i is not None)
    near = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    group, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for a, b in near:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    got = simhash.similar_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == group
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), "").collect()
    assert {r.doc_id for r in kept} == {i for i in ids if group[i] == i} | {None}
    assert simhash.similar_documents(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("batches", [1, 4])
def test_lines(spark, rows, batches):
    rows = [r for r in rows if r[0] != 5] + [(5, "ONE two", "a")]
    got = {r.doc_id: r for r in lines.line_dedup(docs_of(spark, rows), batches=batches).collect()}
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holders = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    for i, t, _ in rows:
        split = (t or "").split("\n")
        keep = [x for x in split if i is None or len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(keep), len(split), len(split) - len(keep))
    assert any(r.n_dropped for r in got.values())
    clash = docs_of(spark, rows).withColumnRenamed("lang", "n_lines")
    assert lines.line_dedup(clash).columns == [*clash.columns, "n_lines_", "n_dropped"]
    assert lines.line_dedup(docs_of(spark, [])).count() == 0


def test_fit_budget():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 3000, rng.integers(1, 200)))
        counts = rng.integers(1, 20, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        k = mixing.fit_budget(lengths, counts, budget, 1)
        assert (k >= 0).all() and (k <= counts).all()
        mixed = rng.permutation(len(lengths))
        assert (mixing.fit_budget(lengths[mixed], counts[mixed], budget, 1) == k[mixed]).all()
        if len(lengths) > 30:
            assert abs((k * lengths).sum() - budget) <= lengths.min()
    assert mixing.fit_budget(np.array([7]), np.array([1]), 6).tolist() == [1]
    assert mixing.fit_budget(np.array([3, 5]), np.array([2, 2]), 11).tolist() == [2, 1]
    assert mixing.fit_budget(np.array([], dtype=int), np.array([], dtype=int), 5).tolist() == []


def test_mix(spark, rows):
    docs = docs_of(spark, rows + [(300 + i, "same words here", "h") for i in range(50)] * 3).withColumnRenamed("lang", "size")
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and got == mixing.mix(docs).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    sizes = Counter()
    for r in got:
        n = len(WORD.findall((r.text or "").encode()))
        assert r.size_ == n and 0 <= r.taken <= 2 * n and r.taken == r.times * n
        sizes[r.source] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not over:
            goal |= {s: weights[s] * level for s in open_}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 for r in mine)
        largest = max(r.size_ for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[s]) <= largest / 2 + 1
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_bpe(spark, rows):
    import base64

    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    odd = [chr(c) for c in [*range(128), 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x200B, 0xE9, 0x4E2D, 0x1F600, 0x301, 0x660, 0xB2]]
    more = [(400 + i, "".join(rng.choices(odd, k=rng.randint(0, 80))), "z") for i in range(300)] + [(800, "the" * 1500, "z"), (801, " " * 3000, "z"), (802, "<|endoftext|> x", "z")]
    docs = docs_of(spark, rows + more).withColumnRenamed("lang", "token_ids")
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path, pattern), path, "token_ids_")
    for r in back.collect():
        assert r.token_ids_ == known.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe.round_trip_digests(docs, path, pattern).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = known.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.bpe_encode(docs_of(spark, []), path, pattern).count() == 0


def test_jpeg(spark, rows):
    rng = np.random.default_rng(1)
    texts = [b"", bytes(range(256)) * 3, b"\x80" * 1000, b"\x80\x81\x7f" * 500, rng.integers(126, 131, 3000, dtype=np.uint8).tobytes(), b"a" * 576]
    payloads = [jpeg.payload_of(t) for t in texts]
    files = jpeg.encode(payloads)
    images, coef, starts = jpeg.coefficients(files)
    assert [jpeg.stored_payload(x, coef[starts[i] : starts[i + 1]]) for i, x in enumerate(images)] == payloads
    assert files[1] == jpeg.encode(payloads[1:2])[0]
    flat = np.zeros((1, 6, 64), np.int16)
    flat[0, :4, 0] = 80  # a DC of 80 raises each sample by 10
    g = jpeg._written(6)
    assert (jpeg.to_rgb(g, [np.ones(64)] * 3, flat) == 138).all()
    got = jpeg.media_features(docs_of(spark, rows)).collect()
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        payload = jpeg.payload_of((text_of[r.doc_id] or "").encode())
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == len((text_of[r.doc_id] or "").encode())
    assert len({r.feature for r in got if r.doc_id in (3, 4)}) == 1
    media = jpeg.decode_media(jpeg.store_text(docs_of(spark, rows[:9]))).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in media)
    assert jpeg.media_features(docs_of(spark, [])).count() == 0


def test_jpeg_geometry(monkeypatch):
    full = jpeg.DOWN * 8 * 6
    assert jpeg._written(48 * 8)[:2] == (128, 128) and jpeg._written(full)[:2] == (128, 65520)
    for blocks in (full + 1, 3 * full, (2**31 - 1) // 64 + 9):
        g = jpeg._written(blocks)
        assert g.width <= 65535 and g.height <= 65535 and g.mcus[0] * g.mcus[1] * 6 >= blocks
        assert jpeg._head(g, blocks * 64)
    jpeg._written.cache_clear()
    monkeypatch.setattr(jpeg, "DOWN", 3)
    rng = np.random.default_rng(4)
    payloads = [jpeg.payload_of(rng.integers(0, 255, n, dtype=np.uint8).tobytes()) for n in (9000, 9216, 9217, 50000)]
    images, coef, starts = jpeg.coefficients(jpeg.encode(payloads))
    assert max(x.frame.width for x in images) > 128 and max(x.frame.height for x in images) == 48
    assert [jpeg.stored_payload(x, coef[starts[i] : starts[i + 1]]) for i, x in enumerate(images)] == payloads
    jpeg._written.cache_clear()


def brute_ppm(train, texts):
    """log10 probabilities by the definition, symbol by symbol, with dictionaries."""
    body = lambda t: b" ".join(w.lower() for w in WORD.findall((t or "").encode())) + b"\n"
    counts, most = {}, ppm.ORDER
    for t in train:
        s = b"\n" * most + body(t)
        for i in range(most, len(s)):
            for k in range(most + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    out = []
    for t in texts:
        s, total = b"\n" * most + body(t), 0.0
        for i in range(most, len(s)):
            gone, done = set(), False
            for k in range(most, -1, -1):
                c = counts.get(s[i - k : i])
                if c is None:
                    continue
                rest = {x: n for x, n in c.items() if x not in gone}
                t_, d = sum(rest.values()), len(rest)
                if s[i] in rest:
                    total += np.log10((2 * rest[s[i]] - 1) / (2 * t_))
                    done = True
                    break
                if d:
                    total += np.log10(d / (2 * t_))
                gone |= set(c)
            if not done:
                total -= np.log10(256 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("held", [0, 1 << 22])
def test_ppm(spark, rows, monkeypatch, held):
    import zlib

    monkeypatch.setattr(ppm, "HELD_GRAMS", held)
    assert ppm.BLOCK << 8 * (ppm.ORDER + 1) == 1 << 64
    monkeypatch.setattr(ppm, "HOT_WORDS", 5)
    rows = [r for r in rows if r[0] not in (200, 201)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [t for i, t, _ in rows if not out(i)]
    words = lambda t: [w.lower() for w in WORD.findall((t or "").encode())] + [b"\n"]
    c = Counter(w for t in train for w in words(t))
    n = sum(c.values())
    want = sorted(
        (i if i is not None else -1, out(i), len(words(t)), sum(w in c for w in words(t)), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in words(t)), s)
        for (i, t, _), s in zip(rows, brute_ppm(train, [t for _, t, _ in rows]), strict=True)
    )
    got = sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in ppm.ppm_score(docs_of(spark, rows)).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)
    assert ppm.ppm_score(docs_of(spark, [])).count() == 0


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    text = lambda n: [word() for _ in range(n)]
    shared, fuzzy = text(60), text(90)
    changed = [w if i % 12 else word() for i, w in enumerate(fuzzy)]
    bodies = {i: text(rng.randint(20, 200)) for i in range(30)}
    for i in (3, 7, 11):
        bodies[i] = bodies[i][:10] + shared + bodies[i][10:]
    bodies[14] = fuzzy + bodies[14]
    bodies[15] = bodies[15] + changed[:45] + [word()] + changed[45:]
    bodies[20] = list(bodies[21])
    rows = [(i, " ".join(b), "s") for i, b in bodies.items()] + [(50, None, "s"), (51, "", "s"), (None, " ".join(shared), "s")]
    got = passages.substring_dedup(docs_of(spark, rows)).collect()
    long = {i for i in (20, 21) if len(bodies[i]) >= 50}
    assert {r.doc_id for r in got} | {r.other_id for r in got} == {3, 7, 11, 14, 15} | long
    assert {r.component_id for r in got if r.doc_id in (7, 11)} == {3}
    for r in got:
        a, b = (bodies[x][s:e] for x, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)))
        assert len(a) >= 50 and r.identity >= 0.8
        if r.doc_id in (7, 11):
            assert " ".join(shared) in " ".join(a) and " ".join(shared) in " ".join(b)
    assert passages.substring_dedup(docs_of(spark, [])).count() == 0


def test_chains():
    x = np.array([0, 5, 10, 30, 40])
    assert passages.chains(x, x + 7) == [[(0, 7, 45, 5)]]
    x, y = np.array([0, 4, 8, 20, 24, 60]), np.array([0, 4, 8, 23, 27, 2])
    best = passages.chains(x, y)[0]
    assert [b[:2] for b in best] == [(0, 0), (20, 23)]


def test_chains_after_a_long_passage():
    long, near = np.arange(100), np.array([300, 304, 308, 330, 334, 338])
    x, y = np.r_[long, near], np.r_[long, near[:3], near[3:] + 1]  # a word stands between on one side
    got = [[b[:2] for b in c] for c in passages.chains(x, y)]
    assert sorted(got) == [[(0, 0)], [(300, 300), (330, 331)]]
    rng = np.random.default_rng(6)
    for _ in range(50):  # best scores against all pairs of blocks
        x, y = (np.sort(rng.integers(0, 300, 60)) for _ in range(2))
        y = np.clip(x + rng.choice([-9, 0, 4, 150], 60), 0, None)
        x, y = np.unique(np.stack([x, y]), axis=1)
        by = np.lexsort((x, x - y))
        u, v = x[by], y[by]
        cut = passages._edges(u - v, np.cumsum(np.r_[True, np.diff(u) > passages.GAP]))
        ends = np.r_[cut[1:], len(u)] - 1
        blocks = [(int(u[a]), int(v[a]), int(u[e]) + passages.K, int(v[e]) + passages.K, int(e - a + 1)) for a, e in zip(cut, ends, strict=True)]
        score = {}
        for b in sorted(blocks):
            before = [score[c] - passages.GAP_COST * (b[0] - c[2] + b[1] - c[3]) for c in score if 0 <= b[0] - c[2] <= passages.GAP and 0 <= b[1] - c[3] <= passages.GAP]
            score[b] = b[4] + max([0.0, *before])
        best = passages.chains(x, y)[0]
        cost = passages.GAP_COST * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(best, best[1:], strict=False))
        assert abs(sum(b[3] for b in best) - cost - max(score.values())) < 1e-9


def test_passages_with_few_seeds(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows = []
    for i in range(0, 40, 2):
        shared = [word() for _ in range(60)]
        changed = list(shared)
        for at in range(8 + i % 3, 52, 5):  # nine of 60, one word in five: seeds stay at the ends only
            changed[at] = word()
        rows += [(i, " ".join([word() for _ in range(30)] + shared), "s"), (i + 1, " ".join(changed + [word() for _ in range(30)]), "s")]
    got = passages.substring_dedup(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(i + 1, i) for i in range(0, 40, 2)}


def test_quality(spark):
    import zlib

    rng = random.Random(2)
    word = lambda: "".join(rng.choices(["th", "on", "er", "in", "re"], k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        rows.append((i, " ".join(word() + ("" if good else rng.choice(["###", "%%%", " |"])) for _ in range(rng.randint(5, 80))), "s"))
        labels.append((i, int(good)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "on er", "s")]
    table = spark.createDataFrame([*labels, (1000, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs_of(spark, rows), table).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i], y) for i, y in labels if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert {r.doc_id for r in quality.quality_filter(docs_of(spark, rows), table).collect()} == {i for i, r in got.items() if r.predicted or i is None}
    one = quality.quality_scores(docs_of(spark, rows[:5]), table.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1
    assert quality.quality_scores(docs_of(spark, []), table).count() == 0
