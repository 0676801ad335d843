"""Passages against brute force, hot seeds, budgets of long documents, names that clash, and an
independent look at the pipeline's stages."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from timbral.llm import mixing, passages, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def planted(rng, words, similarity, n):
    """A word sequence and a copy with changed words, never the first or last."""
    own = rng.integers(1, 1 << 31, words)
    other = own.copy()
    at = rng.choice(np.arange(1, words - 1), round(words * (1 - similarity)), replace=False)
    other[at] = rng.integers(1, 1 << 31, len(at))
    around = lambda x: np.r_[rng.integers(1, 1 << 31, n), x, rng.integers(1, 1 << 31, n)].astype(np.uint32)
    return around(own), around(other)


@pytest.mark.parametrize("similarity", [0.8, 0.9, 1.0])
def test_recall_of_planted_passages(similarity):
    """Seeds, chains and alignment find nine of ten planted passages of 50 to 80 words at least."""
    rng = np.random.default_rng(7)
    found = 0
    for i in range(150):
        a, b = planted(rng, (50, 60, 80)[i % 3], similarity, 90)
        (ha, _, ma), (hb, _, mb) = (passages.seeds_of(w, np.array([0, len(w)])) for w in (a, b))
        at = dict(zip(ha.tolist(), ma.tolist(), strict=True))
        both = [(m, at[h]) for h, m in zip(hb.tolist(), mb.tolist(), strict=True) if h in at]
        x, y = passages.anchors_of(*(np.array(c, dtype=np.int32) for c in zip(*both, strict=True))) if both else (np.zeros(0, int),) * 2
        chains = [c for c in passages.chains(x, y) if sum(p[3] for p in c) >= passages.LEAST] if len(x) else []
        for c in chains:
            blocks = [p[:3] for p in c]
            assert passages.most_matches(b, a, blocks) >= sum(round((e - s) * q) for s, e, _, _, q in passages.align(b, a, blocks, 50, 0.8)[:1])
        found += any(passages.align(b, a, [p[:3] for p in c], 50, 0.8) for c in chains)
    assert found >= 0.9 * 150


@pytest.mark.parametrize("share", [50_000, 1])
def test_passages_by_brute_force(spark, monkeypatch, share):
    """Runs of 50 equal words connect their documents, as brute force over all windows has it,
    whatever lines they are made of, and however the seeds are dealt."""
    monkeypatch.setattr(passages, "SHARE", 1 << 30 if share > 1 else 1)
    monkeypatch.setattr(passages, "SAMPLE", 1)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = [[word() for _ in range(30)] for _ in range(6)]
    bodies = {}
    for i in range(60):  # lines of 30 words that recur on their own, and some that recur in pairs
        parts = [[word() for _ in range(rng.randint(5, 40))] for _ in range(3)]
        a, b = rng.sample(line, 2) if i % 3 else (line[0], line[1])
        bodies[i] = parts[0] + a + (b if i % 3 == 0 else parts[1] + b) + parts[2]
    bodies[70], bodies[71] = ["same"] * 400, ["same"] * 300
    rows = [(i, " ".join(b), "s") for i, b in bodies.items()] + [(80, None, "s"), (81, "", "s"), (82, "few words", "s")]
    got = passages.substring_dedup(docs_of(spark, rows).repartition(3)).collect()
    windows: dict = {}
    for i, b in bodies.items():
        for k in range(len(b) - 49):
            windows.setdefault(tuple(b[k : k + 50]), set()).add(i)
    group = {i: i for i in bodies}
    for ids in windows.values():
        low = min(group[i] for i in ids)
        old = {group[i] for i in ids}
        group = {i: low if g in old else g for i, g in group.items()}
    want = {i for i, n in Counter(group.values()).items() if n > 1}
    member = {r.doc_id: r.component_id for r in got} | {r.other_id: r.component_id for r in got}
    assert member == {i: g for i, g in group.items() if g in want}
    again = passages.substring_dedup(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_budget_of_long_documents():
    for seed in range(20):
        lengths = np.array([20_000, 30_000])
        assert (mixing.fit_budget(lengths, np.array([3, 2]), 60_000, seed) * lengths).sum() == 60_000
    lengths, counts = np.array([7, 9000, 120_001]), np.array([3, 4, 2])
    sums = {7 * a + 9000 * b + 120_001 * c for a in range(4) for b in range(5) for c in range(3)}
    for budget in (120_008, 129_001, 150_000, 240_002, 36_021):
        got = int((mixing.fit_budget(lengths, counts, budget, 3) * lengths).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_stages_with_names_that_clash(spark):
    import corpus_pipeline

    line = "one line that very many of the documents hold"
    docs = docs_of(spark, [(i, f"{line}\nand text {i} of its own, long enough to stay", "a") for i in range(5)] + [(9, None, None), (10, "", "b")])
    for name in ("n_dropped", "n_lines", "times", "copy", "taken"):
        extra = docs.selectExpr("*", f"5 as {name}")
        for stage in (corpus_pipeline.drop_lines, corpus_pipeline.mix_sources):
            plain, got = stage(spark, docs, ""), stage(spark, extra, "")
            assert got.columns == extra.columns
            assert sorted(map(str, got.drop(name).collect())) == sorted(map(str, plain.collect()))
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert sum(line in (t or "") for t in kept.values()) == 1 and kept[4].startswith(line)
    empty = docs.limit(0)
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        assert stage(spark, empty, "").count() == 0


def test_mix_stage_by_brute_force(spark):
    """Each copy of a document in the mix is one that mix() counts."""
    import corpus_pipeline

    docs = docs_of(spark, [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)])
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == Counter({i: n for i, n in times.items() if n})
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert abs(sum(n * words("w " * (i % 7 + 1)) for i, n in got.items()) - 1.5 * sum(words("w " * (i % 7 + 1)) for i in range(60))) <= 7


def test_settled_tables_outlive_their_shuffles(spark):
    df = shared.settle(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "test")
    assert df.count() == 7 and spark.conf.get(shared.CLEANUP) in (None, "false", "true")
    shared.discard(df)


def test_chains_of_many_pairs_at_once():
    """The chains of a batch of pairs are those of each pair by itself."""
    rng = np.random.default_rng(5)
    pair, mark, omark = [], [], []
    for p in range(60):
        x = np.sort(rng.integers(0, 30 + 12 * p, 3 + p // 3))
        y = np.maximum(0, x + rng.choice([-9, 0, 0, 0, 4, 200], len(x)))
        pair += [p] * len(x)
        mark += (2 * x + rng.integers(0, 2, len(x)) * (p % 4 == 0)).tolist()
        omark += (2 * y + (p % 4 == 0)).tolist()
    pair, mark, omark = np.array(pair), np.array(mark, np.int32), np.array(omark, np.int32)
    of, blocks, more = passages.chains_of(pair, mark, omark)
    got = sorted([(int(p), b) for p, b in zip(of, blocks.tolist(), strict=True)] + more)
    want = []
    for p in range(60):
        x, y = passages.anchors_of(mark[pair == p], omark[pair == p])
        want += [(p, [v for b in c for v in b[:3]]) for c in passages.chains(x, y) if sum(b[3] for b in c) >= passages.LEAST]
    assert got == sorted(want) and more and len(of)


def test_passages_of_all_pairs_of_documents(spark):
    """Four different documents of one passage are six pairs; so are changed ones that only one pair shows,
    where other documents hold its seeds too; copies are linked to the first of them."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    text = lambda n: [word() for _ in range(n)]
    bodies, passage = {}, text(60)
    for i in range(4):
        bodies[i] = text(20 + i) + passage + text(30)
    run = text(60)  # 20 and 30 share it all; 10 and 25 have each a half of it
    bodies[10], bodies[25] = text(40) + run[:30] + text(40), text(40) + run[:30] + text(40)
    bodies[20], bodies[30] = text(10) + run[:28] + [word()] + run[29:] + text(9), text(25) + run + text(4)
    bodies[11], bodies[26] = text(40) + run[29:] + text(40), text(40) + run[29:] + text(40)
    bodies[40], bodies[41], bodies[42] = (text(70),) * 3
    bodies[50] = text(30) + bodies[40][:60] + text(30)
    got = passages.substring_dedup(docs_of(spark, [(i, " ".join(b), "s") for i, b in bodies.items()])).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))) for r in got}
    assert pairs == {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(20, 30), (40, 41), (40, 42), (40, 50)}
    assert {r.component_id for r in got if r.doc_id in (41, 42, 50)} == {40}


def test_anchors_of_few_and_of_many_documents():
    h, doc = np.repeat(np.array([7, 9, 11], np.uint64), [4, 6, 1]), np.r_[3, 1, 2, 0, np.arange(6), 8]
    a, _, b, _, top, _, _ = passages.pairs_of(h, doc.astype(np.int64), np.zeros(11, np.int32), 4)
    got = Counter(zip(a.tolist(), b.tolist(), strict=True))
    few = [(i, j) for i in range(4) for j in range(i)]
    assert got == Counter(few + [(i, i - 1) for i in range(1, 6)] + [(i, 0) for i in range(2, 6)]) and not len(top)


def test_block_that_leads_off_a_passage():
    """A passage is found from either side, and in a chain whose first block lies elsewhere."""
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(1, 1 << 31, n).astype(np.uint32)
    run = new(50)
    a, b = np.r_[new(60), run, new(60)], np.r_[new(46), run[:5], new(9), run, new(60)]
    there, back = passages.passages_of(a, b, [(60, 46, 5), (68, 68, 25)], 50, 0.8)
    assert any(e - s >= 50 for s, e, *_ in there) and not back
    short, whole = run[np.r_[0:20, 22:50]], run
    there, back = passages.passages_of(short, whole, [(0, 0, 20), (20, 22, 28)], 50, 0.8)
    assert not there and [p[:4] for p in back] == [(0, 50, 0, 48)]


def test_chains_are_looked_at_together():
    """Of many chains at once the most matches, as most_matches() counts them chain by chain and block by block."""
    rng = np.random.default_rng(5)
    sides, chains = ([], []), []
    for _ in range(400):
        blocks, x, y = [], *rng.integers(0, 90, 2).tolist()
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(5, 40))
            blocks.append((x, y, n))
            x, y = x + n + int(rng.integers(0, 64)), y + n + int(rng.integers(0, 64))
        last = blocks[-1]
        for side, first, end in zip(sides, blocks[0], (last[0] + last[2], last[1] + last[2]), strict=False):
            side.append(rng.integers(0, 3, end - max(0, first - passages.FLANK) + int(rng.integers(0, passages.FLANK + 1))))
        chains.append(blocks)
    packed = []
    for side in sides:
        n = np.array([len(w) for w in side])
        values, size = passages.nibbles(np.concatenate(side), np.cumsum(n) - n, n)
        ends = np.r_[0, np.cumsum(size)].astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(values)])[100:]
        packed.append(passages.from_nibbles(column))
        assert all(np.array_equal(packed[-1][0][s : s + k], w) for s, k, w in zip(*packed[-1][1:], side[100:], strict=True))
    got = passages.most_of_chains(*packed, np.array([b for c in chains[100:] for b in c]), np.array([len(c) for c in chains[100:]]))
    want = []
    for a, b, blocks in zip(*sides, chains, strict=True):
        own = passages._own([v for p in blocks for v in p])
        want.append(max(passages.most_matches(a, b, t) for t in [own, *([p] for p in own)]))
    assert got.tolist() == want[100:] and len(set(map(len, chains))) == 4


def test_rows_of_seeds_grow_with_the_seeds(spark, monkeypatch):
    """Four times the documents, in four times the tasks, make four times the rows of seeds and of anchors, not more."""
    made, rng = Counter(), np.random.default_rng(9)
    settle, bundles = passages.settle, passages._bundles
    monkeypatch.setattr(passages, "PASSES", 1)
    monkeypatch.setattr(passages, "BINS", 16)
    monkeypatch.setattr(passages, "STEP", 1 << 10)
    monkeypatch.setattr(passages, "HELD", 1 << 10, raising=False)

    def counted(name, df):
        made[name, size] += df.count()
        return df

    monkeypatch.setattr(passages, "settle", lambda df, name: counted(name, settle(df, name)))
    monkeypatch.setattr(passages, "_bundles", lambda *a: counted("seeds", bundles(*a)))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    line = rng.integers(0, 1 << 20, (40, 60))
    bodies = [[*rng.integers(0, 1 << 20, 40), *line[i % 40], *rng.integers(0, 1 << 20, 40)] for i in range(160)]
    rows = [(i, " ".join(map(str, b)), "s") for i, b in enumerate(bodies)]
    try:
        for size in (1, 4):
            spark.conf.set("spark.sql.shuffle.partitions", 12 * size)
            docs = docs_of(spark, [(i + 1000 * k, " ".join(f"{w}-{k}" for w in t.split()), s) for k in range(size) for i, t, s in rows])
            made["found", size] = passages.shared_passages(docs.repartition(size)).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert made["found", 4] == 4 * made["found", 1] == 4 * 40 * 6
    assert made["seeds", 4] < 5 * made["seeds", 1] and made["anchors", 4] < 5 * made["anchors", 1]
