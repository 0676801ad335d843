"""Operators over pages and embeddings, and the pipeline, against brute force."""

import numpy as np
import pytest

from timbral.llm import neighbours, urls
from timbral.llm.queries import ORACLES, QUERIES, RULES


def test_urls(spark):
    link = '<html><head><LINK href="{}" rel=canonical></head></html>'
    rows = [
        (1, "https://a.com/en/1", None),
        (2, "http://x.example.com/en/77?q=1", "<p>"),
        (3, "https://mirror.info/page", link.format("https://a.com/en/1")),
        (4, "https://other.info/", '<meta http-equiv="refresh" content="0; url=https://mirror.info/page#top">'),
        (5, "HTTPS://Example.COM/en/7", link.format("https://a.com/en/1")),
        (6, None, link.format("https://a.com/en/1")),
        (7, "no scheme", link.format("/en/1")),
        (8, "https://clean.info/a/b", link.format("../c")),
        (9, "https://a.net?x=/de/", ""),
        (10, "https://b.net/de/", ""),
        (10, "https://b.net/de/", ""),
        (None, "https://notnet/de/8", ""),
        (11, "https://rel.com/x", link.format("/en/page")),
    ]
    want = {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: (None, "block"), 4: (None, "block"), 5: ("example.com/en/7", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("net/de/", "block"), None: (None, "allow"), 11: (None, "block")}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    table = spark.createDataFrame([tuple(r) for r in RULES], "verdict string, host string, path string")
    for rules in (RULES, table):
        got = urls.url_filter(pages, rules).collect()
        assert len(got) == len(rows)
        assert {r.page_id: (r.rule, r.verdict) for r in got} == want
    by_id = {r.page_id: r for r in got}
    assert (by_id[5].host, by_id[5].path) == ("example.com", "/en/7") and (by_id[9].host, by_id[9].path) == ("a.net", "")
    assert (by_id[6].host, by_id[7].host, by_id[7].path) == ("", "", "")
    assert {r.page_id for r in urls.drop_blocked(pages, RULES).collect()} == {k for k, v in want.items() if v[1] == "allow"}
    assert urls.url_filter(pages.limit(0), RULES).count() == 0


@pytest.mark.parametrize("longest", [96, 12])
def test_neighbours(spark, monkeypatch, longest):
    monkeypatch.setattr(neighbours, "LONGEST", longest)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = [*rng.normal(size=(150, 16)), *[c + rng.normal(scale=0.12, size=16) for c in centres for _ in range(6)], *[centres[0] + rng.normal(scale=0.05, size=16) for _ in range(60)]]
    rows = [(i, [float(v) for v in np.float32(v)], i % 2 if i < 150 else 1) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[200][1], 1) for i in range(20)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[200][1], None), (2004, [], 1), (2005, [1.0, None], 1), (2006, [v * 1e30 for v in rows[200][1]], 1), (2007, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in neighbours.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    fine = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: (l, len(v)) for i, v, l in rows if i in fine}
    linked = {i: {j for j in fine if j != i and label[i] == label[j] and fine[i] @ fine[j] >= 0.93} for i in fine}
    for i, _, _ in rows:
        assert got[i].n_links == len(linked.get(i, ())), i
        seen, todo = {i}, [i]
        while todo:
            more = linked.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert neighbours.embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert {k for k in QUERIES} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    for (name, stage), number in zip(corpus_pipeline.STAGES, range(5), strict=True):
        before = docs
        docs = corpus_pipeline.settle(stage(spark, docs, sf), "stage")
        if number < 4:
            assert docs.columns == before.columns, name
        if number in (0, 2):
            kept = {r.doc_id for r in docs.collect()}
            assert kept and kept <= {r.doc_id for r in before.collect()}
        if number == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert np.mean([i in kept for i in good]) > 0.97
    assert len(names) == 5 and docs.columns[0] == "doc_id" and docs.count() > 0
