"""Grams beyond those that go to every task: only their own occurrences leave the tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_documents import brute_ppm
from timbral.llm import ppm

SCHEMA = "doc_id long, text string"


def prose(n):
    """Documents of few syllables, each with a word of its own."""
    rng = random.Random(5)
    syllables = ["en", "er", "ung", "keit", "sch", "ver", "ge"]
    word = lambda: "".join(rng.choices(syllables, k=3))
    own = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    vocabulary = [word() for _ in range(20)]
    return [(i, " ".join([*rng.choices(vocabulary, k=60), own()])) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("held", [0, 600, 1 << 22])
def test_scores_with_some_grams_held(spark, monkeypatch, held):
    rows, made = prose(60), {}
    write = ppm.settle

    def kept(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(ppm, "settle", kept)
    monkeypatch.setattr(ppm, "HELD_GRAMS", held)
    monkeypatch.setattr(ppm, "HOT_WORDS", 5)
    got = {r.doc_id: r for r in ppm.ppm_score(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_ppm([t for i, t in rows if not got[i].held_out], [t for _, t in rows])
    assert np.allclose([got[i].score for i, _ in rows], want, rtol=1e-9)

    every = sorted((r.every for r in made["ppm-counts"].where(F.col("kind") == ppm.GRAM).collect()), reverse=True)
    assert 600 < len(every) < 1 << 22
    lists = [f.name for f in made["ppm-documents"].schema if f.dataType.typeName() == "array" and f.name != "cold"]
    left = sum(made["ppm-documents"].agg(F.sum(F.size(F.coalesce(c, F.array())))).first()[0] for c in lists)
    if held == 600:  # as frequent ones, but for ties
        assert sum(every[held:]) <= left <= sum(n for n in every if n <= every[held])
        assert 0 < left < sum(every) / 5
    else:
        assert left == (0 if held else sum(every))
