"""Decompositions, formants, enrolment on disk and the chain against closed forms and loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import decompose, glottal, normalization, voice, wavelets
from timbral.operators import enrolment, learning, process

RATE = 16000
RNG = np.random.default_rng(4)


def column(spark, x, kernel):
    return spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(kernel(F.col("x")).alias("k")).first()["k"]


def test_pitch_classes(spark):
    t = np.arange(8000) / RATE
    for f, k in ((440.0, 9), (261.63, 0), (622.25, 3)):  # A, C, E flat
        chroma = np.array(column(spark, np.sin(2 * np.pi * f * t), decompose.pitch_classes(RATE, 4096, 1024))["chroma"])
        assert (chroma[1:-2].argmax(axis=1) == k).all() and chroma.max() == 1.0
    assert decompose.class_filters(RATE, 4096).sum(axis=0).max() == 1


def test_constant_q():
    t = np.arange(8000) / RATE
    low = 110.0
    x = np.stack([0.7 * np.sin(2 * np.pi * low * 2 ** (k / 12) * t) for k in (7, 24, 31)])
    z = np.abs(decompose.constant_q_transform(x, RATE, 256, low, 48, 12))
    for row, k in zip(z, (7, 24, 31), strict=True):
        assert (row[8:-8].argmax(axis=1) == k).all() and row[8:-8, k] == pytest.approx(0.7, rel=0.02)
    assert not decompose.constant_q_transform(x, 300.0, 256, low, 48, 12)[:, :, 8:].any()


def test_harmonic_and_percussive():
    t = np.arange(16000) / RATE
    tone = np.sin(2 * np.pi * 1000 * t)[None]
    clicks = np.where(np.arange(16000) % 4000 == 2000, 20.0, 0.0)[None]
    ringing, sharp = decompose.ringing_and_clicks(tone + clicks, 512, 128)
    assert np.allclose(ringing + sharp, tone + clicks, atol=1e-6)
    assert np.corrcoef(ringing[0], tone[0])[0, 1] > 0.98 and np.corrcoef(sharp[0], clicks[0])[0, 1] > 0.9


def test_phases_step_by_their_frequency(spark):
    x = np.cos(2 * np.pi * np.arange(600) * 5 / 64 + 0.3)
    found = column(spark, x, decompose.phase_steps(64, 8))
    steps = np.array(found["velocity"])[6:-10, 5]
    assert np.allclose(steps, np.angle(np.exp(2j * np.pi * 5 * 8 / 64))) and np.allclose(np.array(found["acceleration"])[6:-10, 5], 0, atol=1e-9)
    assert np.array(found["phase"]).shape == np.array(found["velocity"]).shape == np.array(found["acceleration"]).shape


def tract(formants, widths):
    z = [np.exp((-np.pi * b + s * 2j * np.pi * f) / RATE) for f, b in zip(formants, widths, strict=True) for s in (1, -1)]
    return np.real(np.poly(z))[None]


def test_formants_and_widths():
    """Six coefficients at 4,000 samples a second: just three resonances."""
    z = [np.exp((-np.pi * b + s * 2j * np.pi * f) / 4000) for f, b in zip((300, 900, 1500), (50, 70, 90), strict=True) for s in (1, -1)]
    x = voice.all_pole(RNG.normal(size=(1, 8000)), np.real(np.poly(z))[None])
    f, b = glottal.sharp_formants(x, 4000, emphasis=0.0)
    assert np.abs(f[0] - (300, 900, 1500)).max() < 10 and np.abs(b[0] - (50, 70, 90)).max() < 15
    assert glottal.sharp_formants(np.zeros((1, 50)), RATE)[0][0].size == 0


def test_residual_and_basic_formants(spark):
    a = tract((600, 1700, 2800), (80, 120, 160))
    x = voice.all_pole(RNG.normal(size=(1, 6000)), a)
    rest = np.array(column(spark, x[0], glottal.lpc_residual(6))["residual"])
    assert not rest[:6].any() and abs(rest[100:].std() - 1) < 0.1
    found = column(spark, x[0], glottal.basic_formants(RATE, 6))["formants"]
    assert np.abs(np.array(found) - (600, 1700, 2800)).max() < 40


def test_closed_phases(spark):
    """Formants of decaying cycles, whose closures are their steep falls."""
    a = tract((700, 1900, 3000), (60, 60, 60))
    cycle = voice.all_pole(np.where(np.arange(160) == 0, -1.0, 0.0)[None], a)[0]
    x = np.tile(cycle, 12)
    rows = [(1, [float(v) for v in x], [100.0] * 120), (2, None, [100.0]), (3, [0.0] * 400, [100.0] * 25), (4, [float(v) for v in x], [0.0] * 120)]
    table = spark.createDataFrame(rows, "id int, x array<double>, f0 array<double>")
    found = glottal.closed_phase_formants(table, ["id"], "x", "f0", 16, RATE, share=0.5).collect()
    assert {r.id for r in found} == {1}
    by = {r.k: r for r in found}
    assert by[0].cycles >= 8 and abs(by[0].formant - 700) < 150


def test_profiles_on_disk(spark, tmp_path):
    x = RNG.normal(size=(40, 4)) + 2
    rows = [(i, i % 2, [float(v) for v in x[i]]) for i in range(40)]
    table = spark.createDataFrame(rows, "id int, speaker int, v array<double>")
    path, at = f"{tmp_path}/profiles", lambda s: F.timestamp_seconds(F.lit(s))
    enrolment.enrol(table.where("id < 10 and speaker = 0"), "speaker", "v", 4, path, at(1))
    enrolment.update(table.where("id >= 10"), "speaker", "v", 4, path, at(2))
    found = {r.speaker_id: r for r in enrolment.profiles(spark, path).collect()}
    one, two = x[[i for i in range(40) if i % 2 == 0]], x[[i for i in range(10, 40) if i % 2]]
    assert np.allclose(found[0].cov, np.cov(one.T).ravel()) and np.allclose(found[0].mean, one.mean(axis=0)) and found[0].n == 20
    assert np.allclose(found[1].mean, two.mean(axis=0)) and found[1].n == 15 and found[1].created_at == dt.datetime(1970, 1, 1, 0, 0, 2)
    assert spark.read.parquet(path).count() == 3
    tried = {r.id: r for r in enrolment.verify(table.union(spark.createDataFrame([(99, 7, [1.0] * 4)], table.schema)), "speaker", "v", path, 0.9).collect()}
    want = (x[3] @ two.mean(axis=0) / np.linalg.norm(x[3]) / np.linalg.norm(two.mean(axis=0)) + 1) / 2
    assert tried[3].similarity == pytest.approx(want) and tried[3].accepted == (want >= 0.9) and tried[99].similarity is None and not tried[99].accepted


def test_gating(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1, 4], [3, 5]), (2, [1.0, 2.0], [], []), (3, [1.0, 2.0], [0], [2])]
    table = spark.createDataFrame(rows, "id int, x array<double>, a array<bigint>, b array<bigint>")
    inside = process.gated(F.col("x"), F.col("a"), F.col("b"))
    back = process.put_back(F.col("x"), F.col("a"), F.col("b"), F.transform(inside, lambda v: -v))
    found = {r.id: r for r in table.select("id", inside.alias("i"), back.alias("y")).collect()}
    assert found[1].i == [2.0, 3.0, 5.0] and found[1].y == [1.0, -2.0, -3.0, 4.0, -5.0, 6.0]
    assert found[2].i == [] and found[2].y == [1.0, 2.0] and found[3].y == [-1.0, -2.0]


def test_chain(spark):
    """Denoised by itself; its loud part normalized by itself."""
    x = np.zeros(3000)
    x[800:2200] = np.sin(np.arange(1400) * 0.3) * (1 + 0.3 * np.sin(np.arange(1400) / 50))
    table = spark.createDataFrame([(1, [float(v) for v in x + 0.001 * RNG.normal(size=3000)]), (2, [0.0] * 600), (3, None)], "id int, x array<double>")
    found = {r.id: r.processed for r in process.preprocessed(table, "x", 2000, 0.1, 64, 16).collect()}
    own = np.array(table.where("id = 1").first().x)
    clean = wavelets.denoised(own[None])[0]
    changed = np.flatnonzero(np.abs(np.array(found[1]) - clean) > 1e-9)
    a, b = changed.min(), changed.max() + 1
    assert len(found[1]) == 3000 and 700 < a < 900 and 2100 < b < 2300 and found[2] == [0.0] * 600 and found[3] is None
    start, stop = a // 16 * 16, -(-b // 16) * 16
    inside = clean[start:stop][None]
    plain = normalization.modulation_normalized(normalization.phase_normalized(normalization.equalized(inside, 64, 16), 64, 16), 2000)[0]
    assert np.allclose(np.array(found[1])[start:stop], plain, atol=1e-6)


def test_retraining_samples(spark):
    rows = spark.createDataFrame([(i, float(i % 10), [float(i % 4), float(i % 7)], "ab"[i % 2]) for i in range(60)], "id long, u double, v array<double>, g string")
    got = learning.retraining_samples(rows, "id", "u", "v", ["g"], 8, "uncertainty").collect()
    top = sorted(range(60), key=lambda i: (-(i % 10), i))[:8]
    assert {r.id for r in got} <= set(top) and len(got) >= 6
    assert {r.id for r in learning.retraining_samples(rows, "id", "u", "v", ["g"], 8, "uncertainty", diverse=False).collect()} == set(top)
