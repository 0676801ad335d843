"""Modulations, stress, levels, octaves, cuts, beams, logs and reports against closed forms and loops."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import measures, spectra
from timbral.operators import learning, scores
from timbral.sources import logs

RNG = np.random.default_rng(8)


def test_modulation_stats():
    x = RNG.normal(size=(2, 600))
    got = measures.modulation_stats(x, 64, 16)
    for r in range(2):
        size = np.abs(spectra.centred(x[r : r + 1], 64, 16))[0].T
        m = np.abs(np.fft.fft2(np.log(size + 1e-10)))[1:16, 1 : size.shape[1] // 4]
        rows, columns = np.arange(m.shape[0])[:, None], np.arange(m.shape[1])[None]
        want = (m.mean(), m.std(), (rows * m).sum() / m.sum(), (columns * m).sum() / m.sum())
        assert np.allclose([got[k][r] for k in ("mean", "deviation", "spectral_centre", "temporal_centre")], want)
    assert measures.modulation_stats(np.ones((1, 2)), 4, 4)["mean"].tolist() == [0.0]


def test_stress_of_an_envelope():
    e = np.zeros(60)
    e[[10, 20, 35]] = 1.0, 0.5, 0.75
    n, mean, spread, gaps = measures.stress_of(e)
    assert n == 3 and mean == 0.75 and spread == pytest.approx(np.std([1, 0.5, 0.75]) / 0.75) and gaps == pytest.approx(2.5 / 12.5)
    assert measures.stress_of(np.zeros(9)) == (0, 0.0, 0.0, 0.0) and measures.stress_of(np.array([0, 1.0, 0])) == (1, 1.0, 0.0, 0.0)


def test_levels():
    t = np.arange(48000) / 48000
    tone = lambda f: np.sqrt(2) * np.sin(2 * np.pi * f * t)[None]
    assert measures.level_a(tone(1000), 48000)[0] == pytest.approx(94.0, abs=0.03)  # 1 pascal
    for f, db in ((100, -19.1), (200, -10.9), (4000, 1.0), (10000, -2.5)):  # the published curve
        assert measures.level_a(tone(f), 48000)[0] - 93.98 == pytest.approx(db, abs=0.1)
    assert measures.level_a(np.zeros((1, 10)), 48000)[0] == pytest.approx(-200 + 0)
    noise = RNG.normal(size=(1, 100_000))
    p = measures.welch(noise, 100.0, 256)
    assert p.shape == (1, 129) and p[0, 2:-2].mean() == pytest.approx(2 / 100, rel=0.02) and measures.welch(noise[:, :5], 100.0, 256).shape == (1, 3)


def test_octaves():
    track = np.array([[100.0, 100, 100, 200, 200, 200, 100, 50, 50, 50, np.nan, np.nan, np.nan, 110]])
    got = measures.corrected(track)[0]
    smooth = [np.median(np.r_[0, 0, np.nan_to_num(track[0]), 0, 0][i : i + 5]) for i in range(14)]
    want = list(smooth)
    for i in range(1, 14):
        if want[i] > 0 and want[i - 1] > 0:
            r = want[i] / want[i - 1]
            want[i] = want[i] / 2 if 1.8 < r < 2.2 else want[i] * 2 if 0.45 < r < 0.55 else want[i]
    assert got.tolist() == want and set(want[:10]) == {100.0}


def test_cuts(spark):
    x = np.zeros(4000)
    x[1000:1800], x[2600:3000] = np.sin(np.arange(800)), np.sin(np.arange(400))
    rows = [(1, x.tolist()), (2, [0.0] * 500), (3, None), (4, [])]
    table = spark.createDataFrame(rows, "id int, x array<double>")
    found = {r.id: r for r in table.select("id", measures.trimmed(1000.0, 20.0, 100.0, 64, 16)(F.col("x")).alias("t"), measures.phrases(1000.0, 20.0, 0.5, 64, 16)(F.col("x")).alias("p")).collect()}
    t, p = found[1].t, found[1].p
    assert abs(t.start - 900) <= 64 and abs(t.start + len(t.y) - 3100) <= 80 and t.y == x[t.start : t.start + len(t.y)].tolist()
    assert len(p.starts) == 1 and abs(p.starts[0] - 1000) <= 48 and abs(p.ends[0] - 1800) <= 64
    assert found[2].t.y == [] and found[2].p.starts == [] and found[3].t is found[4].t is found[3].p is None


def test_beams(spark):
    """Waves that reach a channel turned by its weight's opposite add up; others do not."""
    n, k = 64, 4
    phase = np.angle(measures.beam_weights(k, 0.7))
    waves = [[float(v) for v in np.cos(2 * np.pi * 5 * np.arange(n) / n - p)] for p in phase]
    rows = [(1, waves), (2, None), (3, waves[:2]), (4, [*waves[:3], None]), (5, [*waves[:3], [1.0]])]
    table = spark.createDataFrame(rows, "id int, s array<array<double>>")
    found = {r.id: r for r in table.select("id", measures.beamformed(k, 0.7)("s").alias("a"), measures.beamformed(k, 2.5)("s").alias("b")).collect()}
    assert np.allclose(found[1].a, 4 * np.cos(2 * np.pi * 5 * np.arange(n) / n)) and np.abs(found[1].b).max() < 3.9
    assert all(found[i].a is None for i in (2, 3, 4, 5))


def test_peaks_and_floors_in_batches(spark):
    rows = [(u, i, v) for u, t in {1: [0, 5, 5, 0, 3, 0, 5, 0], 2: [1, 1, 1], 3: [2.0]}.items() for i, v in enumerate(map(float, t))]
    table = spark.createDataFrame(rows, "u int, i int, v double")
    assert {r.u: r.peaks for r in scores.peaks(table, ["u"], "i", "v", 2.0, 2).collect()} == {1: [1, 4, 6]}
    assert {r.u: r.peaks for r in scores.peaks(table, ["u"], "i", "v", 2.0, 4).collect()} == {1: [1, 6]}
    got = spark.createDataFrame([([4.0, 0.0, 8.0],), (None,)], "t array<double>").select(scores.recursive_floor(F.col("t"), 0.5).alias("f")).collect()
    assert got[0].f == [4.0, 2.0, 5.0] and got[1].f is None


def test_noise_has_its_distribution(spark):
    u = spark.range(20_000).withColumn("two", F.lit(2)).select(scores.uniform("s", "id", "two").alias("u"), scores.uniform("t", "id", "two").alias("w")).select("u", scores.laplace(F.col("u"), 2.0).alias("x"), "w").toPandas()
    assert abs(u.u.mean()) < 0.01 and abs(u.u.std() - 12**-0.5) < 0.005 and abs(u.u.corr(u.w)) < 0.03
    assert abs(u.x.abs().mean() - 2.0) < 0.06 and abs(u.x.quantile(0.75) - 2 * np.log(2)) < 0.08


def test_logs(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d, 12)
    rows = [(1, "a", at(1)), (2, "a", at(2)), (3, "b", at(2)), (4, None, at(3)), (5, "a", None)]
    table = spark.createDataFrame(rows, "id int, kind string, at timestamp")
    for part in ("id < 3", "id >= 3"):
        logs.append_log(table.where(part), f"{tmp_path}/log", F.col("kind"), "at")
    assert sorted(r.id for r in logs.read_log(spark, f"{tmp_path}/log").collect()) == [1, 2, 3, 4, 5]
    few = logs.read_log(spark, f"{tmp_path}/log", ["a", "b"], "2024-01-02", "2024-01-02")
    assert sorted(r.id for r in few.collect()) == [2, 3]
    assert "PartitionFilters" in few._jdf.queryExecution().toString() and {"log_kind=a", "log_kind=b"} <= set(os.listdir(f"{tmp_path}/log"))
    shapes = spark.createDataFrame([(1, (1.5, [1.0, 2.0], [[1.0], [2.0, 3.0]], None))], "id int, f struct<a: double, b: array<double>, c: array<array<double>>, d: string>")
    logs.write_features(shapes, f"{tmp_path}/json", "id")
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/json") for f in names if f.endswith(".json")]
    with open(files[0]) as f:
        assert json.loads(f.readline()) == {"id": 1, "f": {"a": 1.5, "b": [1.0, 2.0], "c": [[1.0], [2.0, 3.0]]}}


def test_metadata_and_report(spark):
    x = [float(v) for v in np.linspace(-0.5, 1.0, 11)]
    files = spark.createDataFrame([("a.wav", 16000, 1, 1.0, x), ("b.wav", 16000, 1, 0.0, [])], "path string, sr int, channels int, duration_s double, samples array<float>")
    a, b = logs.recording_metadata(files).orderBy("path").collect()
    sizes = np.sort(np.abs(np.float32(x)))
    assert a.rms == pytest.approx(np.sqrt(np.mean(np.square(x))), rel=1e-6) and a.peak == 1.0 and a.dc_offset == pytest.approx(0.25) and a.snr == pytest.approx(20 * np.log10(sizes[9] / sizes[1]), rel=1e-5) and b.peak is None
    rows = spark.createDataFrame([(1, 0.51234, [0.4, None], 33.33, 0.9, 1.5), (2, None, [None, None], None, None, None)], "id int, w double, b array<double>, l double, i double, d double")
    lines = {}
    for r in logs.environment_report(rows, "id", (125.0, 250.0), "w", "b", "l", "i", "d").orderBy("id", "line_no").collect():
        lines.setdefault(r.id, []).append(r.value)
    assert lines[1][4:7] == ["| all | 0.512 |", "| 125 | 0.400 |", "| 250 | N/A |"] and lines[1][8:] == ["- LAeq: 33.3 dB(A)", "- IACC: 0.900", "- time difference: 1.50 ms"]
    assert lines[2][4:7] == ["| all | N/A |", "| 125 | N/A |", "| 250 | N/A |"] and lines[2][-1] == "- LAeq: N/A dB(A)"


def test_private_updates(spark):
    """Clipped values plus noise of the deviation that was asked for, the same again from the same secret."""
    table = spark.range(20_000).select("id", (F.col("id") % 2).alias("c"), F.lit(1.0).alias("v"))
    found = learning.private_updates(table, "c", ["id"], "v", 1.0, 1.0, 1e-5, "s").toPandas()
    again = learning.private_updates(table.repartition(5), "c", ["id"], "v", 1.0, 1.0, 1e-5, "s").toPandas()
    sigma = np.sqrt(2 * np.log(1.25e5))
    noise = found.noisy - 1 / np.sqrt(10_000)
    assert abs(noise.mean()) < 0.1 and noise.std() == pytest.approx(sigma, rel=0.02) and abs((noise.abs() < sigma).mean() - 0.6827) < 0.015
    assert np.array_equal(found.sort_values("id").noisy, again.sort_values("id").noisy) and list(found.columns) == ["id", "c", "v", "noisy"] or set(found.columns) == {"id", "c", "v", "noisy"}
