"""Augmentation: ratios, spectra and lengths by closed form, and equal reruns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import augmentation as A


@pytest.fixture(scope="module")
def waves(spark):
    t = np.arange(4000) / 16000
    rows = [(1, (np.sin(2 * np.pi * 1000 * t)).tolist()), (2, (np.sin(2 * np.pi * 50 * t)).tolist())]
    return spark.createDataFrame(rows, "id long, x array<double>")


def test_noise(waves):
    noisy = waves.withColumn("n", A.coloured_noise("pink")(F.size("x"), A.seed_of("id", F.lit("noise"))))
    out = noisy.select("x", "n", A.add_noise(F.col("x"), F.col("n"), 10.0).alias("y")).collect()
    for r in out:
        x, y = np.array(r.x), np.array(r.y)
        assert 10 * np.log10((x**2).mean() / ((y - x) ** 2).mean()) == pytest.approx(10.0, abs=1e-6)
        p = np.abs(np.fft.rfft(r.n)) ** 2
        assert p[10:100].mean() > 5 * p[1000:].mean()
    assert [r.n for r in noisy.collect()] == [r.n for r in noisy.collect()]


def test_filters(waves):
    got = {r.id: np.array(r.y) for r in waves.select("id", A.band_limit("telephone", 16000)(F.col("x")).alias("y")).collect()}
    assert np.abs(got[1][500:3500]).max() == pytest.approx(1, abs=0.05) and np.abs(got[2][500:3500]).max() < 0.25
    shelf = A.biquad(*A.low_shelf(16000, 300.0, 12.0))
    got = {r.id: np.array(r.y) for r in waves.select("id", shelf(F.col("x")).alias("y")).collect()}
    assert np.abs(got[2][2000:]).max() == pytest.approx(10 ** (12 / 20), rel=0.1) and np.abs(got[1][2000:]).max() == pytest.approx(1, abs=0.1)


def test_room_speed_packets(waves):
    room = waves.select("x", A.convolve_room("x", A.synthetic_room(0.05, 16000)).alias("y")).collect()
    assert all(len(r.y) == len(r.x) and np.abs(r.y).max() == pytest.approx(np.abs(r.x).max()) for r in room)
    fast = waves.where("id = 1").select(A.change_speed(2.0)(F.col("x")).alias("y")).first().y
    assert len(fast) == 2000 and np.abs(np.fft.rfft(fast)).argmax() == 250
    lost = waves.select(A.drop_packets(F.transform("x", lambda x: F.lit(1.0)), F.col("id"), 40, 300).alias("y")).collect()
    assert all(0.4 < np.mean(r.y) < 0.95 and set(np.array(r.y).reshape(-1, 40).sum(axis=1)) == {0.0, 40.0} for r in lost)


def test_masks(spark):
    frames = spark.createDataFrame([(u, f, [1.0] * 20) for u in ("a", "b") for f in range(30)], "u string, frame int, m array<double>")
    for u, rows in (("a", None), ("b", None)):
        got = np.array([r.m for r in A.mask_spectra(frames, ["u"], "m", 20, 5, 4, 1).where(F.col("u") == u).orderBy("frame").collect()])
        assert (got.sum(axis=1) == 0).sum() == 5 and (got.sum(axis=0) == 0).sum() == 4 and got.sum() == 25 * 16
