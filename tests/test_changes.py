"""Devices, lines and styles: gains, rates, pitches and seeds, by closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import augmentation, devices, filters, glottal, spectra, styles, voice

RATE = 16000
RNG = np.random.default_rng(2)


def generators(n=1, seed=1):
    return [np.random.default_rng(seed + k) for k in range(n)]


def gain(sections, f, rate=RATE):
    z = np.exp(2j * np.pi * f / rate)
    return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sections]))


def spoken(f0=125):
    a = np.real(np.poly([0.97 * np.exp(s * 2j * np.pi * f / RATE) for f in (700, 1800) for s in (1, -1)]))[None]
    return voice.all_pole(np.where(np.arange(RATE) % (RATE // f0) == 0, 1.0, 0.0)[None], a)


def pitch_of(y, low, high):
    size = np.abs(np.fft.rfft(y[2000:-2000] * np.hanning(len(y) - 4000), 1 << 17))
    f = np.fft.rfftfreq(1 << 17, 1 / RATE)
    return f[np.argmax(size * ((f >= low) & (f <= high)))]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_low_and_high_passes(order):
    low, high = filters.low_pass(order, 600, RATE), filters.high_pass(order, 600, RATE)
    for d in (low, high):
        assert abs(20 * np.log10(gain(d, 600)) + 10 * np.log10(2)) < 1e-6
    assert abs(gain(low, 0.001) - 1) < 1e-6 and abs(gain(high, RATE / 2 - 0.001) - 1) < 1e-6 and gain(low, 4000) < 0.2 and gain(high, 60) < 0.2
    with pytest.raises(ValueError):
        filters.low_pass(order, RATE, RATE)


@pytest.mark.parametrize("high", [True, False])
def test_shelves(high):
    s = devices.shelf(RATE, 1500.0, 6.0, high)
    ends = [20 * np.log10(gain(s, f)) for f in (0.01, 1500, RATE / 2 - 0.01)]
    assert np.allclose(ends, [0, 3, 6] if high else [6, 3, 0], atol=1e-3) and abs(np.roots([1, *s[0][3:]])).max() < 1


def test_responses():
    t = np.arange(RATE) / RATE
    tone = lambda f: np.sin(2 * np.pi * f * t)[None]
    level = lambda kind, f: devices.response(tone(f), RATE, kind)[0, 4000:12000].std() / tone(f).std()
    both = lambda *d: np.prod([gain(x, 1000) ** 2 for x in d])
    assert level("telephone", 1000) == pytest.approx(1.2 * both(filters.band_pass(4, 300, 3400, RATE), filters.low_pass(2, 1800, RATE)), rel=1e-3)
    assert level("laptop", 1000) == pytest.approx(both(filters.band_pass(2, 300, 7000, RATE), filters.high_pass(2, 600, RATE)), rel=1e-3)
    assert level("telephone", 60) < 0.01 and level("flat", 60) == 1 and level("smartphone", 2000) > 1.2
    points = ((0.0, 1.0), (2000.0, 0.5), (8000.0, 0.5))
    assert level(points, 6000) == pytest.approx(0.25, abs=0.01) and level(points, 1000) == pytest.approx(0.75**2, abs=0.02)


def test_noise_and_words():
    x = RNG.normal(size=(2, 20_000))
    n = devices.device_noise(x, -20.0, generators(2)) - x
    assert np.allclose(n.std(axis=1), 0.1 * x.std(axis=1)) and np.array_equal(devices.device_noise(x, -20.0, generators(2)) - x, n)
    p = np.abs(np.fft.rfft(n)) ** 2
    assert p[:, 10:1000].mean() > 3 * p[:, -1000:].mean()  # 0.1 against 0.6
    w = devices.word_length(x, 4)
    steps = w / np.abs(x).max(axis=1, keepdims=True) * 7.5
    assert np.allclose(steps, np.rint(steps)) and np.abs(w - x).max() <= np.abs(x).max() / 15 + 1e-9
    assert devices.word_length(x, 24) is x and not devices.word_length(np.zeros((1, 5)), 8).any()


def test_lines():
    t = np.arange(RATE) / RATE
    x = 0.8 * np.sin(2 * np.pi * 1000 * t)[None]
    for kind in ("gsm", "g711", "g729", "voip"):
        y = devices.over_line(x, RATE, kind, generators())
        assert y.shape == (1, 8000) and np.corrcoef(y[0, 500:-500], x[0, 1000:-1000:2])[0, 1] > (0.85 if kind == "voip" else 0.97), kind
        assert np.array_equal(y, devices.over_line(x, RATE, kind, generators()))
    c = devices.companded(x)
    assert 0 < np.abs(c - x).max() < 0.04 and np.abs(c - x)[np.abs(x) < 0.05].max() < 0.003  # finer where it is quiet
    assert devices.over_line(x, 8000, None, generators()) is x
    y = devices._packets(np.arange(1.0, 13)[None], 4, 1.0, generators())
    assert np.allclose(y, [[1, 2, 3, 4, 0.8, 1.6, 2.4, 3.2, 0.64, 1.28, 1.92, 2.56]])


def test_device_chain():
    x = spoken()
    profile = devices.Profile(8000, 12, "laptop", -50.0, "gsm", 0.5)
    got = devices.through_device(x, RATE, profile, generators())
    g = generators()
    y = devices.device_noise(devices.response(x, RATE, "laptop"), -50.0, g)
    y = devices.codec(devices.word_length(voice.resampled(y, 8000), 12), 8000, "gsm", g)
    assert np.array_equal(got, devices.proximity(y, 8000, 0.5)) and got.shape == (1, 8000)
    low = lambda v: np.abs(np.fft.rfft(v[0]))[100:300].mean()
    assert low(devices.proximity(x, RATE, 1.0)) > 5 * low(x)


def test_bent_pitch():
    x = np.sin(2 * np.pi * 300 * np.arange(RATE) / RATE)[None]
    half = np.where(np.arange(RATE) < RATE // 2, 1.0, -1.0)
    y = styles.bent(x, half[None])
    fast, slow = pitch_of(y[0, : RATE // 2 - 500], 200, 400), pitch_of(y[0, RATE // 2 + 500 :], 200, 400)
    assert y.shape == x.shape and fast / slow == pytest.approx(2 ** (2 / 12), rel=0.01) and np.allclose(styles.bent(x, np.zeros((1, 1))), x)


@pytest.mark.parametrize("years,semitones", [(12, 2 + 4 * 0.6), (16, 2.8), (50, -0.75), (70, -1 - 2 / 3), (90, -3.0)])
def test_ages(years, semitones):
    x = spoken()
    y = styles.aged(x, RATE, years, 1024, 256, generators())
    wanted = 125 * 2 ** (semitones / 12)
    harmonic = round(700 / wanted)  # where it is loud
    found = pitch_of(y[0], wanted * harmonic * 0.96, wanted * harmonic * 1.04) / harmonic
    assert y.shape == x.shape and found == pytest.approx(wanted, rel=0.01) and np.abs(y).max() == pytest.approx(np.abs(x).max())


@pytest.mark.parametrize("mood,semitones,speed", [("happy", 1.5, 1.1), ("sad", -2.0, 0.9), ("angry", 1.0, 1.05), ("fear", 1.2, 1.0), ("neutral", 0.0, 1.0), (None, 0.0, 1.0)])
def test_moods(mood, semitones, speed):
    x = np.sin(2 * np.pi * 200 * np.arange(RATE) / RATE)[None]
    y = styles.moody(x, RATE, mood, 1024, 256, generators())
    assert y.shape[1] == round(RATE / speed) and pitch_of(y[0], 100, 400) == pytest.approx(200 * 2 ** (semitones / 12), rel=0.01)
    assert np.array_equal(y, styles.moody(x, RATE, mood, 1024, 256, generators()))


def test_stress():
    x = spoken()
    y = styles.stressed(x, RATE, 1.0, 1024, 256)
    assert y.shape[1] == round(RATE / 1.15) and styles.stressed(x, RATE, 0.0, 1024, 256) is x
    share = lambda v: (np.abs(np.fft.rfft(v[0])) ** 2)[int(v.shape[1] * 3000 / RATE) :].sum() / (v[0] ** 2).sum() / v.shape[1]
    assert share(y) > 1.3 * share(x)


@pytest.mark.parametrize("alpha", [0.85, 1.15])
def test_vocal_tract(alpha):
    """A resonance moves by alpha, the length stays."""
    x = spoken()
    y = styles.perturbed(x, alpha)
    peak = lambda v: glottal.resonances(glottal.burg(v[:, 3000:13000], 12), RATE, 1)[0][0]
    assert y.shape == x.shape and peak(y) == pytest.approx(peak(x) * alpha, rel=0.1) and np.abs(y).max() <= 1 + 1e-9
    z = RNG.normal(size=(1, 3000)) * 0.1
    assert np.allclose(styles.perturbed(z, 1.0), spectra.restored(spectra.centred(z, 512, 128), 512, 128, 3000))


def test_columns_depend_on_their_seeds_alone(spark):
    rows = [(i, [float(v) for v in RNG.normal(size=60 + i % 2)], i % 3, n) for i, n in enumerate(["gsm", "voip", None, "g729", "other", "gsm"])] + [(6, None, 1, "gsm"), (7, [], 1, "gsm"), (8, [1.0], None, "gsm")]
    table = spark.createDataFrame(rows, "id int, x array<double>, seed int, kind string")
    found = {}
    for parts in (1, 4):
        cells = [devices.device(8000)(F.col("x"), F.col("seed").cast("long"), F.col("kind")).alias("d"), devices.line(8000)(F.col("x"), F.col("seed").cast("long"), F.col("kind")).alias("l"), styles.mood(16000, 32, 8)(F.col("x"), F.col("seed").cast("long"), F.col("kind")).alias("m"), styles.age(16000, 80, 48, 12)(F.col("x"), F.col("seed").cast("long"), F.col("kind")).alias("a")]
        found[parts] = {r.id: r for r in table.repartition(parts).select("id", *cells).collect()}
    assert found[1] == found[4]
    assert all(found[1][6][c] is None and found[1][7][c] is None and found[1][8][c] is not None for c in "dlma") and found[1][0].d.rate == 16000
    some = spark.range(4000).select(styles.sometimes(F.array(F.lit(0.0)), F.array(F.lit(1.0)), F.col("id"), "a")[0].alias("a"), styles.sometimes(F.array(F.lit(0.0)), F.array(F.lit(1.0)), F.col("id"), "b", 0.25)[0].alias("b"))
    a, b, both = some.selectExpr("avg(a)", "avg(b)", "avg(a * b)").first()
    assert abs(a - 0.5) < 0.04 and abs(b - 0.25) < 0.04 and abs(both - 0.125) < 0.03


def test_rooms_of_rows_differ(spark):
    rows = spark.range(3).select(augmentation.synthetic_room(0.01, 1000, F.col("id")).alias("h"), augmentation.synthetic_room(0.01, 1000).alias("same")).collect()
    assert len({tuple(r.h) for r in rows}) == 3 and len({tuple(r.same) for r in rows}) == 1
    assert all(len(r.h) == 10 and r.h[0] == 1.0 and np.allclose(np.abs(r.h[1:]), 0.3 * np.exp(-6.907755278982137 * np.arange(1, 10) / 10)) for r in rows)
