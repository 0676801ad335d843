"""Signal kernels against closed forms and plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import batches, filters, glottal, pitch, spectra, voice, wavelets
from timbral.operators import rooms

RNG = np.random.default_rng(5)


def strongest(x, rate, low=0.0, high=1e9):
    size = np.abs(np.fft.rfft(x * np.hanning(len(x)), 1 << 17))
    f = np.fft.rfftfreq(1 << 17, 1 / rate)
    return f[np.argmax(size * ((f >= low) & (f <= high)))]


@pytest.mark.parametrize("moments", [1, 2, 4, 6])
def test_wavelets(moments):
    h = wavelets.scaling_filter(moments)
    for k in range(moments):
        assert abs(h[2 * k :] @ h[: len(h) - 2 * k] - (k == 0)) < 1e-8  # orthonormal to its even shifts
    high = wavelets._high(h)
    assert all(abs((high * np.arange(len(h)) ** m).sum()) < 1e-5 for m in range(moments))  # vanishing moments
    for n in (1, 2, 3, 8, 33, 101):
        x = RNG.normal(size=(3, n))
        assert np.allclose(wavelets.denoised(x, moments, 5, "soft", 0.0), x, atol=1e-7)
        assert np.allclose(wavelets.denoised(x, moments, 5, "hard", 0.0), x, atol=1e-7)


def test_db4_and_denoising():
    assert np.allclose(wavelets.scaling_filter(4)[:3], [0.23037781, 0.71484657, 0.63088077])
    t = np.arange(4096) / 4096
    clean = np.sin(2 * np.pi * 3 * t)[None]
    noisy = clean + 0.2 * RNG.normal(size=clean.shape)
    for mode in ("soft", "hard"):
        assert ((wavelets.denoised(noisy, mode=mode) - clean) ** 2).mean() < 0.25 * ((noisy - clean) ** 2).mean()
    # by hand: one level of two details under and over the threshold
    x = np.array([[4.0, 0.0, 1.0, 1.0, 2.0, 2.1]])
    low, d = wavelets.analyse(x, wavelets.scaling_filter(1))
    limit = np.median(np.abs(d)) / 0.6745 * np.sqrt(2 * np.log(6))
    cut = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
    assert np.allclose(wavelets.denoised(x, 1, 1), wavelets.synthesise(low, cut, wavelets.scaling_filter(1), 6))


@pytest.mark.parametrize("order,low,high,rate", [(4, 700, 2000, 16000), (4, 85, 255, 16000), (2, 0.2, 0.5, 62.5), (3, 100, 3900, 8000)])
def test_band_pass(order, low, high, rate):
    d = filters.band_pass(order, low, high, rate)
    assert d.shape == (order, 5) and all(abs(np.roots([1, a1, a2])).max() < 1 for *_, a1, a2 in d)

    def gain(f):
        z = np.exp(2j * np.pi * f / rate)
        return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in d]))

    assert all(abs(20 * np.log10(gain(f)) + 10 * np.log10(2)) < 1e-6 for f in (low, high))
    with pytest.raises(ValueError):
        filters.band_pass(order, rate, 2 * rate, rate)


def test_zero_phase():
    d, t = filters.band_pass(4, 700, 2000, 16000), np.arange(8000) / 16000
    for f, db in ((700, -6.0206), (1200, 0.0), (2000, -6.0206)):
        x = np.sin(2 * np.pi * f * t)[None]
        y, x = filters.zero_phase(x, d)[0, 2000:6000], x[0, 2000:6000]
        assert abs(20 * np.log10(y.std() / x.std()) - db) < 0.01 and y @ x / np.sqrt((y @ y) * (x @ x)) > 1 - 1e-9
    assert filters.zero_phase(np.ones((2, 1)), d).shape == (2, 1) and np.abs(filters.zero_phase(np.ones((1, 300)), d)).max() < 1e-9


def test_filters_through_spectra(monkeypatch):
    x = RNG.normal(size=(3, 700)) + 1
    for d in (filters.band_pass(4, 85, 255, 16000), filters.low_pass(3, 900, 16000), filters.high_pass(2, 50, 16000)):
        assert np.allclose(filters.filtered(x, d), filters.section_filter(x, d), atol=1e-10)
        own = filters.zero_phase(x, d)
        monkeypatch.setattr(filters, "LONGEST_TAIL", 0)
        assert np.allclose(filters.zero_phase(x, d), own, atol=1e-9)
        monkeypatch.undo()


def test_breathing_rate():
    """A loudness that swells 15 times a minute breathes at that rate."""
    rate, t = 400, np.arange(400 * 60) / 400
    x = (1 + 0.5 * np.sin(2 * np.pi * 0.25 * t)) * np.sin(2 * np.pi * 50 * t)
    envelope = filters.loudness_envelope(x[None], 80, 40)
    at = batches.peaks(filters.zero_phase(envelope, filters.band_pass(2, 0.2, 0.5, 10.0))[0], distance=20)
    assert abs(np.diff(at[1:-1]).mean() - 40) < 1


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 3, 0, 1])
    assert batches.peaks(x).tolist() == [1, 4, 7, 9] and batches.peaks(x, 2).tolist() == [4, 7, 9]
    assert batches.peaks(x, distance=3).tolist() == [1, 4, 9] and batches.peaks(x, distance=4).tolist() == [4, 9]
    assert batches.peaks(np.zeros(5)).tolist() == batches.peaks(np.zeros(0)).tolist() == []


def test_pitch_of_tones():
    t, n = pitch.Tracker(16000, 1024, 256), np.arange(8000)
    x = np.stack([np.sin(2 * np.pi * f * n / 16000) + 0.3 * np.sin(4 * np.pi * f * n / 16000) for f in (110, 220.0, 445.0)])
    x[:, 4000:] = 1e-3 * RNG.normal(size=(3, 4000))
    found = pitch.tracks(x, t)
    for f, f0, voiced in zip((110, 220, 445), found["f0"], found["voiced"], strict=True):
        assert all(abs(v / f - 1) < 0.004 for v in f0[2:14]) and not voiced[20:].any() and f0[25] is None
    assert pitch.tracks(np.zeros((1, 4000)), t)["voiced"][0].sum() == 0


@pytest.mark.parametrize("speed", [1.2, 3.0])
def test_best_path_is_brute_force(speed):
    t = pitch.Tracker(100.0, 16, 16, low=100.0, high=130.0, steps=2, octaves_a_second=speed, switch=0.2)
    bins, moves = t.bins, pitch.band(t)
    assert t.reach > 0
    for b in range(bins):  # from each bin the ways to all others sum up to 1
        total = sum(np.exp(moves[b - j + t.reach, j]) for j in range(bins) if abs(b - j) <= t.reach)
        assert abs(total - 1) < 1e-9
    for _ in range(6):
        p = RNG.random((1, 3, bins)) ** 3
        p /= p.sum(axis=2, keepdims=True) * 1.3
        v = p.sum(axis=2)
        seen = np.log(np.concatenate([p[0], np.repeat(((1 - v[0]) / bins)[:, None], bins, axis=1)], axis=1))

        def score(path, seen=seen):
            s = seen[0, path[0]]
            for k in range(1, len(path)):
                i, j = path[k - 1], path[k]
                off = i % bins - j % bins
                if abs(off) > t.reach:
                    return -np.inf
                s += moves[off + t.reach, j % bins] + np.log(1 - t.switch if (i < bins) == (j < bins) else t.switch) + seen[k, j]
            return s

        best = max(itertools.product(range(2 * bins), repeat=3), key=score)
        assert abs(score(tuple(pitch.best_paths(p, v, t)[0])) - score(best)) < 1e-9


def test_threshold_weights():
    _, w = pitch.threshold_weights(100)
    x = np.linspace(0, 1, 100_001)
    density = x * (1 - x) ** 17
    plain = np.add.reduceat(density[:-1], np.arange(0, 100_000, 1000)) / density.sum()
    assert abs(w.sum() - 1) < 1e-12 and np.abs(w - plain).max() < 1e-4


def pulses(rate, f0, open_share, n):
    """A flow that rises and falls as a half sine in the open part of each cycle."""
    phase = (np.arange(n) * f0 / rate) % 1
    return np.where(phase < open_share, np.sin(np.pi * phase / open_share) * phase, 0.0)


def test_closures_and_cycles():
    rate, f0 = 16000, 100
    flow = pulses(rate, f0, 0.6, 3200)
    at = glottal.closures(flow, rate)
    assert abs(np.diff(at[1:-1]).mean() - rate / f0) < 0.5
    # a cycle of a known opening: downward crossing at 40 of 160, peak at 100
    cycle = np.concatenate([np.linspace(1, -1, 80), np.linspace(-1, 3, 21)[1:], np.linspace(3, 0.5, 61)[1:]])[None]
    got = glottal.cycle_measures(cycle, rate)
    opening = int(np.flatnonzero((cycle[0, 1:] <= 0) & (cycle[0, :-1] >= 0))[0]) + 1
    fall = np.diff(cycle[0]).min()
    assert got["oq"][0] == (160 - opening) / 160 and abs(got["naq"][0] - 3 / (-fall * 160 / rate)) < 1e-9
    plain = np.abs(np.fft.rfft(cycle[0] * np.hamming(160)))
    assert abs(got["hrf"][0] - plain[2:6].sum() / plain[1]) < 1e-6
    assert glottal.cycle_measures(np.arange(6.0)[None], rate) == {"naq": [None], "oq": [None], "hrf": [None]}


def test_inverse_filtering_finds_the_tract():
    a = np.real(np.poly([0.97 * np.exp(s * 2j * np.pi * f / 16000) for f in (700, 1800) for s in (1, -1)]))[None]
    x = voice.all_pole(np.where(np.arange(4000) % 160 == 0, 1.0, 0.0)[None], a)
    source, tract = glottal.source_of(x, 16000)
    assert source.shape == x.shape and tract.shape == (1, 21)
    found = glottal.resonances(glottal.burg(x, 4), 16000)[0]
    assert np.abs(found - [700, 1800]).max() < 15
    assert abs(np.diff(glottal.closures(source[0], 16000)[1:-1]).mean() - 160) < 20


def test_refined_closures():
    f0 = np.array([100.0, 100, 0, 100, 0, 0, 100])  # a period is 8 samples of 800 a second
    assert glottal.refined_closures([0, 8, 12, 17, 23, 40, 48, 50], f0, 8, 800.0) == [0, 8, 17, 23]
    assert glottal.refined_closures([3], np.zeros(0), 8, 800.0) == [] and glottal.refined_closures([], f0, 8, 800.0) == []


def test_tube():
    a = glottal.burg(RNG.normal(size=(5, 300)), 16)
    k = glottal.step_down(a)
    assert np.allclose(glottal.step_up(k), a) and np.abs(k).max() < 1
    assert np.allclose(glottal.tube_areas(k) * ((1 - k[:, :1]) / (1 + k[:, :1])), (1 - k) / (1 + k))
    plain = [sorted(f for f in np.angle(z[np.abs(z) < 1]) * 16000 / (2 * np.pi) if f > 0)[:3] for z in map(np.roots, a)]
    assert all(np.allclose(x, y) for x, y in zip(glottal.resonances(a, 16000), plain, strict=True))
    assert glottal.burg(np.zeros((1, 50)), 4).tolist() == [[1, 0, 0, 0, 0]] and np.isfinite(glottal.step_down(np.array([[1.0, 0.5, 1.0]]))).all()


def test_tapers_and_spectrum():
    for n in (5, 64, 257):
        tapers, share = spectra.slepian_tapers(n)
        assert np.allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-10) and (np.diff(share) <= 1e-12).all()
        i = np.arange(n)
        w = min(4 / n, 0.5)
        kernel = 2 * w * np.sinc(2 * w * (i[:, None] - i))
        assert np.allclose([t @ kernel @ t for t in tapers], share, atol=1e-9)
    assert share[0] > 1 - 1e-8
    white = RNG.normal(size=(200, 256))
    p = spectra.multitaper(white, 100.0, 256)
    assert abs(p[:, 5:-5].mean() - 2 / 100) < 1e-3  # one-sided density of unit noise
    long = RNG.normal(size=(1, 500))
    z = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(33), np.arange(500)) / 64) @ (long[0] * spectra.slepian_tapers(500)[0].copy()).T) ** 2
    plain = (z * spectra.slepian_tapers(500)[1]).sum(axis=1) / spectra.slepian_tapers(500)[1].sum() / 10.0
    plain[1:32] *= 2
    assert np.allclose(spectra.multitaper(long, 10.0, 64)[0], plain)


def test_reassignment():
    tone = np.sin(2 * np.pi * 0.125 * np.arange(256))[None]
    e = spectra.reassigned(tone, 64, 8)[0]
    plain = np.abs(np.fft.rfft(batches.framed(tone, 64, 8)[0] * np.hanning(66)[1:-1])) ** 2
    assert abs(e.sum() - plain.sum()) < 1e-6 * plain.sum() and e[4:-4, 8].sum() > 0.999 * e[4:-4].sum()
    click = np.zeros((1, 256))
    click[0, 100] = 1
    assert np.flatnonzero(spectra.reassigned(click, 64, 8)[0].sum(axis=1) > 1e-9).tolist() == [9]
    assert spectra.reassigned(tone[:, :10], 64, 8).shape == (1, 0, 33)


def test_group_delay():
    x = RNG.normal(size=(2, 100))
    got = spectra.group_delay(x, 128)
    for row, out in zip(x, got, strict=True):
        w = np.hamming(100)
        own, steps = np.fft.fft(row * w, 128), np.fft.fft(np.r_[row[0], np.diff(row)] * w, 128)
        ceps = np.fft.ifft(np.log(np.abs(own) + 1e-10))
        ceps[20:108] = 0
        tau = np.real(steps * np.conj(own)) / np.exp(np.fft.fft(ceps).real) ** 2
        bent = np.sign(tau) * np.abs(tau) ** 0.2
        assert np.allclose(out, (bent / np.abs(bent).max() * 0.4)[:65])
    assert spectra.group_delay(np.zeros((1, 8)), 16).tolist() == [[0.0] * 9]


@pytest.mark.parametrize("semitones", [12, -12, 7, -3.5])
def test_pitch_shift(semitones):
    x = np.sin(2 * np.pi * 200 * np.arange(16000) / 16000)[None]
    y = voice.shift_pitch(x, semitones, 2048, 512)
    assert y.shape == x.shape and abs(strongest(y[0, 3000:13000], 16000) / (200 * 2 ** (semitones / 12)) - 1) < 0.003
    assert abs(y[0, 3000:13000].std() / x.std() - 1) < 0.02


def test_stretch_and_resample():
    x = np.sin(2 * np.pi * 200 * np.arange(16000) / 16000)[None]
    y = voice.stretched(x, 1.25, 2048, 512)
    assert y.shape == (1, 12800) and abs(strongest(y[0, 2000:-2000], 16000) - 200) < 1
    z = np.sin(2 * np.pi * 5 * np.arange(100) / 100)[None]
    assert np.allclose(voice.resampled(z, 250), np.sin(2 * np.pi * 5 * np.arange(250) / 250)) and np.allclose(voice.resampled(voice.resampled(z, 250), 100), z)


def test_formant_shift():
    a = np.real(np.poly([0.97 * np.exp(s * 2j * np.pi * f / 16000) for f in (700, 1800) for s in (1, -1)]))[None]
    x = voice.all_pole(np.where(np.arange(16000) % 128 == 0, 1.0, 0.0)[None], a)
    y = voice.shift_formants(x, 1.2, 2048, 512)
    size = 1 / np.abs(np.fft.rfft(glottal.burg(y[:, 4000:12000], 20), 4096))[0]
    at = batches.peaks(size) * 16000 / 4096
    assert y.shape == x.shape and abs(at[0] / 840 - 1) < 0.03 and abs(at[1] / 2160 - 1) < 0.03
    assert abs(strongest(y[0, 4000:12000], 16000, 100, 150) - 125) < 1  # the pitch stays
    turned = np.roots(voice.rotated(a, 1.2)[0])
    assert np.allclose(sorted(np.abs(np.angle(turned)))[::2], 2 * np.pi * np.array([840, 2160]) / 16000) and np.allclose(np.abs(turned), 0.97)


def test_sequences_and_decay():
    for order in rooms.FEEDBACK:
        m = rooms.maximal_sequence(order)
        c = np.fft.irfft(np.abs(np.fft.rfft(m)) ** 2, len(m))
        assert abs(c[0] - len(m)) < 1e-5 and np.abs(c[1:] + 1).max() < 1e-5
    h = RNG.normal(size=(2, 16000)) * 10 ** (-3 * np.arange(16000) / 16000 / 0.3)
    assert all(abs(v - 0.3) < 0.02 for v in rooms.decay_time(h, 16000))
    assert rooms.decay_time(np.zeros((1, 9)), 16000) == [None] and rooms.decay_time(np.ones((1, 9)), 16000) == [None]


def test_room_against_loops(spark):
    """Arrivals of all images by plain loops; the decay is near what was asked for."""
    size, src, mic, wall, rate, most = (5.0, 4.0, 3.0), (1.0, 2.0, 1.5), (4.0, 1.0, 1.2), 0.8, 8000, 5
    row = (1, *size, *src, *mic, wall)
    table = spark.createDataFrame([row], "room int, x double, y double, z double, sx double, sy double, sz double, mx double, my double, mz double, wall double")
    plain = {}
    for n in itertools.product(range(-most, most + 1), repeat=3):
        for p in itertools.product((0, 1), repeat=3):
            k = sum(abs(2 * a - b) for a, b in zip(n, p, strict=True))
            if k <= most:
                d = np.sqrt(sum((2 * a * w + (1 - 2 * b) * s - m) ** 2 for a, b, w, s, m in zip(n, p, size, src, mic, strict=True)))
                plain[round(d / 343 * rate)] = plain.get(round(d / 343 * rate), 0) + wall**k / (4 * np.pi * d)
    h = rooms.room_responses(table, ["room"], rate, most).first()["h"]
    assert {i: v for i, v in enumerate(h) if v} == pytest.approx(plain)
    asked = 0.25
    live = table.withColumn("wall", rooms.reflectance((F.col("x"), F.col("y"), F.col("z")), F.lit(asked)))
    found = rooms.room_responses(live, ["room"], rate, 24).select(rooms.reverberation(rate)(F.col("h")).alias("r")).first()["r"]
    assert abs(found.whole / asked - 1) < 0.35 and found.bands[-1] is None and found.bands[3] is not None


def test_band_reverberation(spark):
    """A band's decay is its own: low notes that ring longer than high ones."""
    t = np.arange(16000) / 16000
    h = np.sin(2 * np.pi * 250 * t) * 10 ** (-3 * t / 0.6) + np.sin(2 * np.pi * 4000 * t) * 10 ** (-3 * t / 0.2)
    rows = spark.createDataFrame([(1, h.tolist()), (2, None), (3, [])], "id int, h array<double>")
    found = {r.id: r.r for r in rows.select("id", rooms.reverberation(16000)(F.col("h")).alias("r")).collect()}
    assert abs(found[1].bands[1] - 0.6) < 0.05 and abs(found[1].bands[5] - 0.2) < 0.03 and found[2] is found[3] is None


def test_interaural(spark):
    x = RNG.normal(size=50)
    rows = [(1, [0.0] * 7 + x.tolist(), x.tolist()), (2, x.tolist(), [float(-2 * v) for v in x]), (3, None, [1.0]), (4, [0.0], [1.0])]
    found = spark.createDataFrame(rows, "id int, l array<double>, r array<double>").select("id", rooms.cross_correlation("l", "r").alias("c")).orderBy("id").collect()
    assert found[0].c.lag == 7 and abs(found[0].c.iacc - 1) < 1e-9 and found[1].c.lag == 0 and abs(found[1].c.iacc - 1) < 1e-9
    assert found[2].c is found[3].c is None


def test_kernels_of_odd_rows(spark):
    """Null, empty, short, bad samples and mixed lengths, in every kernel that has a column form."""
    nan = float("nan")
    rows = [(1, [float(v) for v in RNG.normal(size=64)]), (2, None), (3, []), (4, [1.0]), (5, [0.0] * 64), (6, [1.0, None, nan, 2.0] * 16), (7, [float(v) for v in RNG.normal(size=70)])]
    table = spark.createDataFrame(rows, "id int, x array<double>").repartition(2)
    slow = pitch.Tracker(64.0, length=32, hop=8, low=2.0, high=16.0, steps=5, octaves_a_second=4.0)
    kernels = [
        (wavelets.wavelet_denoise(), {2, 3}), (wavelets.wavelet_level(4), {2, 3}), (filters.speech_bands(16000), {2, 3}), (filters.breathing(4, 4, 2), {2, 3, 4}), (pitch.pitch_track(slow), {2, 3, 4}),
        (glottal.glottal_source(2000), {2, 3, 4}), (glottal.tube_model(16000), {2, 3, 4}), (spectra.multitaper_spectrum(64.0, 64), {2, 3}), (spectra.reassigned_spectrum(16, 4), {2, 3, 4}),
        (spectra.modified_group_delay(64), {2, 3}), (voice.pitch_shift(3, 32, 8), {2, 3}), (voice.formant_shift(1.1, 48, 12), {2, 3}), (voice.time_stretch(1.5, 32, 8), {2, 3}), (rooms.reverberation(8000), {2, 3}),
    ]
    found = table.select("id", *[k(F.col("x")).alias(f"k{i}") for i, (k, _) in enumerate(kernels)]).collect()
    for i, (_, gone) in enumerate(kernels):
        assert {r.id for r in found if r[f"k{i}"] is None} == gone, i
    both = {r.id: r.k0.y for r in found if r.k0}
    assert np.allclose(both[1], wavelets.denoised(np.array([rows[0][1]]))[0]) and len(both[7]) == 70
    assert np.allclose(both[6], wavelets.denoised(np.array([[1.0, 0, 0, 2.0] * 16]))[0])
    measured = {r.id: r for r in glottal.source_measures(table, ["id"], "x", 2000).collect()}
    assert set(measured) == {1, 5, 6, 7} and measured[5].closures == 0 and measured[5].naq == 0.0
    cut = table.select("id", batches.frames(F.col("x"), 16, 4).alias("f")).collect()
    for r in cut:
        x = dict(rows)[r.id]
        assert r.f == (None if x is None else [x[k : k + 16] for k in range(0, len(x) - 15, 4)]) or r.id == 6
