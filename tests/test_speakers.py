"""Normalization, rhythm, covariances, challenges and fingerprints against closed forms and loops."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import normalization, rhythm, signal, spectra
from timbral.functions.batches import framed
from timbral.operators import challenges, evaluation, fingerprint, gaussian, learning

RNG = np.random.default_rng(11)


def test_transforms_come_back():
    x = RNG.normal(size=(2, 1000))
    assert np.allclose(spectra.restored(spectra.centred(x, 64, 16), 64, 16, 1000), x, atol=1e-6)
    t = np.arange(1000) / 1000
    envelope = spectra.analytic_envelope((1 + 0.5 * np.cos(2 * np.pi * 3 * t) * np.ones((1, 1000))) * np.cos(2 * np.pi * 100 * t))
    assert np.abs(envelope[0] - (1 + 0.5 * np.cos(2 * np.pi * 3 * t))).max() < 1e-9
    assert np.allclose(spectra.analytic_envelope(np.cos(2 * np.pi * np.arange(7) / 7)[None]), 1)


def test_equalizer_flattens():
    """Noise through a filter that falls by 20 dB comes out flatter; a target is approached."""
    white = RNG.normal(size=(1, 40_000))
    low = np.cumsum(white, axis=1)
    low = low - np.apply_along_axis(lambda v: np.convolve(v, np.ones(200) / 200, "same"), 1, low)
    tilt = lambda v: np.ptp(10 * np.log10((np.abs(spectra.centred(v, 2048, 512)) ** 2).mean(axis=1)[0, 60:900].reshape(-1, 40).mean(axis=1)))
    y = normalization.equalized(low)
    assert y.shape == low.shape and tilt(y) < 0.5 * tilt(low) and np.allclose(normalization.equalized(np.zeros((1, 100))), 0)


def test_phase_and_chain():
    """A mean group delay of every frame is taken off: a click late in each frame moves, magnitudes stay."""
    x = RNG.normal(size=(1, 8000))
    z = spectra.centred(x, 256, 64)
    phase = np.unwrap(np.angle(z), axis=2)
    correction = np.zeros(z.shape[2])
    for b in range(1, z.shape[2]):  # sums of the mean steps, by loops
        correction[b] = correction[b - 1] + np.mean([phase[0, k, b] - phase[0, k, b - 1] for k in range(z.shape[1])])
    plain = spectra.restored(z * np.exp(-1j * correction), 256, 64, 8000)
    assert np.allclose(normalization.phase_normalized(x, 256, 64), plain)
    short = RNG.normal(size=(1, 100))
    assert np.array_equal(normalization.modulation_normalized(short, 16000), short)


def test_modulation_gain():
    """One signal by itself, by plain convolutions; strong modulations are held back, weak ones raised."""
    rate, t = 8000, np.arange(8000 * 6) / 8000
    x = (1 + 0.5 * np.sin(2 * np.pi * 6 * t) + 0.05 * np.sin(2 * np.pi * 20 * t)) * np.sin(2 * np.pi * 500 * t)
    y = normalization.modulation_normalized(np.stack([x, -x]), rate)
    envelope = spectra.analytic_envelope(x[None])[0]
    slow = np.pad(envelope[::40], (0, 0))
    z = spectra.centred(slow[None], 512, 128)[0]
    f = np.fft.rfftfreq(512, 1 / 200)
    gain = np.clip(np.convolve(np.where((f >= 4) & (f <= 8), 2.0, 1.0) / (np.abs(z).mean(axis=0) + 1e-10), np.ones(5) / 5, "same"), 0.2, 5)
    new = spectra.restored((z * gain)[None], 512, 128, len(slow))[0]
    plain = x * np.interp(np.arange(len(x)) / 40, np.arange(len(new)), new) / (envelope + 1e-10)
    assert np.allclose(y[0], plain) and np.allclose(y[1], -plain) and gain.min() == 0.2 and gain.max() > 1


def test_windowed_norm_and_cepstra():
    c = RNG.normal(size=(2, 30, 3)) + 100
    got = normalization.windowed_norm(c, 10)
    for i in range(30):
        near = c[:, max(0, i - 5) : min(30, i + 5)]
        assert np.allclose(got[:, i], (c[:, i] - near.mean(axis=1)) / (near.std(axis=1) + 1e-10), atol=1e-6)
    whole = normalization.windowed_norm(c, None)
    assert np.allclose(whole.mean(axis=1), 0, atol=1e-8) and np.allclose(whole.std(axis=1), 1, atol=1e-6)
    x = RNG.normal(size=(1, 2000))
    _, k, basis = normalization.cepstra(x, 16000, 128, 32, 20, 20)
    mel = 10 ** (k @ basis / 10)  # all coefficients of all bands: nothing is lost
    assert np.allclose(mel, np.maximum(np.abs(spectra.centred(x, 128, 32)) ** 2 @ signal.mel_filters(16000, 128, 20).T, 1e-10))
    y = normalization.cepstral_normalized(x, 16000, 128, 32, 20, 13, 0.05)
    assert y.shape == x.shape and np.isfinite(y).all()


def test_flattening():
    """The residual of an all-pole signal is flatter than it, of its energy."""
    x = np.zeros((1, 8000))
    e = RNG.normal(size=8000)
    for i in range(2, 8000):
        x[0, i] = e[i] + 1.6 * x[0, i - 1] - 0.81 * x[0, i - 2]
    y = normalization.flattened(x, 16000)
    flat = lambda v: np.exp(np.log(np.abs(np.fft.rfft(v)) ** 2 + 1e-12).mean()) / (np.abs(np.fft.rfft(v)) ** 2).mean()
    assert flat(y[0, 500:7500]) > 5 * flat(x[0, 500:7500]) and abs((y**2).sum() / (x**2).sum() - 1) < 1e-6
    assert not normalization.flattened(x[:, :100], 16000).any()
    frame = RNG.normal(size=(3, 50))
    a = signal.levinson(frame, 4)
    for row, own in zip(a, frame, strict=True):
        r = [own[: 50 - k] @ own[k:] for k in range(5)]
        solved = np.linalg.solve([[r[abs(i - j)] for j in range(4)] for i in range(4)], [-r[i + 1] for i in range(4)])
        assert np.allclose(row[1:], solved, atol=1e-6)


def test_contrast_masking_and_power_cepstra(spark):
    m = RNG.random((2, 257))
    got = spectra.octave_contrast(m, 16000)
    f = np.linspace(0, 8000, 257)
    for k, (low, high) in enumerate([(0, 200), (200, 400), (400, 800), (800, 1600), (1600, 3200), (3200, 6400), (6400, 1e9)]):
        own = np.sort(m[:, (f >= low) & (f < high)], axis=1)
        n = max(1, round(0.02 * own.shape[1]))
        assert np.allclose(got[:, k], 20 * np.log10(own[:, -n:].mean(axis=1) / own[:, :n].mean(axis=1)))
    z = spectra.bark(np.arange(9) * 1000.0)
    mag = RNG.random(9).tolist()
    found = spark.createDataFrame([(mag,)], "m array<double>").select(spectra.masking(16000, 16)(F.col("m"))["threshold"].alias("t")).first()["t"]
    assert np.allclose(found, [0.1 * sum(mag[j] * max(0, 1 - abs(z[i] - z[j]) / 0.5) for j in range(9)) for i in range(9)])
    x, filters = RNG.normal(size=(1, 600)), signal.mel_filters(16000, 64, 8)
    power = np.abs(spectra.centred(x, 64, 16))[0] ** 2 @ filters.T
    n, floor, out = len(power), None, []
    for k in range(n):
        now = np.mean([power[min(max(k + d, 0), n - 1)] for d in range(-2, 3)], axis=0)
        floor = now if floor is None else np.where(now >= floor, 0.999 * floor + 0.001 * now, 0.5 * floor + 0.5 * now)
        root = np.maximum(now - floor, 0) ** (1 / 15)
        out.append([(root * np.cos(np.pi * c * (2 * np.arange(8) + 1) / 16)).sum() * np.sqrt((1 if c == 0 else 2) / 8) for c in range(5)])
    assert np.allclose(spectra.power_cepstra(x, filters, 64, 16, 5)[0], out)


def test_rates():
    rate, t = 8000, np.arange(8000 * 8) / 8000
    for f in (4.0, 6.5):
        x = (1 + np.sin(2 * np.pi * f * t)) * np.sin(2 * np.pi * 400 * t)
        assert abs(rhythm.syllable_rate(x[None], rate)[0] - 60 * f) < 60 * 100 / 1024
    rows = RNG.normal(size=(1, 40))
    kernel = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
    mirrored = np.concatenate([rows[0, 7::-1], rows[0], rows[0, :-9:-1]])
    assert np.allclose(rhythm.gaussian_smooth(rows, 2.0)[0], np.convolve(mirrored, kernel / kernel.sum(), "valid"))


def test_onsets():
    """A quiet burst, then voice 20 ms later: one time of about that."""
    envelope = np.concatenate([np.zeros(20), np.full(20, 0.25), np.full(60, 1.0), np.zeros(200)])
    bursts, times = rhythm.onset_times(envelope, 1.0, 30)
    assert bursts == [20, 40] and times == [20.0]
    assert rhythm.onset_times(np.zeros(9), 1.0, 5) == ([], []) and rhythm.onset_times(envelope, 0.1, 30)[1] == []


def test_modulations():
    x = RNG.normal(size=(1, 400))
    got = rhythm.modulations(x, 64.0, 16, 4)
    z = spectra.centred(x, 16, 4)[0]
    size = np.abs(z)
    rise = [0.0] + [np.maximum(20 * np.log10(size[k] / size[k - 1]), 0).mean() for k in range(1, len(z))]
    smooth = np.convolve(rise, np.ones(5) / 5, "same")
    env = np.sqrt((size**2).sum(axis=1))
    spec, f = np.abs(np.fft.rfft(env)), np.fft.rfftfreq(len(env), 4 / 64.0)
    assert got["flux"][0] == pytest.approx(np.mean(rise)) and got["residual"][0] == pytest.approx((np.array(rise) - smooth).std())
    assert got["envelope"][0] == pytest.approx(np.append(np.diff(env), 0).std() / env.mean()) and got["tremor"][0] == pytest.approx(spec[(f >= 4) & (f <= 8)].sum() / spec.sum())


def test_moments_and_distances(spark):
    x = RNG.normal(size=(60, 5)) @ RNG.normal(size=(5, 5)) + 1e4
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(60)]
    odd = [(100, 0, None), (101, 1, [1.0]), (102, 1, [1.0, None, 1.0, 1.0, 1.0]), (103, 7, [1.0] * 5), (104, None, [2.0] * 5), (105, None, [3.0] * 5)]
    table = spark.createDataFrame(rows + odd, "id long, label int, v array<double>").repartition(4)
    stats = gaussian.moments(table, "label", "v", 5)
    found = {r.label: r for r in stats.collect()}
    assert set(found) == {0, 1, 2, 7, None} and found[7].cov is None and found[None].n == 2
    for g in range(3):
        own = x[np.arange(60) % 3 == g]
        assert found[g].n == 20 and np.allclose(found[g].mean, own.mean(axis=0)) and np.allclose(found[g].cov, np.cov(own.T).ravel())
    first, rest = (gaussian.moments(table.where(c), "label", "v", 5) for c in ("id < 31", "id >= 31"))
    both = {r.label: r for r in gaussian.merged(first, rest, "label").collect()}
    assert all(np.allclose(both[g].cov, found[g].cov) and np.allclose(both[g].mean, found[g].mean) and both[g].n == 20 for g in range(3)) and both[7].n == 1
    near = {r.id: r for r in gaussian.against_groups(table.where("size(v) = 5 and not exists(v, x -> x is null)"), stats, "label", "v", 5).collect()}
    for i in range(60):
        own = x[np.arange(60) % 3 == i % 3]
        cov, d = np.cov(own.T), x[i] - own.mean(axis=0)
        q = d @ np.linalg.solve(cov, d)
        assert near[i].distance == pytest.approx(np.sqrt(q), rel=1e-5) and near[i].log_pdf == pytest.approx(-0.5 * (q + np.linalg.slogdet(cov)[1] + 5 * np.log(2 * np.pi)), rel=1e-5)
    assert near[103].distance == 0 and np.isfinite(near[103].log_pdf)  # a singular covariance: its raised diagonal


def drawn(spark, difficulty, n=3000):
    at = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([(f"s{i}", difficulty, at) for i in range(n)], "session string, level string, at timestamp")
    return challenges.issue(table, "session", "level", "at", "secret")


@pytest.mark.parametrize("difficulty", ["easy", "medium", "hard"])
def test_challenges(spark, difficulty):
    rows = drawn(spark, difficulty).collect()
    kinds = Counter(r.challenge_type for r in rows)
    assert set(kinds) == set(challenges.TYPES) and min(kinds.values()) > 600
    many = {"easy": ({4, 5, 6}, {5, 6, 7}), "medium": ({5, 6, 7, 8, 9}, {6, 7}), "hard": ({10}, {8})}[difficulty]
    seen, signs = (set(), set()), Counter()
    for r in rows:
        if r.challenge_type == "digit_sequence":
            unique = r.challenge_text.startswith("Speak")
            shown = r.challenge_text.split(": ")[1].split(" ")
            assert "".join(shown) == r.expected_response and r.expected_response.isdigit()
            assert all(len(p) == 3 for p in shown[:-1]) if len(r.expected_response) > 5 else all(len(p) == 1 for p in shown)
            assert not unique or len(set(r.expected_response)) == len(r.expected_response)
            seen[unique].add(len(r.expected_response))
        elif r.challenge_type == "arithmetic":
            a, sign, b, _, _ = r.challenge_display.split(" ")
            signs[sign] += 1
            assert int(r.expected_response) == {"+": int(a) + int(b), "-": int(a) - int(b), "×": int(a) * int(b)}[sign] >= 0
            low, high = {("easy", "+"): (1, 9), ("medium", "+"): (10, 50), ("hard", "+"): (10, 99), ("medium", "×"): (2, 9), ("hard", "×"): (5, 15), ("hard", "-"): (10, 99)}[(difficulty, sign)]
            assert low <= int(a) <= high and low <= int(b) <= high
        else:
            assert f"'{r.expected_response}'" in r.challenge_text and r.expected_response in challenges.PHRASES + challenges.PROMPTS
        assert r.expires_at - r.created_at == dt.timedelta(seconds=120)
    assert seen == many and len(signs) == {"easy": 1, "medium": 2, "hard": 3}[difficulty]
    assert "expected_response" not in challenges.for_user(drawn(spark, difficulty, 1)).columns
    again = drawn(spark, difficulty).repartition(3).collect()
    assert {r.session: r.challenge_text for r in again} == {r.session: r.challenge_text for r in rows}


def test_responses(spark):
    at = dt.datetime(2024, 1, 1)
    issued = spark.createDataFrame([("a", "hello big world", at, "easy"), ("b", "1234567890", at, "hard")], "session string, expected_response string, expires_at timestamp, level string")
    said = [("a", "Hello, BIG world!", at), ("a", "hello big worm", at), ("a", None, at), ("b", "123456789", at), ("b", "1234567890", at + dt.timedelta(seconds=1)), ("c", "x", at)]
    found = challenges.judge(spark.createDataFrame(said, "session string, said string, at timestamp"), issued, "session", "said", "at", "level").collect()
    by = {(r.session, r.said): r for r in found}
    assert by[("a", "Hello, BIG world!")].similarity == 1.0 and by[("a", "Hello, BIG world!")].verified and by[("a", "hello big worm")].verified
    assert not by[("a", None)].verified and by[("a", None)].similarity == 0.0 and by[("b", "123456789")].verified
    assert by[("b", "1234567890")].error == "Challenge expired" and by[("c", "x")].error == "Invalid session ID" and by[("c", "x")].verified is False


def test_scripts(spark):
    rows = [("digits", 1, None), ("digits", 9, None), ("emotional", None, "sad"), ("emotional", 0, "bored"), ("other", 2, None), (None, None, None)]
    table = spark.createDataFrame(rows, "family string, i int, emotion string")
    got = [r[0] for r in table.select(challenges.script(F.col("family"), F.col("i"), F.col("emotion"), F.lit("s"))).collect()]
    base, digits = challenges.SCRIPTS["phonetic_balanced"], challenges.SCRIPTS["digits"]
    assert got[0] == digits[1] and got[1] in digits and got[2] == challenges.EMOTIONS["sad"] and got[3] == base[0] and got[4] == base[2] and got[5] in base


def test_class_metrics_of_odd_rows(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d"), (None, "a"), ("a", None)]
    found = {r["class"]: (r.n, r.precision, r.recall, r.f1) for r in evaluation.class_metrics(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert found == {"a": (2, 1.0, 0.5, pytest.approx(2 / 3)), "b": (1, 0.5, 1.0, pytest.approx(2 / 3)), "c": (1, 0.0, 0.0, 0.0), "d": (0, 0.0, 0.0, 0.0)}


def test_server_and_secure_mean(spark):
    rows = [(0, 1, 1.0, 1.0), (0, 2, 3.0, 3.0), (0, 2, 3.0, 0.0), (1, 1, 5.0, 1.0), (1, 1, 5.0, 1.0), (2, 3, None, 1.0), (2, 4, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "place int, client int, v double, w double")
    assert [tuple(r) for r in learning.secure_mean(table, ["place"], "client", "v", "w", 4).collect()] == [(0, 2.5, 2)]
    state = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, None)], "place int, value double, speed double")
    means = spark.createDataFrame([(0, 3.0), (5, 7.0)], "place int, mean double")
    found = {r.place: (r.value, r.speed) for r in learning.server_step(state, means, ["place"], 0.5, 0.9).collect()}
    assert found == {0: (1 + 1.45, 1.45), 1: (2.0, 0.0), 5: (7.0, 0.0)}


@pytest.mark.parametrize("method", ["uncertainty", "random", "diversity", "hybrid"])
def test_selection(spark, method):
    rows = spark.createDataFrame([(i, float(i % 10), [float(i % 4), float(i % 7)]) for i in range(40)], "id long, u double, v array<double>")
    got = [r.id for r in learning.select_samples(rows, "id", "u", "v", 4, method).collect()]
    assert len(got) == len(set(got)) == 4 and (method != "uncertainty" or got == [9, 19, 29, 39]) and (method != "hybrid" or all(i % 10 >= 8 for i in got))
    with pytest.raises(ValueError):
        learning.select_samples(rows, "id", "u", "v", 4, "other")


def test_fingerprints(spark):
    table = spark.createDataFrame([(i, [float(v) for v in RNG.normal(size=80 + i)]) for i in range(12)], "id long, x array<double>")
    rows = fingerprint.tracks(table, ["id"], "x", 16000, 32, 8, 64, bands=24)
    own = rows.where("id = 3").collect()
    x = np.array(table.where("id = 3").first().x)
    mag = np.abs(np.fft.rfft(framed(x[None], 32, 8)[0] * np.hanning(33)[:-1], 64))
    centroid = {r.frame: r.value for r in own if r.name == "centroid"}
    assert all(centroid[k] == pytest.approx((m * np.arange(33) * 250).sum() / m.sum()) for k, m in enumerate(mag))
    found = fingerprint.features(rows, ["id"])
    stats = {r.feature: r.value for r in found.where("id = 3").collect()}
    track = np.array([r.value for r in sorted(own, key=lambda r: r.frame) if r.name == "mfcc2"])
    speed = np.r_[0, np.diff(track)]
    want = {"mean": track.mean(), "std": track.std(), "velocity_mean": speed.mean(), "velocity_std": speed.std(), "acceleration_std": np.r_[0, np.diff(speed)].std()}
    assert all(stats[f"mfcc2_{k}"] == pytest.approx(v) for k, v in want.items())
    formants = {(r.frame, r.name): r.value for r in own if r.name.startswith("formant")}
    assert stats["formant1_ratio"] == pytest.approx(np.mean([v / formants[(f, "formant0")] for (f, n), v in formants.items() if n == "formant1"]))
    ready = fingerprint.vectors(found, ["id"])
    matrix = np.array([r.features for r in ready.orderBy("id").collect()])
    assert matrix.shape == (12, len(fingerprint.feature_names())) and len(set(fingerprint.feature_names())) == matrix.shape[1] == 150
    got = np.array([r.fingerprint for r in fingerprint.reduced(ready, fingerprint.fit(ready, 3)).orderBy("id").collect()])
    sd = matrix.std(axis=0, ddof=1)
    scaled = np.where(sd > 0, (matrix - matrix.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    _, _, v = np.linalg.svd(scaled - scaled.mean(axis=0))
    assert np.allclose(np.abs(got), np.abs(scaled @ v[:3].T), atol=1e-6)
