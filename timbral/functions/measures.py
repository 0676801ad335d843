"""Modulations, stress, loudness and tracks of recordings, and what cuts and points at them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.functions.batches import KINDS, framed, on_signals, peaks
from timbral.functions.spectra import centred


def modulation_stats(x: np.ndarray, length: int, hop: int) -> dict[str, np.ndarray]:
    """Mean and deviation of the two-dimensional spectrum of log magnitudes, between its constant
    parts and a quarter of either side, and its centres along both; zeros where that part is empty."""
    size = np.abs(centred(x, length, hop)).swapaxes(1, 2)
    spectrum = np.abs(np.fft.fft2(np.log(size + 1e-10)))[:, 1 : length // 4, 1 : size.shape[2] // 4]
    if not spectrum.size:
        return dict.fromkeys(("mean", "deviation", "spectral_centre", "temporal_centre"), np.zeros(len(x)))
    total = spectrum.sum(axis=(1, 2)) + 1e-10
    along = lambda axis: (spectrum.sum(axis=axis) * np.arange(spectrum.shape[3 - axis])).sum(axis=1) / total
    return {"mean": spectrum.mean(axis=(1, 2)), "deviation": spectrum.std(axis=(1, 2)), "spectral_centre": along(2), "temporal_centre": along(1)}


def modulation_features(length: int = 2048, hop: int = 512):
    """G35 as a column function: struct(mean, deviation, spectral_centre, temporal_centre)."""
    return on_signals(lambda x: modulation_stats(x, length, hop), mean="double", deviation="double", spectral_centre="double", temporal_centre="double")


def stress_of(envelope: np.ndarray, height: float = 0.1, distance: int = 10) -> tuple[int, float, float, float]:
    """G39 on one envelope of peak 1: its peaks, their mean, and the relative deviations of peaks and of
    their distances; zeros without peaks."""
    at = peaks(envelope, height, distance)
    if not len(at):
        return 0, 0.0, 0.0, 0.0
    own, gaps = envelope[at], np.diff(at)
    return len(at), float(own.mean()), float(own.std() / own.mean()), float(gaps.std() / gaps.mean()) if len(gaps) else 0.0


def stress_pattern(length: int = 2048, hop: int = 512, bands: int = 5, height: float = 0.1, distance: int = 10):
    """G39 as a column function: struct(n, mean, variability, interval_variability, shares): shares are
    the mean parts of `bands` equal bands in each frame's magnitudes."""

    def work(x: np.ndarray) -> dict:
        size = np.abs(centred(x, length, hop))
        edges = [int(i * size.shape[2] / bands) for i in range(bands + 1)]
        parts = np.stack([size[:, :, a:b].sum(axis=2) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=2)
        envelope = size.sum(axis=2)
        top = envelope.max(axis=1, keepdims=True)
        found = [stress_of(e, height, distance) for e in envelope / np.where(top > 0, top, 1)]
        columns = dict(zip(("n", "mean", "variability", "interval_variability"), zip(*found, strict=True), strict=True))
        return columns | {"shares": (parts / (parts.sum(axis=2, keepdims=True) + 1e-10)).mean(axis=1)}

    return on_signals(work, n="long", mean="double", variability="double", interval_variability="double", shares="doubles")


def a_weight(f: np.ndarray) -> np.ndarray:
    """The A-weighting of frequencies in Hz, 1 at 1,000 Hz."""
    # fixed values: the curve's corner frequencies
    a, b, c, d = (v**2 for v in (20.598997, 107.65265, 737.86223, 12194.217))
    curve = lambda q: d * q**2 / ((q + a) * np.sqrt((q + b) * (q + c)) * (q + d))
    return curve(np.asarray(f, float) ** 2) / curve(1e6)


def level_a(x: np.ndarray, rate: float, low: float = 20.0, high: float = 20000.0) -> np.ndarray:
    """The A-weighted equivalent level in dB over 20 micropascal of signals in pascal, from their
    spectra between `low` and `high`; silence is at -200 dB."""
    n = x.shape[1]
    z = np.fft.rfft(x)
    f = np.fft.rfftfreq(n, 1 / rate)
    weight = np.where((f >= low) & (f <= high), a_weight(f), 0)
    twice = np.where((np.arange(len(f)) == 0) | ((n % 2 == 0) & (np.arange(len(f)) == len(f) - 1)), 1, 2)
    power = (np.abs(z * weight) ** 2 * twice).sum(axis=1) / n**2
    return 10 * np.log10(np.maximum(power / (2e-5) ** 2, 1e-20))


def welch(x: np.ndarray, rate: float, length: int) -> np.ndarray:
    """Power a Hz: periodograms of Hann-windowed halves-overlapping segments less their means, averaged,
    one-sided. A signal shorter than a segment is one."""
    length = min(length, x.shape[1])
    window = np.hanning(length + 1)[:-1] if length > 1 else np.ones(1)
    f = framed(x, length, max(1, length // 2))
    f = (f - f.mean(axis=2, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(f)) ** 2).mean(axis=1) / (rate * (window**2).sum())
    power[:, 1 : (length + 1) // 2] *= 2
    return power


def background_level(rate: float, length: int = 8192):
    """G45 as a column function: struct(level, spectrum)."""
    return on_signals(lambda x: {"level": level_a(x, rate), "spectrum": welch(x, rate, length)}, level="double", spectrum="doubles")


def corrected(track: np.ndarray) -> np.ndarray:
    """Pitch tracks (rows; 0 or not a number where unvoiced) by a median of five, zeros outside,
    then octave jumps: a value 1.8 to 2.2 times the one before, as corrected, is halved, and one
    0.45 to 0.55 times it is doubled."""
    y = np.median(framed(np.pad(np.nan_to_num(track), ((0, 0), (2, 2))), 5, 1), axis=2)
    for i in range(1, y.shape[1]):
        before = y[:, i - 1]
        ratio = np.where((before > 0) & (y[:, i] > 0), y[:, i] / np.where(before > 0, before, 1), 1)
        y[:, i] = np.where((ratio > 1.8) & (ratio < 2.2), y[:, i] / 2, np.where((ratio > 0.45) & (ratio < 0.55), y[:, i] * 2, y[:, i]))
    return y


def octave_corrected():
    """W12 as a column function: struct(f0)."""
    return on_signals(lambda x: {"f0": corrected(x)}, f0="doubles")


def loud_spans(x: np.ndarray, top_db: float, length: int, hop: int) -> list[list[tuple[int, int]]]:
    """Spans of samples, from frames (centred, zeros outside) whose root mean square is within top_db of
    the loudest; a silent signal has none."""
    n = x.shape[1]
    rms = np.sqrt((framed(np.pad(x, ((0, 0), (length // 2, length // 2))), length, hop) ** 2).mean(axis=2))
    top = rms.max(axis=1, keepdims=True)
    loud = (rms > top * 10 ** (-top_db / 20)) & (top > 0)
    edge = np.diff(np.pad(loud.astype(int), ((0, 0), (1, 1))), axis=1)
    spans = lambda e: zip((np.flatnonzero(e == 1) * hop).tolist(), (np.flatnonzero(e == -1) * hop).tolist(), strict=True)
    return [[(a, min(b, n)) for a, b in spans(e) if a < n] for e in edge]


def trimmed(rate: float, top_db: float = 20.0, pad_ms: float = 100.0, length: int = 1024, hop: int = 256):
    """N01 as a column function: struct(y, start): the signal from its first to its last loud frame, and
    pad_ms more on both sides where both fit into the signal; a silent one is empty."""
    pad = int(pad_ms * rate / 1000)

    def work(x: np.ndarray) -> dict:
        out, starts = [], []
        for row, spans in zip(x, loud_spans(x, top_db, length, hop), strict=True):
            a, b = (spans[0][0], spans[-1][1]) if spans else (0, 0)
            if spans and b - a + 2 * pad <= len(row):
                a, b = max(0, a - pad), min(len(row), b + pad)
            out.append(row[a:b])
            starts.append(a)
        return {"y": out, "start": starts}

    return on_signals(work, y="doubles", start="long")


def phrases(rate: float, top_db: float = 30.0, least_s: float = 1.0, length: int = 1024, hop: int = 256):
    """N02, W06b as a column function: struct(starts, ends) of spans of loud frames that last least_s."""

    def work(x: np.ndarray) -> dict:
        kept = [[s for s in spans if s[1] - s[0] >= int(least_s * rate)] for spans in loud_spans(x, top_db, length, hop)]
        return {"starts": [[a for a, _ in s] for s in kept], "ends": [[b for _, b in s] for s in kept]}

    return on_signals(work, starts="longs", ends="longs")


def beam_weights(channels: int, azimuth: float) -> np.ndarray:
    """F32: turns of the channels of a ring towards an azimuth (radians), half a turn at most."""
    around = np.arange(channels) * 2 * np.pi / channels
    return np.exp(2j * np.pi * 0.5 * np.cos(around - azimuth))


def beamformed(channels: int, azimuth: float):
    """A column function of an array of `channels` signals: their spectra, turned by the weights and
    added up, back in time. Null where a signal is missing, or their lengths differ."""
    weights = beam_weights(channels, azimuth)[:, None]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(signals: pa.Array) -> pa.Array:
        out = []
        for row in signals.to_pylist():
            whole = row is not None and len(row) == channels and all(s is not None and len(s) == len(row[0]) for s in row) and len(row[0])
            out.append(np.fft.irfft((np.fft.rfft(np.nan_to_num(np.array(row, float))) * weights).sum(axis=0), len(row[0])) if whole else None)
        return pa.array(out, KINDS["doubles"][1])

    return run


def transitions(tracks: DataFrame, keys: list[str], name: str, frame: str, value: str) -> DataFrame:
    """(keys, name, speed, acceleration): mean sizes of first and second steps of each track; tracks
    of one value have null speeds, of two null accelerations."""
    by = Window.partitionBy(*keys, name).orderBy(frame)
    rows = tracks.withColumn("__v", F.col(value) - F.lag(value).over(by)).withColumn("__a", F.col("__v") - F.lag("__v").over(by))
    return rows.groupBy(*keys, name).agg(F.avg(F.abs("__v")).alias("speed"), F.avg(F.abs("__a")).alias("acceleration"))


def weighted_sum(vectors: list[Column], weights: list[Column]) -> Column:
    """Vectors fused by weights that come with the row; not scaled to sum 1."""
    scaled = lambda v, w: F.transform(v, lambda x: x * w)
    parts = [scaled(v, w) for v, w in zip(vectors, weights, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out
