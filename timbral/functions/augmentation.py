"""Augmented copies of waveforms. Random choices come from a hash of the row, so reruns agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbral.functions import vectors as V
from timbral.functions.signal import DOUBLES, _per_frame

#: Pass bands in Hz of device and codec simulations.
BANDS = {"telephone": (300.0, 3400.0), "smartphone": (100.0, 8000.0), "laptop": (150.0, 7000.0), "gsm": (200.0, 3400.0), "voip": (50.0, 7000.0)}
#: Exponents of the power spectrum of coloured noise.
COLOURS = {"white": 0.0, "pink": -1.0, "brown": -2.0, "blue": 1.0}


def seed_of(*parts: Column | str) -> Column:
    """A row's seed from its id, the operation's name and a number."""
    return F.xxhash64(*parts)


def snr_scale(signal: Column, noise: Column, snr_db: float) -> Column:
    """What noise is multiplied by for a signal-to-noise ratio; 0 for silent noise."""
    power = lambda a: V.dot(a, a) / F.size(a)
    return F.coalesce(F.sqrt(F.try_divide(power(signal), power(noise) * 10 ** (snr_db / 10))), F.lit(0.0))


def add_noise(signal: Column, noise: Column, snr_db: float) -> Column:
    """The signal plus noise of the same length at snr_db."""
    return V.let(snr_scale(signal, noise, snr_db), lambda s: F.zip_with(signal, noise, lambda x, n: x + s * n))


def coloured_noise(colour: str):
    """Noise with a power spectrum of f to COLOURS[colour], scaled to deviation 1, as a
    function of (length, seed)."""
    exponent = COLOURS[colour]

    @F.pandas_udf(DOUBLES)
    def run(length: pd.Series, seed: pd.Series) -> pd.Series:
        def one(n: int, s: int):
            if n < 2:
                return np.zeros(max(n, 0))
            z = np.fft.rfft(np.random.default_rng(s & (2**63 - 1)).normal(size=n))
            f = np.maximum(np.fft.rfftfreq(n), 1 / n)
            x = np.fft.irfft(z * f ** (exponent / 2), n)
            return x / max(x.std(), 1e-12)

        return pd.Series([one(int(n), int(s)) for n, s in zip(length, seed, strict=True)], dtype=object)

    return run


def band_limit(kind: str, rate: int, taps: int = 129):
    """A linear-phase band-pass of a device or codec; the upper edge stays below 0.99 of
    the Nyquist frequency."""
    low, high = BANDS[kind][0], min(BANDS[kind][1], 0.99 * rate / 2)
    t = np.arange(taps) - taps // 2
    kernel = (2 * high / rate * np.sinc(2 * high / rate * t) - 2 * low / rate * np.sinc(2 * low / rate * t)) * np.hamming(taps)
    return _per_frame(lambda x: [np.convolve(row, kernel, "same") if len(row) >= taps else np.convolve(row, kernel)[taps // 2 :][: len(row)] for row in x])


@F.pandas_udf(DOUBLES)
def convolve_room(signal: pd.Series, response: pd.Series) -> pd.Series:
    """The signal through a room's impulse response, of its own length and peak."""

    def one(x, h):
        if x is None or h is None or not len(x) or not len(h):
            return x
        n = 1 << (len(x) + len(h) - 1).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]
        return y * np.abs(x).max() / max(np.abs(y).max(), 1e-12)

    return pd.Series([one(x, h) for x, h in zip(signal, response, strict=True)], dtype=object)


def synthetic_room(rt60: float, rate: int, row_seed: Column | None = None) -> Column:
    """An impulse response that falls by 60 dB in rt60 seconds, with signs hashed from their place
    and, where it is given, the row's seed."""
    n = max(1, int(rt60 * rate))
    decay = -6.907755278982137 / n
    parts = [] if row_seed is None else [row_seed]
    sign = lambda i: F.when(i == 0, 1.0).otherwise((F.pmod(F.xxhash64(*parts, i), F.lit(2)) * 2 - 1) * 0.3)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: sign(i) * F.exp(i * decay))


def change_speed(factor: float):
    """Resampled by linear interpolation, 1 / factor as long."""

    def kernel(x):
        at = np.arange(0, x.shape[1] - 1 + 1e-9, factor)
        left = np.minimum(at.astype(int), x.shape[1] - 1)
        right, part = np.minimum(left + 1, x.shape[1] - 1), at - left
        return x[:, left] * (1 - part) + x[:, right] * part

    return _per_frame(kernel)


def biquad(b: tuple[float, float, float], a: tuple[float, float]):
    """A shelf or other second-order section, b0 b1 b2 over 1 a1 a2; the rows of a
    batch advance together."""

    def kernel(x):
        y, z1, z2 = np.empty_like(x), np.zeros(len(x)), np.zeros(len(x))
        for i in range(x.shape[1]):
            y[:, i] = b[0] * x[:, i] + z1
            z1 = b[1] * x[:, i] - a[0] * y[:, i] + z2
            z2 = b[2] * x[:, i] - a[1] * y[:, i]
        return y

    return _per_frame(kernel)


def low_shelf(rate: int, cutoff: float, gain_db: float) -> tuple[tuple[float, float, float], tuple[float, float]]:
    """Coefficients of a low shelf of slope 1."""
    g, w = 10 ** (gain_db / 40), 2 * np.pi * cutoff / rate
    c, alpha = np.cos(w), np.sin(w) / 2 * np.sqrt(2)
    r = 2 * np.sqrt(g) * alpha
    a0 = (g + 1) + (g - 1) * c + r
    b = (g * ((g + 1) - (g - 1) * c + r) / a0, 2 * g * ((g - 1) - (g + 1) * c) / a0, g * ((g + 1) - (g - 1) * c - r) / a0)
    return tuple(map(float, b)), (float(-2 * ((g - 1) + (g + 1) * c) / a0), float(((g + 1) + (g - 1) * c - r) / a0))


def mask_spectra(frames: DataFrame, keys: list[str], spectrum: str, bins: int, frame_span: int, bin_span: int, seed: int) -> DataFrame:
    """Frames (keys, frame, spectrum) with a run of frames and a run of bins set to 0 per
    utterance; where they start is hashed from the keys."""
    count = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("n"))
    at = lambda name, room: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.greatest(room, F.lit(1)))
    spots = count.select(*keys, at("frame", F.col("n") - frame_span).alias("f0"), at("bin", F.lit(bins - bin_span)).alias("b0"))
    gone = (F.col("frame") >= F.col("f0")) & (F.col("frame") < F.col("f0") + frame_span)
    masked = F.transform(spectrum, lambda v, i: F.when(gone | ((i >= F.col("b0")) & (i < F.col("b0") + bin_span)), 0.0).otherwise(v))
    return frames.join(spots, keys).withColumn(spectrum, masked).drop("f0", "b0")


def drop_packets(signal: Column, row_seed: Column, packet: int, per_mille: int) -> Column:
    """Packets of samples lost, by a hash of the row and the packet's number."""
    return F.transform(signal, lambda x, i: F.when(F.pmod(F.xxhash64(row_seed, F.floor(i / packet)), F.lit(1000)) < per_mille, 0.0).otherwise(x))
