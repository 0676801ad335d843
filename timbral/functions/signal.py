"""Numeric kernels on frames, as Arrow-batched functions, and columns over their spectra.

Framing, overlap-add, averages over frames and all scores are plans; only what has no column
form (transforms, recursions, roots) runs in these small vectorized helpers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from timbral.functions import vectors as V

DOUBLES = ArrayType(DoubleType())


#: Frames that a kernel sees at once, so that its work does not grow with a batch.
FRAMES = 512


def _stacked(frames: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of frames of one length of a batch, FRAMES at a time; null frames are in none."""
    sizes = frames.map(lambda x: -1 if x is None else len(x)).to_numpy()
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n) if n > 0 else np.zeros(0, int)
        for lo in range(0, len(own), FRAMES):
            rows = own[lo : lo + FRAMES]
            yield rows, np.stack(frames.iloc[rows].to_numpy()).astype(float)


def _per_frame(kernel):
    """A pandas UDF that applies a matrix kernel to frames of one length, some at a time."""

    @F.pandas_udf(DOUBLES)
    def run(frames: pd.Series) -> pd.Series:
        out: list = [None] * len(frames)
        for rows, x in _stacked(frames):
            for i, y in zip(rows, kernel(x), strict=True):
                out[i] = y
        return pd.Series(out, dtype=object)

    return run


def tone(spark, rows: list[tuple[str, float, float, int]], rate: int = 16000) -> DataFrame:
    """(utt_id, i, x) of test tones (utt_id, frequency, amplitude, samples), made in the JVM with a
    little noise from a hash of place and name."""
    table = spark.createDataFrame(rows, "utt_id string, f double, a double, n int")
    long = table.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    noise = (F.pmod(F.xxhash64(F.lit(42), "utt_id", "i"), F.lit(2001)) - 1000) / 1000.0
    return long.select("utt_id", "i", (F.col("a") * F.sin(2 * np.pi * F.col("f") * F.col("i") / rate) + 0.002 * noise).alias("x"))


def magnitude_spectrum(n_fft: int):
    """|FFT| of Hann-windowed frames, n_fft // 2 + 1 bins."""
    return _per_frame(lambda x: np.abs(np.fft.rfft(x * np.hanning(x.shape[1] + 1)[:-1], n_fft)))


def complex_spectrum(n_fft: int):
    """Real parts, then imaginary parts, of the windowed transform."""

    def kernel(x):
        z = np.fft.rfft(x * np.hanning(x.shape[1] + 1)[:-1], n_fft)
        return np.concatenate([z.real, z.imag], axis=1)

    return _per_frame(kernel)


def inverse_spectrum(length: int):
    """Windowed frames from complex_spectrum() output."""

    def kernel(x):
        half = x.shape[1] // 2
        return np.fft.irfft(x[:, :half] + 1j * x[:, half:])[:, :length] * np.hanning(length + 1)[:-1]

    return _per_frame(kernel)


def mel_filters(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale 2595 log10(1 + f / 700)."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mfcc(rate: int, n_fft: int = 512, bands: int = 40, coefficients: int = 20, lifter: int = 22):
    """liftered cosine transform of log mel energies of a frame."""
    filters = mel_filters(rate, n_fft, bands)
    k, m = np.arange(coefficients)[:, None], np.arange(bands)[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * bands)) * np.where(k == 0, np.sqrt(1 / bands), np.sqrt(2 / bands))
    lift = 1 + lifter / 2 * np.sin(np.pi * np.arange(coefficients) / lifter) if lifter else 1.0

    def kernel(x):
        power = np.abs(np.fft.rfft(x * np.hanning(x.shape[1] + 1)[:-1], n_fft)) ** 2
        return np.log(power @ filters.T + 1e-10) @ basis.T * lift

    return _per_frame(kernel)


def levinson(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction filters [1, a1, ..] of frames (rows) by the Levinson recursion on their own products;
    [1, 0, ..] for silence."""
    r = np.stack([(x[:, : x.shape[1] - k] * x[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1)
    a, e = np.zeros((len(x), order + 1)), r[:, 0] + 1e-12
    a[:, 0] = 1
    for i in range(1, order + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(axis=1) / e
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i] if i > 1 else k[:, None]
        e = e * (1 - k * k)
    a[r[:, 0] <= 1e-12, 1:] = 0
    return a


def lpc(order: int):
    """Prediction filters of Hamming-windowed frames."""
    return _per_frame(lambda x: levinson(x * np.hamming(x.shape[1]), order))


def formants(rate: int, most: int = 4):
    """Up to `most` resonances above 90 Hz of prediction filters, ascending."""

    def kernel(filters):
        for a in filters:
            z = np.roots(a)
            f = np.sort(np.angle(z[z.imag > 0]) * rate / (2 * np.pi))
            yield f[f > 90][:most]

    return _per_frame(kernel)


def pitch(rate: int, low: float = 75.0, high: float = 400.0, clarity: float = 0.3):
    """[f0] of a frame by its autocorrelation's best lag, [] where it is not clear."""

    def kernel(x):
        x = x - x.mean(axis=1, keepdims=True)
        n = 1 << int(2 * x.shape[1] - 1).bit_length()
        r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2)[:, : x.shape[1]]
        r = r / np.maximum(r[:, :1], 1e-12) * (x.shape[1] / np.maximum(x.shape[1] - np.arange(x.shape[1]), 1))
        a, b = int(rate / high), min(int(rate / low), x.shape[1] - 2)
        if b <= a + 1:
            return [[] for _ in x]
        near, best = r[:, a : b + 1], r[:, a : b + 1].max(axis=1, keepdims=True)
        peak = (near >= 0.9 * best) & (near >= r[:, a - 1 : b]) & (near >= r[:, a + 1 : b + 2])
        lag = np.where(peak.any(axis=1), peak.argmax(axis=1), near.argmax(axis=1)) + a  # not a multiple of the period
        rows = np.arange(len(x))
        y0, y1, y2 = (r[rows, np.clip(lag + d, 0, r.shape[1] - 1)] for d in (-1, 0, 1))
        bend = y0 - 2 * y1 + y2
        fine = lag + np.where(np.abs(bend) > 1e-12, 0.5 * (y0 - y2) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
        return [[rate / f] if v >= clarity else [] for f, v in zip(fine, y1, strict=True)]

    return _per_frame(kernel)


def centroid(mag: Column, step: float) -> Column:
    """mean frequency of a magnitude spectrum whose bins are `step` apart."""
    weighted = F.transform(mag, lambda m, i: m * i * F.lit(step))
    return F.try_divide(V.total(weighted), V.total(mag))


def bandwidth(mag: Column, step: float) -> Column:
    spread = V.let(centroid(mag, step), lambda c: V.total(F.transform(mag, lambda m, i: m * (i * F.lit(step) - c) * (i * F.lit(step) - c))))
    return F.sqrt(F.try_divide(spread, V.total(mag)))


def flatness(mag: Column) -> Column:
    """Geometric over arithmetic mean of the power, each bin raised by 1e-10."""
    n = F.size(mag)
    return F.exp(V.total(F.transform(mag, lambda m: F.log(m * m + 1e-10))) / n) / (V.total(F.transform(mag, lambda m: m * m + 1e-10)) / n)


def rolloff_bin(mag: Column, share: float = 0.85) -> Column:
    """The first bin at which the cumulated magnitude reaches its share."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    count = lambda limit: F.aggregate(mag, zero, lambda a, m: F.struct((a["sum"] + m).alias("sum"), (a["at"] + (a["sum"] + m < limit).cast("int")).alias("at")))
    return V.let(V.total(mag) * share, count)["at"]


def spectral_subtraction(frames: DataFrame, keys: list[str], n_fft: int, noise_frames: int = 10, over: float = 1.5, floor: float = 0.01) -> DataFrame:
    """Frames (keys, frame, x) denoised: power less `over` times the mean power of the
    first frames, but `floor` of it at least; phases stay. Returns (keys, frame, y)."""
    half = n_fft // 2 + 1
    spectra = frames.withColumn("z", complex_spectrum(n_fft)(F.col("x")))
    re, im = F.slice("z", 1, half), F.slice("z", half + 1, half)
    spectra = spectra.withColumn("p", F.zip_with(re, im, lambda a, b: a * a + b * b))
    bins = spectra.where(F.col("frame") < noise_frames).select(*keys, F.posexplode("p").alias("k", "v"))
    noise = bins.groupBy(*keys, "k").agg(F.avg("v").alias("v"))
    noise = noise.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("noise"))
    gain = F.zip_with("p", "noise", lambda p, n: F.sqrt(F.greatest(p - over * n, floor * p) / (p + 1e-12)))
    joined = spectra.join(noise, keys).withColumn("g", gain)
    scaled = F.zip_with("z", F.concat("g", "g"), lambda z, g: z * g)
    return joined.select(*keys, "frame", F.size("x").alias("n"), scaled.alias("z"))


def overlap_add(frames: DataFrame, keys: list[str], length: int, hop: int) -> DataFrame:
    """(keys, i, x): windowed inverse transforms summed over frames, by the sum of squared windows."""
    window = np.hanning(length + 1)[:-1] ** 2
    squares = F.array(*[F.lit(float(w)) for w in window])
    rows = frames.withColumn("y", inverse_spectrum(length)(F.col("z"))).select(*keys, "frame", F.posexplode(F.arrays_zip("y", squares.alias("w"))).alias("k", "s"))
    rows = rows.select(*keys, (F.col("frame") * hop + F.col("k")).alias("i"), F.col("s.y").alias("y"), F.col("s.w").alias("w"))
    return rows.groupBy(*keys, "i").agg((F.sum("y") / F.greatest(F.sum("w"), F.lit(1e-3))).alias("x"))


@F.pandas_udf(DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact dynamic time warping of two sequences, absolute differences; each
    anti-diagonal is one numpy step. Null or empty sequences have none."""

    def one(x, y):
        if x is None or y is None or not len(x) or not len(y):
            return None
        x, y = np.asarray(x, float), np.asarray(y, float)
        before, last = np.full(len(x) + 1, np.inf), np.full(len(x) + 1, np.inf)
        before[0] = 0
        for d in range(2, len(x) + len(y) + 1):
            i = np.arange(max(1, d - len(y)), min(len(x), d - 1) + 1)
            now = np.full(len(x) + 1, np.inf)
            now[i] = np.abs(x[i - 1] - y[d - i - 1]) + np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
            before, last = last, now
        return float(last[len(x)])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
