"""Rooms: responses by image sources, measured responses, and what they say about the room."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.functions.batches import KINDS, on_signals
from timbral.functions.filters import band_pass, filtered

SOUND = 343.0
#: Centres in Hz of the octave bands.
OCTAVES = (125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0)
#: Feedback places of shift registers of maximal length, by their order.
FEEDBACK = {3: (3, 2), 4: (4, 3), 5: (5, 3), 6: (6, 5), 7: (7, 6), 8: (8, 6, 5, 4), 9: (9, 5), 10: (10, 7), 11: (11, 9), 12: (12, 11, 10, 4), 13: (13, 12, 11, 8), 14: (14, 13, 12, 2), 15: (15, 14), 16: (16, 15, 13, 4)}


def reflectance(size: tuple[Column, Column, Column], rt60: Column) -> Column:
    """The share of pressure that walls give back, for a reverberation time, by Sabine's formula;
    at least a 10th, where the time is too short for the room."""
    x, y, z = size
    absorbed = 0.161 * x * y * z / (2 * (x * y + y * z + x * z) * rt60)
    return F.sqrt(1 - F.least(absorbed, F.lit(0.99)))


def image_sources(rooms: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """X11: (keys, reflections, distance, gain) of all images of the source of up to `most`
    reflections. rooms has x, y, z (size in m), sx, sy, sz (source), mx, my, mz (microphone) and
    wall (pressure given back by a wall). Images are enumerated axis by axis, each within what is
    left of `most`, so that no more rows arise than there are images and their halves."""
    found = rooms.withColumn("reflections", F.lit(0)).withColumn("square", F.lit(0.0))
    for axis in "xyz":
        turns = F.explode(F.sequence(-F.col("left"), F.col("left")))
        found = found.withColumn("left", F.lit(most) - F.col("reflections")).withColumn("n", turns)
        # n reflections along an axis: an even number keeps the source's side, an odd one mirrors it
        odd = F.pmod(F.col("n"), F.lit(2))
        place = F.when(odd == 0, F.col("n") * F.col(axis) + F.col(f"s{axis}")).otherwise((F.col("n") + 1) * F.col(axis) - F.col(f"s{axis}"))
        apart = place - F.col(f"m{axis}")
        found = found.withColumn("square", F.col("square") + apart * apart).withColumn("reflections", F.col("reflections") + F.abs("n"))
    distance = F.greatest(F.sqrt("square"), F.lit(1e-3))
    gain = F.pow(F.col("wall"), F.col("reflections").cast("double")) / (4 * math.pi * distance)
    return found.select(*keys, "reflections", distance.alias("distance"), gain.alias("gain"))


def room_responses(rooms: DataFrame, keys: list[str], rate: float, most: int = 10) -> DataFrame:
    """X11: (keys, h): the response of each (room, source, microphone), images added at the sample
    nearest to their arrival. Sums are made per sample before a room's array is built."""
    at = F.round(F.col("distance") / SOUND * rate).cast("int")
    taps = image_sources(rooms, keys, most).groupBy(*keys, at.alias("at")).agg(F.sum("gain").alias("gain"))
    by_place = F.map_from_entries(F.collect_list(F.struct("at", "gain"))).alias("taps")
    whole = taps.groupBy(*keys).agg(by_place, F.max("at").alias("last"))
    h = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("taps", i), F.lit(0.0)))
    return whole.select(*keys, h.alias("h"))


def in_rooms(signals: DataFrame, rooms: DataFrame, room_keys: list[str], signal: str, response: str = "h") -> DataFrame:
    """signals with column `wet`: each in its room, of its own length and peak. Rooms are joined by
    key, so that each response is built once whatever the number of signals in it."""
    from timbral.functions.augmentation import convolve_room

    return signals.join(rooms, room_keys).withColumn("wet", convolve_room(F.col(signal), F.col(response))).drop(response)


def sweep(n: int, low: float, high: float, rate: float) -> np.ndarray:
    """n samples of a sine whose frequency rises exponentially."""
    pace = np.log(high / low) / (n / rate)
    return np.sin(2 * np.pi * low * np.expm1(pace * np.arange(n) / rate) / pace)


def maximal_sequence(order: int) -> np.ndarray:
    """2^order - 1 values 1 or -1 whose circular autocorrelation is -1 but at 0."""
    register, out = [1] * order, []
    for _ in range(2**order - 1):
        out.append(1.0 - 2 * register[-1])
        new = sum(register[k - 1] for k in FEEDBACK[order]) % 2
        register = [new, *register[:-1]]
    return np.array(out)


def _recorded(h: np.ndarray, signal: np.ndarray, circular: bool = False) -> np.ndarray:
    n = len(signal) if circular else len(signal) + h.shape[1] - 1
    if circular and h.shape[1] > n:
        h = np.pad(h, ((0, 0), (0, -h.shape[1] % n))).reshape(len(h), -1, n).sum(axis=1)
    return np.fft.irfft(np.fft.rfft(h, n) * np.fft.rfft(signal, n), n)


def _taken_back(y: np.ndarray, signal: np.ndarray, floor: float) -> np.ndarray:
    n = y.shape[1]
    own = np.fft.rfft(signal, n)
    h = np.fft.irfft(np.fft.rfft(y) * np.conj(own) / (np.abs(own) ** 2 + floor), n)
    return h[:, : n - len(signal) + 1]


def played(signal: np.ndarray, circular: bool = False):
    """struct(y): what a microphone records when `signal` is played in a room with the given response:
    the whole convolution, or one period of it when the signal is repeated."""
    return on_signals(lambda h: {"y": _recorded(h, signal, circular)}, y="doubles")


def sweep_response(signal: np.ndarray, floor: float = 1e-10):
    """struct(h): the response from a recording of the sweep `signal`, by division of spectra, as
    long as the recording is longer than the sweep and one sample more. Frequencies that the sweep
    does not hold are damped by `floor`."""
    return on_signals(lambda y: {"h": _taken_back(y, signal, floor)}, least=len(signal), h="doubles")


def swept(signal: np.ndarray, floor: float = 1e-10):
    """struct(h): sweep_response() of what played() records, for a given response. The recordings, each
    longer than the sweep, are never a column."""
    return on_signals(lambda h: {"h": _taken_back(_recorded(h, signal), signal, floor)}, h="doubles")


def sequence_response(order: int):
    """struct(h): the response from one period of a recording of a repeated maximal sequence, by
    circular correlation; the sequence's own offset is taken off, so that it is exact."""
    signal = maximal_sequence(order)
    n = len(signal)

    def work(y: np.ndarray) -> dict:
        match = np.fft.irfft(np.fft.rfft(y[:, :n]) * np.conj(np.fft.rfft(signal)), n)
        return {"h": (match + match.sum(axis=1, keepdims=True)) / (n + 1)}

    return on_signals(work, least=n, h="doubles")


def decay_time(h: np.ndarray, rate: float) -> list[float | None]:
    """Twice the time in which the energy still to come falls from -5 to -35 dB of its whole;
    null for silence, or where it ends above -35 dB."""
    left = np.cumsum(h[:, ::-1] ** 2, axis=1)[:, ::-1]
    whole = left[:, :1]
    db = 10 * np.log10(left / np.where(whole > 0, whole, 1) + 1e-10)
    below = lambda level: np.where((db <= level).any(axis=1) & (whole[:, 0] > 0), (db <= level).argmax(axis=1), -1)
    return [float(2 * (b - a) / rate) if a >= 0 and b >= 0 else None for a, b in zip(below(-5.0), below(-35.0), strict=True)]


def reverberation(rate: float, bands: tuple[float, ...] = OCTAVES):
    """G43 as a column function of a response: struct(whole, bands): the reverberation time of all of
    it, and of each octave band around `bands` below half the rate, null above."""
    designs = [band_pass(4, b / math.sqrt(2), b * math.sqrt(2), rate) if b * math.sqrt(2) < rate / 2 else None for b in bands]

    def work(h: np.ndarray) -> dict:
        own = [[None] * len(h) if d is None else decay_time(filtered(h, d), rate) for d in designs]
        return {"whole": decay_time(h, rate), "bands": [list(r) for r in zip(*own, strict=True)]}

    return on_signals(work, whole="double", bands="doubles")


@F.arrow_udf(T.StructType([T.StructField("iacc", T.DoubleType()), T.StructField("lag", T.LongType())]))
def cross_correlation(left: pa.Array, right: pa.Array) -> pa.Array:
    """The largest size of the normalized cross-correlation over all lags, and that lag: by how
    many samples the left signal is later; of equals the smallest. Null for null, empty or silent."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
        a, b = (np.array([0.0 if v is None else v for v in s or []], float) for s in (a, b))
        scale = math.sqrt(float(a @ a) * float(b @ b))
        if not scale:
            out.append(None)
            continue
        n = 1 << (len(a) + len(b) - 1).bit_length()
        both = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
        size = np.abs(np.r_[both[n - len(b) + 1 :], both[: len(a)]]) / scale
        best = int(np.flatnonzero(size >= size.max() - 1e-12)[0])
        out.append({"iacc": float(size[best]), "lag": best - len(b) + 1})
    return pa.array(out, pa.struct([("iacc", KINDS["double"][1]), ("lag", KINDS["long"][1])]))


def energy_ratios(channels: DataFrame, keys: list[str], channel: str, signal: str) -> DataFrame:
    """(keys, channel, energy, ratio) with each channel's energy over its recording's largest,
    null for silence. Two groupings, no window: a recording's channels may be many."""
    power = F.aggregate(signal, F.lit(0.0), lambda s, v: s + v * v)
    own = channels.select(*keys, channel, F.coalesce(power, F.lit(0.0)).alias("energy"))
    top = own.groupBy(*keys).agg(F.max("energy").alias("top"))
    return own.join(top, keys).select(*keys, channel, "energy", F.try_divide("energy", F.nullif("top", F.lit(0.0))).alias("ratio"))
