"""Voices under stress, of other ages and moods, and with other tracts: changes put together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from timbral.functions.batches import on_seeded, on_signals
from timbral.functions.devices import shelf
from timbral.functions.filters import band_pass, high_pass, low_pass, zero_phase
from timbral.functions.spectra import centred, restored
from timbral.functions.voice import shift_formants, shift_pitch, stretched


def _as_loud(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y at the peaks of x; silence stays."""
    top, was = np.abs(y).max(axis=1, keepdims=True), np.abs(x).max(axis=1, keepdims=True)
    return np.where(top > 0, y / np.where(top > 0, top, 1) * was, 0)


def bent(x: np.ndarray, semitones: np.ndarray) -> np.ndarray:
    """Signals whose pitch moves by `semitones` at each sample, by reading faster and slower; what the
    reading gains or loses over the whole is spread, so that the length stays."""
    n = x.shape[1]
    if n < 2:
        return x
    at = np.cumsum(np.broadcast_to(2.0 ** (semitones / 12), x.shape), axis=1)
    at = (at - at[:, :1]) * ((n - 1) / np.maximum(at[:, -1:] - at[:, :1], 1e-9))
    return np.stack([np.interp(a, np.arange(n), row) for a, row in zip(at, x, strict=True)])


def breath(x: np.ndarray, rate: float, cutoff: float, level: float, generators: list) -> np.ndarray:
    noise = np.stack([g.normal(size=x.shape[1]) for g in generators]) * 0.05 * np.abs(x).max(axis=1, keepdims=True)
    return level * zero_phase(noise, high_pass(2, min(cutoff, 0.49 * rate), rate))


def _low(x: np.ndarray, order: int, cutoff: float, rate: float) -> np.ndarray:
    return x if cutoff >= rate / 2 else zero_phase(x, low_pass(order, cutoff, rate))


def stressed(x: np.ndarray, rate: float, level: float, length: int, hop: int) -> np.ndarray:
    """Up to half a semitone higher, highs from 1,500 Hz up to half louder, up to 15 % faster and,
    over 0.3, the pitch trembling six times a second; the level is taken between 0 and 1."""
    level = min(1.0, max(0.0, level))
    if not level:
        return x
    y = zero_phase(shift_pitch(x, 0.5 * level, length, hop), shelf(rate, 1500.0, 20 * np.log10(1 + 0.5 * level), high=True))
    y = stretched(y, 1 + 0.15 * level, length, hop)
    if level > 0.3:
        y = bent(y, 0.03 * level * np.sin(2 * np.pi * 6.0 * np.arange(y.shape[1]) / rate)[None])
    return _as_loud(y, x)


def aged(x: np.ndarray, rate: float, age: float, length: int, hop: int, generators: list) -> np.ndarray:
    """Under 18, higher by 2 to 6 semitones with higher resonances and less low sound; over 60,
    lower by 1 to 3 with lower resonances, less high sound and a tremor of 5 to 7 a second; else a
    twentieth of a semitone lower for each year over 35, and less high sound."""
    n, t = x.shape[1], np.arange(x.shape[1]) / rate
    if age == 35:
        return x
    if age < 18:
        young = (18 - age) / 10
        y = shift_formants(shift_pitch(x, 2 + 4 * young, length, hop), 1.1 + 0.2 * young, length, hop)
        y = zero_phase(y, high_pass(3, 200 * (1 + young), rate))
    elif age > 60:
        old = min(1.0, (age - 60) / 30)
        y = shift_formants(shift_pitch(x, -1 - 2 * old, length, hop), 1 - 0.1 * old, length, hop)
        y = _low(y, 3, 7000 - 3000 * old, rate)
        if old > 0.3:
            pace = np.array([5 + 2 * g.random() for g in generators])[:, None]
            tremor = (0.02 + 0.04 * old) * np.sin(2 * np.pi * pace * t)
            y = bent(y * (1 + tremor), 0.2 * tremor)
    else:
        y = shift_pitch(x, -0.05 * (age - 35), length, hop)
        if age > 35:
            y = _low(y, 2, 8000 - 50 * (age - 35), rate)
    return _as_loud(y[:, :n], x)


def moody(x: np.ndarray, rate: float, mood: str | None, length: int, hop: int, generators: list) -> np.ndarray:
    """Happy, sad, angry or fear; any other mood changes nothing. Faster and slower speech is
    shorter and longer."""
    t = np.arange(x.shape[1]) / rate
    if mood == "happy":
        y = stretched(shift_pitch(x, 1.5, length, hop), 1.1, length, hop)
        y = y + 0.2 * zero_phase(y, band_pass(2, 1000, 8000, rate))
        y = bent(y, 0.04 * np.sin(2 * np.pi * 0.5 * np.arange(y.shape[1]) / rate)[None])
    elif mood == "sad":
        y = _low(stretched(shift_pitch(x, -2.0, length, hop), 0.9, length, hop), 2, 5000, rate)
        y = y + breath(y, rate, 3000, 0.1, generators)
    elif mood == "angry":
        limit = 0.5 * np.abs(x).max(axis=1, keepdims=True)
        pressed = np.where(np.abs(x) > limit, np.sign(x) * (limit + 0.5 * (np.abs(x) - limit)), x)
        y = 0.7 * shift_pitch(x, 1.0, length, hop) + 0.3 * pressed
        y = stretched(y + 0.3 * zero_phase(y, band_pass(2, 1500, 6000, rate)), 1.05, length, hop)
    elif mood == "fear":
        y = shift_pitch(x, 1.2, length, hop) * (1 + 0.06 * np.sin(2 * np.pi * 8.0 * t))
        step = max(1, int(0.1 * rate))
        jitter = np.stack([np.repeat(0.3 * g.normal(size=-(-x.shape[1] // step)), step)[: x.shape[1]] for g in generators])
        y = bent(y, jitter)
        y = y + breath(y, rate, 2500, 0.15, generators)
    else:
        return x
    return _as_loud(y, x)


def perturbed(x: np.ndarray, alpha: float, length: int = 512, hop: int = 128) -> np.ndarray:
    """Each frequency moved to alpha times its own, in the spectra of frames; what would come from
    beyond half the rate is silent. Signals over 1 are scaled to 1."""
    z = centred(x, length, hop)
    bins = z.shape[2]
    source = np.rint(np.arange(bins) / alpha).astype(int)
    moved = np.where(source < bins, z[:, :, np.minimum(source, bins - 1)], 0)
    y = restored(moved, length, hop, x.shape[1])
    return y / np.maximum(np.abs(y).max(axis=1, keepdims=True), 1.0)


def stress(rate: float, level: float, length: int = 2048, hop: int = 512):
    """X13 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": stressed(x, rate, level, length, hop)}, y="doubles")


def age(rate: float, years: float, length: int = 2048, hop: int = 512):
    """X14 as a column function of (signal, seed, any name): struct(y)."""
    return on_seeded(lambda x, generators, _: {"y": aged(x, rate, years, length, hop, generators)}, y="doubles")


def mood(rate: float, length: int = 2048, hop: int = 512):
    """X15 as a column function of (signal, seed, mood): struct(y)."""
    return on_seeded(lambda x, generators, name: {"y": moody(x, rate, name, length, hop, generators)}, y="doubles")


def vocal_tract(alpha: float, length: int = 512, hop: int = 128):
    """X20 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": perturbed(x, alpha, length, hop)}, y="doubles")


def sometimes(signal: Column, changed: Column, row_seed: Column, name: str, share: float = 0.5) -> Column:
    """The changed signal in `share` of the rows, by a hash of the row's seed and the change's name,
    so that changes are independent of each other; else the signal."""
    return F.when(F.pmod(F.xxhash64(row_seed, F.lit(name)), F.lit(1_000_000)) < int(share * 1_000_000), changed).otherwise(signal)


def mixed(dry: Column, wet: Column, level: float) -> Column:
    """(1 - level) of the dry signal and level of the wet one."""
    return F.zip_with(dry, wet, lambda d, w: (1 - level) * d + level * w)
