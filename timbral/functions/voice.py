"""Changes of a voice: time, pitch and formants, of the signal's own length."""

from __future__ import annotations

import numpy as np

from timbral.functions.batches import framed, on_signals
from timbral.functions.glottal import burg, inverse_filtered
from timbral.functions.spectra import centred, joined


def _owners(size: np.ndarray) -> np.ndarray:
    """For each bin of each row the nearest local maximum; of two as near the lower one."""
    bins = np.arange(size.shape[1])
    padded = np.pad(size, ((0, 0), (1, 1)), constant_values=-1)
    top = (size > padded[:, :-2]) & (size >= padded[:, 2:])
    below = np.maximum.accumulate(np.where(top, bins, -(1 << 30)), axis=1)
    above = np.minimum.accumulate(np.where(top, bins, 1 << 30)[:, ::-1], axis=1)[:, ::-1]
    nearest = np.where(bins - below <= above - bins, below, above)
    return np.clip(nearest, 0, size.shape[1] - 1)


def stretched(x: np.ndarray, speed: float, length: int, hop: int) -> np.ndarray:
    """A phase vocoder: signals 1 / speed as long with the same pitch. Magnitudes are interpolated at
    each new frame; phases add up the advance that was measured between the two old ones. The bins
    around a maximum keep their phases towards it, or they would cancel each other."""
    n = max(1, round(x.shape[1] / speed))
    z = centred(x, length, hop)
    z = np.pad(z, ((0, 0), (0, 2), (0, 0)))
    at = np.arange(0, z.shape[1] - 2, speed)
    expected = 2 * np.pi * hop * np.arange(z.shape[2]) / length
    phase, frames = np.angle(z[:, 0]), []
    for t in at:
        left = int(t)
        a, b, part = z[:, left], z[:, left + 1], t - left
        size = (1 - part) * np.abs(a) + part * np.abs(b)
        owner = _owners(size)
        phase = np.angle(a) + np.take_along_axis(phase - np.angle(a), owner, axis=1)
        frames.append(size * np.exp(1j * phase))
        turn = np.angle(b) - np.angle(a) - expected
        phase = phase + expected + turn - 2 * np.pi * np.rint(turn / (2 * np.pi))
    window = np.hanning(length + 1)[:-1]
    return joined(np.fft.irfft(np.stack(frames, axis=1), length), hop, window, n)


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """Signals at n samples by their Fourier series: what lies above half the new rate goes."""
    z = np.fft.rfft(x)
    size = n // 2 + 1
    z = np.pad(z, ((0, 0), (0, max(0, size - z.shape[1]))))[:, :size]
    return np.fft.irfft(z, n) * (n / x.shape[1])


def time_stretch(speed: float, length: int = 2048, hop: int = 512):
    """The speaking rate times `speed` at the same pitch: struct(y) of 1 / speed the length,
    or of the length of the signal, by cutting or by zeros, where y is asked for as `kept`."""

    def work(x: np.ndarray) -> dict:
        y = stretched(x, speed, length, hop)
        return {"y": y, "kept": np.pad(y, ((0, 0), (0, max(0, x.shape[1] - y.shape[1]))))[:, : x.shape[1]]}

    return on_signals(work, y="doubles", kept="doubles")


def shift_pitch(x: np.ndarray, semitones: float, length: int, hop: int) -> np.ndarray:
    factor = 2 ** (semitones / 12)
    n = x.shape[1]
    # a whole number of samples on both sides of the resampling keeps the factor exact
    longer = stretched(np.pad(x, ((0, 0), (length, length))), 1 / factor, length, hop)
    y = resampled(longer, max(1, round(longer.shape[1] / factor)))
    start = length
    return np.pad(y[:, start : start + n], ((0, 0), (0, max(0, n - max(0, y.shape[1] - start)))))


def pitch_shift(semitones: float, length: int = 2048, hop: int = 512):
    """The pitch moved by semitones, as a column function: struct(y) of the same length: a
    phase vocoder stretches time by the factor, resampling takes it back."""
    return on_signals(lambda x: {"y": x if semitones == 0 else shift_pitch(x, semitones, length, hop)}, y="doubles")


def rotated(a: np.ndarray, factor: float) -> np.ndarray:
    """Prediction filters (rows) whose complex zeros are turned to `factor` times their angle, at most
    just under half the rate; zeros on the real line stay."""
    n = a.shape[1] - 1
    companion = np.zeros((len(a), n, n))
    companion[:, np.arange(1, n), np.arange(n - 1)] = 1
    companion[:, 0] = -a[:, 1:]
    z = np.linalg.eigvals(companion)
    angle = np.angle(z)
    turned = np.sign(angle) * np.minimum(np.abs(angle) * factor, 0.999 * np.pi)
    z = np.where(np.abs(z.imag) > 1e-12, np.abs(z) * np.exp(1j * turned), z)
    out = np.ones((len(a), 1), complex)
    for k in range(n):
        out = np.pad(out, ((0, 0), (0, 1))) - z[:, k : k + 1] * np.pad(out, ((0, 0), (1, 0)))
    return out.real


def all_pole(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Signals through 1 over the filters of their rows, all rows in step."""
    order = a.shape[1] - 1
    y = np.zeros((len(x), x.shape[1] + order))
    back = a[:, :0:-1]
    for i in range(x.shape[1]):
        y[:, i + order] = x[:, i] - (back * y[:, i : i + order]).sum(axis=1)
    return y[:, order:]


def shift_formants(x: np.ndarray, factor: float, length: int, hop: int, order: int = 24, emphasis: float = 0.97) -> np.ndarray:
    n = x.shape[1]
    window = np.hanning(length + 1)[:-1]
    f = framed(np.pad(x, ((0, 0), (length // 2, length // 2 + hop))), length, hop)
    rows, count = f.shape[:2]
    f = (f * window).reshape(-1, length)
    raised = f - emphasis * np.pad(f, ((0, 0), (1, 0)))[:, :-1]
    a = burg(raised, order)
    changed = all_pole(inverse_filtered(raised, a), rotated(a, factor))
    lowered = all_pole(changed, np.tile([1.0, -emphasis], (len(f), 1)))
    y = joined(lowered.reshape(rows, count, length), hop, window, n)
    top, was = np.abs(y).max(axis=1, keepdims=True), np.abs(x).max(axis=1, keepdims=True)
    return np.where(top > 0, y / np.where(top > 0, top, 1) * was, 0)


def formant_shift(factor: float, length: int = 2048, hop: int = 512):
    """Resonances at `factor` times their frequency, as a column function: struct(y) of the same
    length and peak. Frames are split by linear prediction of order 24 into an excitation and a
    filter, whose zeros are turned; other filters would move the pitch too."""
    return on_signals(lambda x: {"y": x if factor == 1 else shift_formants(x, factor, length, hop)}, y="doubles")
