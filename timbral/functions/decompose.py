"""Views of a signal over time and frequency: mel, pitch classes, constant Q, phases, and what rings
against what clicks."""

from __future__ import annotations

import numpy as np

from timbral.functions.batches import framed, on_signals
from timbral.functions.pitch import LOWEST
from timbral.functions.signal import mel_filters
from timbral.functions.spectra import centred, restored


def class_filters(rate: float, n_fft: int) -> np.ndarray:
    """(12, bins): to which pitch class (C is 0) each bin above 20 Hz belongs, by the nearest semitone of
    a scale with A at 440 Hz."""
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    place = np.rint(12 * np.log2(np.maximum(f, 1e-9) / 440.0)).astype(int) + 9
    return (np.arange(12)[:, None] == place % 12) & (f > 20)


def pitch_classes(rate: float, length: int = 2048, hop: int = 512):
    """struct(chroma): frames of 12 energies, each frame's largest scaled to 1; silence is 0."""
    filters = class_filters(rate, length).T.astype(float)

    def work(x: np.ndarray) -> dict:
        own = np.abs(centred(x, length, hop)) ** 2 @ filters
        top = own.max(axis=2, keepdims=True)
        return {"chroma": own / np.where(top > 0, top, 1)}

    return on_signals(work, chroma="matrix")


def log_mel(rate: float, length: int = 512, hop: int = 256, bands: int = 128, power: float = 2.0):
    """struct(mel): frames of mel bands in dB, of powers, or of magnitudes at power 1."""
    filters = mel_filters(rate, length, bands).T
    return on_signals(lambda x: {"mel": 10 * np.log10(np.maximum(np.abs(centred(x, length, hop)) ** power @ filters, 1e-10))}, mel="matrix")


def constant_q_transform(x: np.ndarray, rate: float, hop: int, low: float, bins: int, per_octave: int) -> np.ndarray:
    """(signals, frames, bins), complex: at every hop-th sample and for each bin's frequency the sum under
    a Hann window of as many cycles as tell neighbours apart, scaled to the amplitude of a sine. Bins
    above half the rate are 0."""
    cycles = 1 / (2 ** (1 / per_octave) - 1)
    count = x.shape[1] // hop + 1
    out = np.zeros((len(x), count, bins), complex)
    for k in range(bins):
        f = low * 2 ** (k / per_octave)
        if f >= rate / 2:
            break
        n = max(3, int(np.ceil(cycles * rate / f)) | 1)
        t = np.arange(n) - n // 2
        window = np.hanning(n + 2)[1:-1]
        kernel = window * np.exp(-2j * np.pi * f * t / rate) * 2 / window.sum()
        padded = np.pad(x, ((0, 0), (n // 2, n // 2 + hop)))
        out[:, :, k] = framed(padded, n, hop)[:, :count] @ kernel
    return out


def constant_q(rate: float, hop: int = 512, low: float = LOWEST, bins: int = 84, per_octave: int = 24):
    """struct(size, phase) of the constant-Q transform."""

    def work(x: np.ndarray) -> dict:
        z = constant_q_transform(x, rate, hop, low, bins, per_octave)
        return {"size": np.abs(z), "phase": np.angle(z)}

    return on_signals(work, size="matrix", phase="matrix")


def phase_steps(length: int = 2048, hop: int = 512):
    """struct(phase, velocity, acceleration): phases over frames, their steps and the steps of
    those, wrapped to half a turn either way; the last one and two repeat the one before."""
    wrap = lambda p: np.angle(np.exp(1j * p))

    def work(x: np.ndarray) -> dict:
        phase = np.angle(centred(x, length, hop))
        steps = wrap(np.diff(phase, axis=1))
        bends = wrap(np.diff(steps, axis=1))
        n = phase.shape[1]
        fill = lambda v: np.pad(v, ((0, 0), (0, n - v.shape[1]), (0, 0)), mode="edge") if v.shape[1] else np.zeros_like(phase)
        return {"phase": phase, "velocity": fill(steps), "acceleration": fill(bends)}

    return on_signals(work, phase="matrix", velocity="matrix", acceleration="matrix")


def _median(x: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Running medians along an axis, mirrored at the ends."""
    x = np.moveaxis(x, axis, -1)
    n, reach = x.shape[-1], width // 2
    at = np.arange(-reach, n + reach) % (2 * n)
    padded = x[..., np.where(at < n, at, 2 * n - 1 - at)]
    return np.moveaxis(np.median(np.lib.stride_tricks.sliding_window_view(padded, width, axis=-1), axis=-1), -1, axis)


def ringing_and_clicks(x: np.ndarray, length: int, hop: int, width: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """two signals that add up to each: what lasts over frames, and what spreads over frequencies, by
    medians along both and the shares of their squares."""
    z = centred(x, length, hop)
    lasting, spread = (_median(np.abs(z), width, axis) ** 2 for axis in (1, 2))
    total = lasting + spread
    share = np.where(total > 0, lasting / np.where(total > 0, total, 1), 0.5)
    return tuple(restored(z * s, length, hop, x.shape[1]) for s in (share, 1 - share))


def harmonic_percussive(length: int = 2048, hop: int = 512, width: int = 31):
    """struct(harmonic, percussive), signals of the same length."""
    return on_signals(lambda x: dict(zip(("harmonic", "percussive"), ringing_and_clicks(x, length, hop, width), strict=True)), harmonic="doubles", percussive="doubles")
