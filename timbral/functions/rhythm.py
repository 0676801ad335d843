"""Rates and small movements of speech: syllables, voice onsets, tremor."""

from __future__ import annotations

import numpy as np

from timbral.functions.batches import framed, on_signals, peaks
from timbral.functions.filters import low_pass, zero_phase
from timbral.functions.spectra import analytic_envelope, centred


def syllable_rate(x: np.ndarray, rate: float, slow: float = 100.0, n_fft: int = 1024) -> np.ndarray:
    """F16: syllables a minute: 60 times the strongest frequency from 3 to 8 Hz of the envelope, below
    10 Hz and at `slow` values a second; of equals the lowest."""
    envelope = zero_phase(analytic_envelope(x), low_pass(2, 10.0, rate))[:, :: max(1, int(rate // slow))]
    size = np.abs(np.fft.rfft(envelope[:, :n_fft], n_fft))
    f = np.fft.rfftfreq(n_fft, 1 / slow)
    inside = np.flatnonzero((f >= 3) & (f <= 8))
    return 60 * f[inside[size[:, inside].argmax(axis=1)]]


def speech_rate(rate: float):
    """F16 as a column function: struct(per_minute)."""
    return on_signals(lambda x: {"per_minute": syllable_rate(x, rate)}, least=2, per_minute="double")


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Rows through a Gaussian of four sigmas to either side, mirrored at the ends."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = x.shape[1]
    at = np.arange(-reach, n + reach) % (2 * n)
    return framed(x[:, np.where(at < n, at, 2 * n - 1 - at)], 2 * reach + 1, 1) @ (kernel / kernel.sum())


def onset_times(envelope: np.ndarray, step_ms: float, window: int) -> tuple[list[int], list[float]]:
    """F22 on one smoothed envelope: (bursts, times in ms). A burst is a peak of the slope of a tenth
    of the steepest at least; in the first four fifths, voice sets in after it at the first of
    `window` places over 0.3 of the loudest that stays over 0.2 for five; times of 5 to 150 ms count."""
    slope = np.diff(envelope, prepend=envelope[:1])
    bursts = peaks(slope, 0.1 * slope.max(initial=0.0)).tolist()
    top, found = envelope.max(initial=0.0), []
    for b in bursts:
        if b > 0.8 * len(envelope):
            continue
        for i in range(b, min(b + window, len(envelope) - 5)):
            if envelope[i] > 0.3 * top and (envelope[i : i + 5] > 0.2 * top).all():
                if 5 <= (i - b) * step_ms <= 150:
                    found.append((i - b) * step_ms)
                break
    return bursts, found


def voice_onsets(rate: float, length: int = 512, hop: int = 128, sigma: float = 2.0):
    """F22 as a column function: struct(bursts, times, mean, deviation), the last two 0 without times."""

    def work(x: np.ndarray) -> dict:
        envelope = gaussian_smooth(np.abs(centred(x, length, hop)).sum(axis=2), sigma)
        own = [onset_times(e, hop / rate * 1000, max(1, int(0.03 * rate / hop))) for e in envelope]
        stat = lambda f: [float(f(t)) if t else 0.0 for _, t in own]
        return {"bursts": [b for b, _ in own], "times": [t for _, t in own], "mean": stat(np.mean), "deviation": stat(np.std)}

    return on_signals(work, bursts="longs", times="doubles", mean="double", deviation="double")


def modulations(x: np.ndarray, rate: float, length: int, hop: int) -> dict[str, np.ndarray]:
    """flux, the mean rise of log powers between frames; its deviation from a mean over five;
    the mean turn of phases; the deviation of the envelope's steps over its mean; and the share of
    the envelope's spectrum from 4 to 8 Hz."""
    z = centred(x, length, hop)
    size = np.abs(z)
    rise = np.maximum(np.diff(20 * np.log10(np.maximum(size, 1e-5)), axis=1, prepend=20 * np.log10(np.maximum(size[:, :1], 1e-5))), 0).mean(axis=2)
    smooth = framed(np.pad(rise, ((0, 0), (2, 2))), 5, 1).sum(axis=2) / 5
    turn = np.abs(np.diff(np.angle(z), axis=1)).mean(axis=(1, 2)) if z.shape[1] > 1 else np.zeros(len(x))
    envelope = np.sqrt((size**2).sum(axis=2))
    steps = np.pad(np.diff(envelope, axis=1), ((0, 0), (0, 1)))
    spectrum = np.abs(np.fft.rfft(envelope))
    f = np.fft.rfftfreq(envelope.shape[1], hop / rate)
    tremor = spectrum[:, (f >= 4) & (f <= 8)].sum(axis=1) / (spectrum.sum(axis=1) + 1e-10)
    return {"flux": rise.mean(axis=1), "residual": (rise - smooth).std(axis=1), "phase": turn, "envelope": steps.std(axis=1) / (envelope.mean(axis=1) + 1e-10), "tremor": tremor}


def micro_modulations(rate: float, length: int = 512, hop: int = 128):
    """F27 as a column function: struct(flux, residual, phase, envelope, tremor)."""
    return on_signals(lambda x: modulations(x, rate, length, hop), flux="double", residual="double", phase="double", envelope="double", tremor="double")
