"""What evens out channels, phases, rates and spectra of recordings, each of the signal's own length."""

from __future__ import annotations

import numpy as np

from timbral.functions.batches import framed, on_signals
from timbral.functions.glottal import inverse_filtered
from timbral.functions.signal import levinson, mel_filters
from timbral.functions.spectra import analytic_envelope, centred, joined, restored


def _smooth(x: np.ndarray, taps: int) -> np.ndarray:
    """Centred means of `taps` values (zeros outside) of rows."""
    left = (taps - 1) // 2
    return framed(np.pad(x, ((0, 0), (taps - 1 - left, left))), taps, 1).sum(axis=2) / taps


def equalized(x: np.ndarray, length: int = 2048, hop: int = 512, target: np.ndarray | None = None) -> np.ndarray:
    """The mean spectrum brought towards `target` (flat at its smoothed mean without one) by a
    smoothed gain from a tenth to ten."""
    z = centred(x, length, hop)
    mean = np.abs(z).mean(axis=1)
    wanted = np.broadcast_to(_smooth(mean, 11).mean(axis=1, keepdims=True) if target is None else target, mean.shape)
    gain = np.clip(_smooth(wanted / (mean + 1e-10), 11), 0.1, 10.0)
    return restored(z * gain[:, None, :], length, hop, x.shape[1])


def phase_normalized(x: np.ndarray, length: int = 2048, hop: int = 512) -> np.ndarray:
    """The mean group delay of all frames, summed up over the bins, taken off the phases."""
    z = centred(x, length, hop)
    phase = np.unwrap(np.angle(z), axis=2)
    delay = -np.diff(phase, axis=2, prepend=phase[:, :, :1])
    correction = -np.cumsum(delay.mean(axis=1, keepdims=True), axis=2)
    return restored(z * np.exp(-1j * correction), length, hop, x.shape[1])


def modulation_normalized(x: np.ndarray, rate: float, envelope_rate: float = 200.0) -> np.ndarray:
    """The envelope's mean modulation spectrum made flat but doubled from 4 to 8 Hz, by a smoothed
    gain from a fifth to five; the signal follows the new envelope. Below 512 samples nothing is done."""
    n = x.shape[1]
    if n < 512:
        return x
    envelope = analytic_envelope(x)
    step = max(1, int(rate / envelope_rate))
    slow = envelope[:, ::step]
    slow = np.pad(slow, ((0, 0), (0, max(0, 512 - slow.shape[1]))))
    length, hop = 512, 128
    z = centred(slow, length, hop)
    f = np.fft.rfftfreq(length, 1 / envelope_rate)
    wanted = np.where((f >= 4) & (f <= 8), 2.0, 1.0)
    gain = np.clip(_smooth(wanted / (np.abs(z).mean(axis=1) + 1e-10), 5), 0.2, 5.0)
    new = restored(z * gain[:, None, :], length, hop, slow.shape[1])[:, : len(range(0, n, step))]
    at = np.arange(n) / step
    full = np.stack([np.interp(at, np.arange(new.shape[1]), row) for row in new])
    return x * (full / (envelope + 1e-10))


def cepstra(x: np.ndarray, rate: float, length: int, hop: int, bands: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transforms, coefficients over frames, cosine basis) of log mel powers in dB."""
    z = centred(x, length, hop)
    power = np.abs(z) ** 2 @ mel_filters(rate, length, bands).T
    k, m = np.arange(count)[:, None], np.arange(bands)[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * bands)) * np.where(k == 0, np.sqrt(1 / bands), np.sqrt(2 / bands))
    return z, 10 * np.log10(np.maximum(power, 1e-10)) @ basis.T, basis


def windowed_norm(c: np.ndarray, width: int | None) -> np.ndarray:
    """Coefficients (signals, frames, k) less their mean, over their deviation + 1e-10, in frames
    from i - width // 2 to i + width // 2 - 1, or over all frames without a width."""
    n = c.shape[1]
    half = n if width is None else max(1, width // 2)
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half, n)
    centre = c.mean(axis=1, keepdims=True)  # sums of small numbers are exact enough
    sums = np.cumsum(np.pad(c - centre, ((0, 0), (1, 0), (0, 0))), axis=1)
    squares = np.cumsum(np.pad((c - centre) ** 2, ((0, 0), (1, 0), (0, 0))), axis=1)
    size = (high - low)[None, :, None]
    mean = (sums[:, high] - sums[:, low]) / size
    spread = np.sqrt(np.maximum((squares[:, high] - squares[:, low]) / size - mean**2, 0))
    return (c - centre - mean) / (spread + 1e-10)


def cepstral_normalized(x: np.ndarray, rate: float, length: int = 512, hop: int = 256, bands: int = 128, count: int = 20, seconds: float | None = 3.0) -> np.ndarray:
    """A signal from its normalized cepstra and its own phases. The cepstra give mel powers,
    and those spectra by least squares, negative ones cut to 0: the way back is only near."""
    z, c, basis = cepstra(x, rate, length, hop, bands, count)
    c = windowed_norm(c, None if seconds is None else int(seconds * rate / hop))
    mel = 10 ** (np.clip(c @ basis, -100, 100) / 10)
    power = np.maximum(mel @ np.linalg.pinv(mel_filters(rate, length, bands)).T, 0)
    return restored(np.sqrt(power) * np.exp(1j * np.angle(z)), length, hop, x.shape[1])


def flattened(x: np.ndarray, rate: float, order: int = 16, frame_s: float = 0.025, hop_s: float = 0.010) -> np.ndarray:
    """Each frame's prediction residual, added up where it lies, at the signal's energy.
    Samples behind the last full frame are 0; a signal without a full frame is 0."""
    length, hop = int(frame_s * rate), int(hop_s * rate)
    f = framed(x, length, hop)
    if not f.shape[1]:
        return np.zeros_like(x)
    window = np.hamming(length)
    own = (f * window).reshape(-1, length)
    rest = inverse_filtered(own, levinson(own, order)).reshape(f.shape)
    out = np.zeros_like(x)
    for k in range(f.shape[1]):
        out[:, k * hop : k * hop + length] += rest[:, k] * window
    power = lambda v: (v**2).sum(axis=1, keepdims=True)
    return out * np.sqrt(power(x) / (power(out) + 1e-10))


def equalize(length: int = 2048, hop: int = 512):
    """N12 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": equalized(x, length, hop)}, y="doubles")


def normalize_phase(length: int = 2048, hop: int = 512):
    """N13 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": phase_normalized(x, length, hop)}, y="doubles")


def normalize_modulation(rate: float):
    """N14 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": modulation_normalized(x, rate)}, y="doubles")


def normalize(rate: float, length: int = 2048, hop: int = 512):
    """N15 as a column function: struct(y): equalized, then phases, then modulation."""
    return on_signals(lambda x: {"y": modulation_normalized(phase_normalized(equalized(x, length, hop), length, hop), rate)}, y="doubles")


def normalize_cepstra(rate: float, length: int = 512, hop: int = 256, bands: int = 128, count: int = 20, seconds: float | None = 3.0):
    """N16 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": cepstral_normalized(x, rate, length, hop, bands, count, seconds)}, y="doubles")


def flatten_spectrum(rate: float, order: int = 16, frame_s: float = 0.025, hop_s: float = 0.010):
    """N17 as a column function: struct(y)."""
    return on_signals(lambda x: {"y": flattened(x, rate, order, frame_s, hop_s)}, y="doubles")
