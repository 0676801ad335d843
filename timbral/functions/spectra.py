"""Spectral estimates beyond the plain transform: many tapers, reassignment, group delay."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from timbral.functions.batches import framed, on_signals


def centred(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """(signals, frames, bins) transforms of Hann-windowed frames around every hop-th sample; signals
    are continued by zeros so that every sample lies in full frames."""
    padded = np.pad(x, ((0, 0), (length // 2, length // 2 + hop)))
    return np.fft.rfft(framed(padded, length, hop) * np.hanning(length + 1)[:-1])


def joined(frames: np.ndarray, hop: int, window: np.ndarray, n: int) -> np.ndarray:
    """Windowed frames added up where they lie, by the sum of squared windows, from the middle of the
    first frame on."""
    rows, count, length = frames.shape
    out, weight = np.zeros((rows, length + hop * (count - 1))), np.zeros(length + hop * (count - 1))
    for k in range(count):
        out[:, k * hop : k * hop + length] += frames[:, k] * window
        weight[k * hop : k * hop + length] += window**2
    y = (out / np.maximum(weight, 1e-6))[:, length // 2 : length // 2 + n]
    return np.pad(y, ((0, 0), (0, n - y.shape[1])))


def restored(z: np.ndarray, length: int, hop: int, n: int) -> np.ndarray:
    """The n samples whose transforms centred() gave, or the nearest to changed ones."""
    return joined(np.fft.irfft(z, length), hop, np.hanning(length + 1)[:-1], n)


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """The size of signals' analytic continuation: their spectra without negative frequencies."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


@lru_cache(maxsize=64)
def slepian_tapers(n: int, bandwidth: float = 4.0, count: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(tapers, concentrations): the orthonormal sequences of n samples with the most energy
    within bandwidth / n cycles a sample, falling. They are eigenvectors of a tridiagonal matrix with
    well separated eigenvalues; concentrations are then energies under the sinc kernel."""
    i, w = np.arange(n), min(bandwidth / n, 0.5)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    beside = i[1:] * (n - i[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    tapers = vectors[:, ::-1][:, : min(count, n)].T
    sign = np.where(np.arange(len(tapers)) % 2 == 0, tapers.sum(axis=1), (tapers * (n - 1 - 2 * i)).sum(axis=1))
    tapers = tapers * np.where(sign < 0, -1, 1)[:, None]
    spectrum = np.abs(np.fft.rfft(tapers, 2 * n)) ** 2
    kept = np.fft.irfft(spectrum, 2 * n)[:, :n] * np.r_[1.0, np.full(n - 1, 2.0)]
    return tapers, np.clip(kept @ (2 * w * np.sinc(2 * w * i)), 0, 1)


def multitaper(x: np.ndarray, rate: float, n_fft: int, bandwidth: float = 4.0, count: int = 8) -> np.ndarray:
    """(signals, n_fft // 2 + 1) power a Hz: periodograms of tapered signals less their means, one-sided,
    averaged by the tapers' concentrations. Signals longer than n_fft go in whole, by folding."""
    tapers, weights = slepian_tapers(x.shape[1], bandwidth, count)
    out = np.zeros((len(x), n_fft // 2 + 1))
    for taper, weight in zip(tapers, weights, strict=True):
        own = x * taper
        own = np.pad(own, ((0, 0), (0, -own.shape[1] % n_fft))).reshape(len(x), -1, n_fft).sum(axis=1)
        out += weight * np.abs(np.fft.rfft(own, n_fft)) ** 2 / rate
    out[:, 1 : (n_fft + 1) // 2] *= 2
    return out / weights.sum()


def multitaper_spectrum(rate: float, n_fft: int, bandwidth: float = 4.0, count: int = 8):
    """F12 as a column function: struct(power). Short signals have as many tapers as samples."""
    return on_signals(lambda x: {"power": multitaper(x, rate, n_fft, bandwidth, count)}, power="doubles")


def reassigned(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """(signals, frames, bins) energies of a Hann-windowed transform, each moved to the time and
    frequency where its phase turns least: by the transforms with the window's derivative and with
    the window times time. What would leave the grid goes to its edge, so that energy is kept."""
    t = np.arange(length) - (length - 1) / 2
    window = np.hanning(length + 2)[1:-1]
    slope = np.pi / (length + 1) * np.sin(2 * np.pi * (t / (length + 1) + 0.5))
    f = framed(x, length, hop)
    plain, timed, slanted = (np.fft.rfft(f * w) for w in (window, window * t, slope))
    energy = np.abs(plain) ** 2
    safe = np.where(energy > 1e-20, plain, 1)
    later = np.where(energy > 1e-20, np.real(timed / safe), 0) / hop
    higher = np.where(energy > 1e-20, -np.imag(slanted / safe), 0) * length / (2 * np.pi)
    n, frames, bins = energy.shape
    row = np.clip(np.rint(np.arange(frames)[:, None] + later), 0, frames - 1).astype(int)
    column = np.clip(np.rint(np.arange(bins) + higher), 0, bins - 1).astype(int)
    out = np.zeros_like(energy)
    np.add.at(out, (np.arange(n)[:, None, None], row, column), energy)
    return out


def reassigned_spectrum(length: int, hop: int):
    """F11 as a column function: struct(energy), frames of bins. Signals without a full frame are null."""
    return on_signals(lambda x: {"energy": reassigned(x, length, hop)}, least=length, energy="matrix")


def cepstral_smooth(spectrum: np.ndarray, keep: int = 20) -> np.ndarray:
    """Magnitudes of two-sided spectra (rows) with only the lowest `keep` quefrencies, on both
    sides, kept of their logarithm."""
    cepstrum = np.fft.ifft(np.log(np.abs(spectrum) + 1e-10)).real
    cepstrum[:, keep : spectrum.shape[1] - keep] = 0
    return np.exp(np.fft.fft(cepstrum).real)


def group_delay(x: np.ndarray, n_fft: int, gamma: float = 0.4, alpha: float = 0.2, keep: int = 20) -> np.ndarray:
    """(signals, n_fft // 2 + 1): products of the spectra of the signal and of its steps over the
    smoothed power, compressed by the exponent alpha with their sign, the largest scaled to gamma."""
    window = np.hamming(x.shape[1])
    own = np.fft.fft(x * window, n_fft)
    steps = np.fft.fft(np.diff(x, axis=1, prepend=0) * window, n_fft)
    tau = np.real(steps * np.conj(own)) / cepstral_smooth(own, keep) ** 2
    bent = np.sign(tau) * np.abs(tau) ** alpha
    top = np.abs(bent).max(axis=1, keepdims=True)
    return np.where(top > 0, bent / np.where(top > 0, top, 1) * gamma, 0)[:, : n_fft // 2 + 1]


def modified_group_delay(n_fft: int, gamma: float = 0.4, alpha: float = 0.2, keep: int = 20):
    """F13, F13b as a column function: struct(delay)."""
    return on_signals(lambda x: {"delay": group_delay(x, n_fft, gamma, alpha, keep)}, delay="doubles")


def octave_contrast(magnitude: np.ndarray, rate: float, low: float = 200.0, bands: int = 6, share: float = 0.02) -> np.ndarray:
    """(frames, bands + 1) of magnitude spectra: in dB, the mean of the strongest `share` of bins
    over that of the weakest, one bin at least, below `low` and in each octave above; the last band
    ends at half the rate. 0 in a band without bins."""
    f = np.linspace(0, rate / 2, magnitude.shape[1])
    edges = np.r_[0, low * 2.0 ** np.arange(bands + 1)]
    out = np.zeros((len(magnitude), bands + 1))
    for k in range(bands + 1):
        inside = (f >= edges[k]) & (f < edges[k + 1] if k < bands else f >= edges[k])
        if inside.any():
            own = np.sort(magnitude[:, inside], axis=1)
            n = max(1, round(share * own.shape[1]))
            out[:, k] = 20 * np.log10(np.maximum(own[:, -n:].mean(axis=1), 1e-5) / np.maximum(own[:, :n].mean(axis=1), 1e-5))
    return out


def spectral_contrast(rate: float, n_fft: int):
    """F10 as a column function of frames: struct(contrast)."""

    def work(x: np.ndarray) -> dict:
        return {"contrast": octave_contrast(np.abs(np.fft.rfft(x * np.hanning(x.shape[1] + 1)[:-1], n_fft)), rate)}

    return on_signals(work, contrast="doubles")


def bark(f: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.00076 * f) + 3.5 * np.arctan((f / 7500) ** 2)


def masking(rate: float, n_fft: int, width: float = 0.5, level: float = 0.1):
    """struct(threshold) of magnitude spectra of n_fft // 2 + 1 bins: `level` of the magnitudes
    around each bin, weighed by a triangle of `width` Bark to either side. What denoising left below
    it is better kept as it was, or single bins ring."""
    z = bark(np.arange(n_fft // 2 + 1) * rate / n_fft)
    spread = np.maximum(0, 1 - np.abs(z[:, None] - z) / width)
    return on_signals(lambda m: {"threshold": level * m @ spread}, threshold="doubles")


def power_cepstra(x: np.ndarray, filters: np.ndarray, length: int, hop: int, coefficients: int = 13, slow: float = 0.999, fast: float = 0.5) -> np.ndarray:
    """(signals, frames, coefficients) power-normalized cepstra: band powers averaged over five
    frames, less a floor that rises slowly and falls fast, to the 15th root, cosine-transformed."""
    power = np.abs(centred(x, length, hop)) ** 2 @ filters.T
    smooth = framed(np.pad(power, ((0, 0), (2, 2), (0, 0)), mode="edge").swapaxes(1, 2).reshape(-1, power.shape[1] + 4), 5, 1).mean(axis=2)
    smooth = smooth.reshape(len(x), power.shape[2], -1).swapaxes(1, 2)
    floor = np.empty_like(smooth)
    floor[:, 0] = smooth[:, 0]
    for k in range(1, smooth.shape[1]):
        now, was = smooth[:, k], floor[:, k - 1]
        floor[:, k] = np.where(now >= was, slow * was + (1 - slow) * now, fast * was + (1 - fast) * now)
    root = np.maximum(smooth - floor, 0) ** (1 / 15)
    k, m = np.arange(coefficients)[:, None], np.arange(filters.shape[0])[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * filters.shape[0])) * np.where(k == 0, np.sqrt(1 / filters.shape[0]), np.sqrt(2 / filters.shape[0]))
    return root @ basis.T


def pncc(rate: float, length: int = 512, hop: int = 256, bands: int = 40, coefficients: int = 13):
    """F09 as a column function: struct(pncc), frames of coefficients."""
    from timbral.functions.signal import mel_filters

    filters = mel_filters(rate, length, bands)
    return on_signals(lambda x: {"pncc": power_cepstra(x, filters, length, hop, coefficients)}, pncc="matrix")
