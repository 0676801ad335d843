"""Orthogonal wavelet pyramids with an exact inverse, and denoising by a universal threshold."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np

from timbral.functions.batches import on_signals


@lru_cache(maxsize=8)
def scaling_filter(moments: int) -> np.ndarray:
    """Daubechies' extremal-phase filter with so many vanishing moments (1 is Haar, 4 is db4): the
    factor of the half-band polynomial whose zeros lie in the unit circle, of sum sqrt(2)."""
    half_band = [comb(moments - 1 + k, k) for k in range(moments)][::-1]
    middle = 1 - 2 * np.roots(half_band).astype(complex)
    root = np.sqrt(middle * middle - 1)
    zeros = np.where(np.abs(middle + root) < 1, middle + root, middle - root)
    h = np.real(np.poly(np.r_[-np.ones(moments), zeros]))
    return h * np.sqrt(2) / h.sum()


def _high(h: np.ndarray) -> np.ndarray:
    """The wavelet filter for synthesis; each low and high filter reversed is the one for analysis."""
    return (h * np.where(np.arange(len(h)) % 2, 1, -1))[::-1]


def analyse(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: approximations and details of signals mirrored at both ends, half as many each
    (and half a filter's length more)."""
    n, f = x.shape[1], len(h)
    at = 2 * np.arange((n + f - 1) // 2)[:, None] + 2 - f + np.arange(f)
    at = at % (2 * n)
    window = x[:, np.where(at < n, at, 2 * n - 1 - at)]
    return window @ h, window @ _high(h)


def synthesise(low: np.ndarray, high: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The n samples that one level was made from."""
    f, size = len(h), low.shape[1]
    out = np.zeros((len(low), 2 * size + f - 2))
    for part, taps in ((low, h), (high, _high(h))):
        for j in range(f):
            out[:, j : j + 2 * size : 2] += part * taps[j]
    return out[:, f - 2 : f - 2 + n]


def pyramid(x: np.ndarray, h: np.ndarray, levels: int) -> list[np.ndarray]:
    """The last approximation, then details from the coarsest to the finest."""
    details = []
    for _ in range(levels):
        x, d = analyse(x, h)
        details.append(d)
    return [x, *details[::-1]]


def rebuilt(parts: list[np.ndarray], h: np.ndarray, n: int) -> np.ndarray:
    """The signals of n samples that pyramid() took apart, or would have."""
    x = parts[0]
    for d, size in zip(parts[1:], [*(p.shape[1] for p in parts[2:]), n], strict=True):
        x = synthesise(x, d, h, size)
    return x


def denoised(x: np.ndarray, moments: int = 4, levels: int = 5, mode: str = "soft", scale: float = 1.0) -> np.ndarray:
    """Details under the universal threshold go. Noise is the median absolute detail of the
    coarsest level over 0.6745, the threshold sqrt(2 ln n) of that, times scale; hard keeps the
    other details, soft moves them towards 0 by the threshold."""
    h, n = scaling_filter(moments), x.shape[1]
    parts = pyramid(x, h, levels)
    sigma = np.median(np.abs(parts[1]), axis=1, keepdims=True) / 0.6745
    limit = scale * sigma * np.sqrt(2 * np.log(n))
    cut = lambda d: np.where(np.abs(d) < limit, 0, d) if mode == "hard" else np.sign(d) * np.maximum(np.abs(d) - limit, 0)
    return rebuilt([parts[0], *map(cut, parts[1:])], h, n)


def wavelet_denoise(moments: int = 4, levels: int = 5, mode: str = "soft", scale: float = 1.0):
    """N11 as a column function: struct(y), of the signal's own length; null for null or empty."""
    return on_signals(lambda x: {"y": denoised(x, moments, levels, mode, scale)}, y="doubles")


def wavelet_level(moments: int = 1):
    """One level of the pyramid as a column function: struct(low, high)."""
    return on_signals(lambda x: dict(zip(("low", "high"), analyse(x, scaling_filter(moments)), strict=True)), low="doubles", high="doubles")
