"""Probabilistic pitch tracking: candidates with probabilities per frame, and the best path.

Each frame's normalized difference function gives candidate periods; a distribution over
thresholds gives each candidate its probability. A path through pitch and voicing states that
changes slowly is then found by dynamic programming, all signals of one length in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from timbral.functions.batches import framed, on_signals

#: C2 and C7 in Hz, the range that voices are searched in.
LOWEST, HIGHEST = 65.40639132514966, 2093.004522404789


@dataclass(frozen=True)
class Tracker:
    """What a track depends on: rates, the range of pitch, steps a semitone, and how readily pitch
    and voicing change."""

    rate: float
    length: int = 2048
    hop: int = 512
    low: float = LOWEST
    high: float = HIGHEST
    steps: int = 10
    thresholds: int = 100
    octaves_a_second: float = 35.92
    switch: float = 0.01
    no_trough: float = 0.01

    @property
    def bins(self) -> int:
        return int(np.floor(12 * self.steps * np.log2(self.high / self.low))) + 1

    @property
    def reach(self) -> int:
        """Pitch bins that a frame may move by, either way."""
        return round(self.octaves_a_second * 12 * self.hop / self.rate) * self.steps // 2

    @property
    def lags(self) -> tuple[int, int]:
        window = self.length // 2
        return max(1, int(np.floor(self.rate / self.high))), min(int(np.ceil(self.rate / self.low)), self.length - window - 1)


def difference(frames: np.ndarray, t: Tracker) -> np.ndarray:
    """(frames, lags): squared differences with the signal `lag` later, over the mean of those at all
    shorter lags; near 0 at a period. Lags run from t.lags[0] to t.lags[1]."""
    window, (first, last) = t.length // 2, t.lags
    size = 1 << int(2 * t.length - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(frames, size) * np.conj(np.fft.rfft(frames[:, :window], size)), size)[:, : last + 1]
    energy = np.cumsum(np.pad(frames**2, ((0, 0), (1, 0))), axis=1)
    own = energy[:, window : window + last + 1] - energy[:, : last + 1]
    d = np.maximum(own[:, :1] + own - 2 * both, 0)
    mean = np.cumsum(d[:, 1:], axis=1) / np.arange(1, last + 1)
    return (d[:, 1:] / np.maximum(mean, np.finfo(float).tiny))[:, first - 1 :]


def threshold_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n thresholds and how probable each is: steps of the distribution function of Beta(2, 18)."""
    edges = np.linspace(0, 1, n + 1)
    below = 1 - (1 - edges) ** 19 - 19 * edges * (1 - edges) ** 18
    return edges[1:], np.diff(below)


def candidates(d: np.ndarray, t: Tracker, decay: float = 2.0) -> np.ndarray:
    """(frames, lags): how probable each local minimum is to be the period. Under each threshold the
    minima below it share the threshold's weight, earlier ones more; if there are none, the lowest
    one gets a small part of it."""
    inner = (d[:, 1:-1] < d[:, :-2]) & (d[:, 1:-1] <= d[:, 2:])
    trough = np.concatenate([d[:, :1] < d[:, 1:2], inner, np.zeros((len(d), 1), bool)], axis=1)
    out = np.zeros_like(d)
    rows, lowest = np.arange(len(d)), np.where(trough, d, np.inf).argmin(axis=1)
    some = trough.any(axis=1)
    for limit, weight in zip(*threshold_weights(t.thresholds), strict=True):
        under = trough & (d < limit)
        count = under.sum(axis=1)
        place = np.cumsum(under, axis=1) - 1
        # places weigh exp(-decay k), scaled to 1 over those there are
        share = (1 - np.exp(-decay)) / np.maximum(1 - np.exp(-decay * np.maximum(count, 1)), 1e-300)
        out += np.where(under, weight * share[:, None] * np.exp(-decay * place), 0)
        none = some & (count == 0)
        out[rows[none], lowest[none]] += t.no_trough * weight
    return out


def observations(frames: np.ndarray, t: Tracker) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) probabilities of pitch bins, and of each frame to be voiced."""
    d = difference(frames, t)
    if d.shape[1] < 3:
        return np.zeros((len(frames), t.bins)), np.zeros(len(frames))
    p = candidates(d, t)
    row, lag = np.nonzero(p)
    inside = (lag > 0) & (lag < d.shape[1] - 1)
    y0, y1, y2 = (d[row, np.clip(lag + k, 0, d.shape[1] - 1)] for k in (-1, 0, 1))
    bend = y0 - 2 * y1 + y2
    shift = np.where(inside & (np.abs(bend) > 1e-12), 0.5 * (y0 - y2) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
    f = t.rate / (t.lags[0] + lag + np.clip(shift, -1, 1))
    at = np.clip(np.rint(12 * t.steps * np.log2(f / t.low)), 0, t.bins - 1).astype(int)
    out = np.zeros((len(frames), t.bins))
    np.add.at(out, (row, at), p[row, lag])
    return out, np.clip(out.sum(axis=1), 0, 1)


def band(t: Tracker) -> np.ndarray:
    """(2 reach + 1, bins) log probabilities to come to a bin from the one `offset - reach` above it:
    a triangle that falls to 0 beyond the reach, scaled to sum 1 for each bin that is left."""
    offsets = np.arange(-t.reach, t.reach + 1)
    shape = 1.0 - np.abs(offsets) / (t.reach + 1)
    source = np.arange(t.bins)[None, :] + offsets[:, None]
    reachable = source[:, :, None] - offsets[None, None, :]
    totals = np.where((reachable >= 0) & (reachable < t.bins), shape, 0).sum(axis=2)
    inside = (source >= 0) & (source < t.bins)
    return np.log(np.where(inside, shape[:, None] / np.maximum(totals, 1e-300), 1e-300))


def best_paths(pitches: np.ndarray, voiced: np.ndarray, t: Tracker) -> np.ndarray:
    """(signals, frames) most probable states, given (signals, frames, bins) and (signals, frames);
    state b < bins is voiced at bin b, bins + b is unvoiced there. Among equals, the lowest."""
    n, length, bins = pitches.shape
    tiny, moves = 1e-300, band(t)
    seen = np.log(np.concatenate([pitches, np.repeat(((1 - voiced) / bins)[:, :, None], bins, axis=2)], axis=2) + tiny)
    stay, change = np.log(1 - t.switch), np.log(t.switch)
    score = seen[:, 0] - np.log(2 * bins)
    back = np.zeros((n, length, 2 * bins), np.int32)
    width = 2 * t.reach + 1
    for k in range(1, length):
        on, off = score[:, :bins], score[:, bins:]
        for part, (own, other) in enumerate(((on, off), (off, on))):
            keep = own + stay >= other + change
            if part:  # equal scores go to the lower state, a voiced one
                keep = own + stay > other + change
            best = np.where(keep, own + stay, other + change)
            padded = np.pad(best, ((0, 0), (t.reach, t.reach)), constant_values=-np.inf)
            reach = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1) + moves.T
            pick = reach.argmax(axis=2)
            source = np.clip(pick + np.arange(bins) - t.reach, 0, bins - 1)
            from_own = np.take_along_axis(keep, source, axis=1)
            home = bins * part
            back[:, k, home : home + bins] = source + np.where(from_own, home, bins - home)
            score_part = np.take_along_axis(reach, pick[:, :, None], axis=2)[:, :, 0] + seen[:, k, home : home + bins]
            if part:
                score = np.concatenate([first, score_part], axis=1)
            else:
                first = score_part
    path = np.zeros((n, length), int)
    path[:, -1] = score.argmax(axis=1)
    for k in range(length - 1, 0, -1):
        path[:, k - 1] = back[np.arange(n), k, path[:, k]]
    return path


def tracks(x: np.ndarray, t: Tracker) -> dict[str, list]:
    """f0 (null where unvoiced), voiced and probability per frame. Frames are centred: signals are
    continued by zeros on both sides, and one shorter than a frame still has one frame or more."""
    padded = np.pad(x, ((0, 0), (t.length // 2, t.length // 2)))
    f = framed(padded, t.length, t.hop)
    pitches, voiced = observations(f.reshape(-1, t.length), t)
    pitches, voiced = pitches.reshape(*f.shape[:2], -1), voiced.reshape(f.shape[:2])
    path = best_paths(pitches, voiced, t)
    on = path < t.bins
    f0 = t.low * 2 ** ((path % t.bins) / (12 * t.steps))
    return {"f0": [[float(v) if o else None for v, o in zip(a, b, strict=True)] for a, b in zip(f0, on, strict=True)], "voiced": list(on), "probability": list(voiced)}


def pitch_track(tracker: Tracker):
    """F04, F14 as a column function: struct(f0, voiced, probability), arrays over centred frames."""
    return on_signals(lambda x: tracks(x, tracker), least=2, f0="doubles", voiced="flags", probability="doubles")
