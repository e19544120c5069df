"""Empirical mode decomposition, and waves within modes."""

from __future__ import annotations

import numpy as np

#: Sifts after which a mode is taken as it is, however restless.
MOST_SIFTS = 60


def maxima(x: np.ndarray) -> np.ndarray:
    """Places of local maxima; a plateau counts once, at its middle; ends may count."""
    starts = np.flatnonzero(np.r_[True, np.diff(x) != 0])
    ends = np.r_[starts[1:], len(x)] - 1
    v = np.r_[-np.inf, x[starts], -np.inf]
    top = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return np.rint((starts + ends) / 2).astype(int)[top]


def spline(knots: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the knots."""
    if len(knots) < 3:
        return np.interp(at, knots, values)
    h = np.diff(knots).astype(float)
    slope = np.diff(values) / h
    bend = np.r_[0.0, bends(h, 6 * np.diff(slope)), 0.0]
    k = np.clip(np.searchsorted(knots, at, side="right") - 1, 0, len(h) - 1)
    d, u = at - knots[k], knots[k + 1] - at
    return (bend[k] * u**3 + bend[k + 1] * d**3) / (6 * h[k]) + (values[k] / h[k] - bend[k] * h[k] / 6) * u + (values[k + 1] / h[k] - bend[k + 1] * h[k] / 6) * d


def bends(h: np.ndarray, right: np.ndarray) -> list[float]:
    """Second derivatives at the inner knots: a system of three diagonals, eliminated downwards
    and solved upwards."""
    diagonal, side, right = (2 * (h[:-1] + h[1:])).tolist(), h.tolist(), right.tolist()
    for k in range(1, len(right)):
        share = side[k] / diagonal[k - 1]
        diagonal[k] -= share * side[k]
        right[k] -= share * right[k - 1]
    out = [right[-1] / diagonal[-1]]
    for k in range(len(right) - 2, -1, -1):
        out.append((right[k] - side[k + 1] * out[-1]) / diagonal[k])
    return out[::-1]


def envelope(x: np.ndarray) -> np.ndarray:
    """Through the maxima, two of them mirrored beyond either end."""
    top = maxima(x)
    if len(top) < 2:
        return np.full(len(x), x[top[0]] if len(top) else x.max())
    last = len(x) - 1
    knots = np.r_[-top[1::-1], top, 2 * last - top[: -3 : -1]]
    values = np.r_[x[top[1::-1]], x[top], x[top[: -3 : -1]]]
    knots, first = np.unique(knots, return_index=True)
    return spline(knots, values[first], np.arange(len(x)))


def counts(x: np.ndarray) -> tuple[int, int]:
    """Extrema and zero crossings."""
    return len(maxima(x)) + len(maxima(-x)), int((np.diff(np.sign(x[x != 0])) != 0).sum())


def decompose(x: np.ndarray, most: int = 5) -> np.ndarray:
    """Modes, fastest first, and last the rest; they add up to the signal."""
    rest, modes = np.asarray(x, float), []
    while len(modes) < most and len(maxima(rest)) + len(maxima(-rest)) > 2:
        mode, steady, before = rest, 0, None
        for _ in range(MOST_SIFTS):
            mode = mode - (envelope(mode) - envelope(-mode)) / 2
            now = counts(mode)
            steady = steady + 1 if now == before and abs(now[0] - now[1]) <= 1 else 0
            before = now
            if steady >= 5:
                break
        modes.append(mode)
        rest = rest - mode
    return np.stack([*modes, rest])


def ensemble(x: np.ndarray, times: int = 20, noise: float = 0.2, most: int = 5, seed: int = 0) -> np.ndarray:
    """Mean modes, and mean rest, of copies of the signal with white noise of `noise` of its
    deviation added; copies of fewer modes count as having empty ones."""
    rng, total = np.random.default_rng(seed), np.zeros((most + 1, len(x)))
    for _ in range(times):
        found = decompose(x + rng.standard_normal(len(x)) * noise * x.std(), most)
        total[: len(found) - 1] += found[:-1]
        total[most] += found[-1]
    return total / times


def waves(x: np.ndarray, fs: float) -> tuple[float, float]:
    """Mean amplitude and mean frequency (Hz) of the analytic signal."""
    n = len(x)
    gain = np.r_[1, np.full((n - 1) // 2, 2.0), np.ones(1 - n % 2), np.zeros((n - 1) // 2)]
    pair = np.fft.ifft(np.fft.fft(x) * gain)
    turn = np.angle(pair[1:] * np.conj(pair[:-1]))
    return float(np.abs(pair).mean()), float(turn.mean() * fs / (2 * np.pi))


def mode_features(x: np.ndarray, fs: float, modes: int = 5) -> list[float]:
    """Lempel-Ziv complexity of each mode's 12-bit samples, most significant bit first, 0
    for modes that are not there; then the waves of the first mode."""
    from pulsegrid.functions.kernels import lempel_ziv

    found = decompose((x - x.min()) * (4095 / max(np.ptp(x), 1e-300)), modes)
    out = []
    for mode in found[:-1]:
        level = np.rint(mode).astype(int) & 4095
        out.append(lempel_ziv((level[:, None] >> np.arange(11, -1, -1) & 1).ravel()))
    return [*out, *[0.0] * (modes - len(out)), *waves(found[0], fs)]
