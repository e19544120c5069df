"""Sequential signal kernels in numpy, for Arrow batches of segments.

Only what column expressions cannot say well: recursive filters, thresholds that follow the
signal, sifting and subsequence counting. Each takes and returns plain arrays or numbers.
"""

from __future__ import annotations

import math

import numpy as np


def butterworth(order: int, cutoff: float | tuple[float, float], fs: float, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a Butterworth filter, by the bilinear transform. kind is
    low or high, or pass or stop with a pair of cutoffs (of twice the order then)."""
    edges = [2 * fs * math.tan(math.pi * c / fs) for c in np.atleast_1d(cutoff)]
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind in ("low", "high"):
        poles = edges[0] * poles if kind == "low" else edges[0] / poles
        zeros, unit = np.full(order, -1.0 if kind == "low" else 1.0), 1.0 if kind == "low" else -1.0
    else:
        # Every pole of the low pass becomes two, about the geometric centre of the band.
        centre = math.sqrt(edges[0] * edges[1])
        half = (edges[1] - edges[0]) / 2
        half = half * poles if kind == "pass" else half / poles
        split = np.sqrt(half * half - centre * centre)
        poles = np.r_[half + split, half - split]
        turn = 2 * math.atan(centre / (2 * fs))
        zeros = np.r_[np.ones(order), -np.ones(order)] if kind == "pass" else np.exp(1j * turn * np.repeat([1, -1], order))
        unit = np.exp(1j * turn) if kind == "pass" else 1.0
    a = np.real(np.poly((2 * fs + poles) / (2 * fs - poles)))
    b = np.real(np.poly(zeros))
    return b * abs(np.polyval(a, unit) / np.polyval(b, unit)), a


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the filter at which a constant input of 1 gives a constant output."""
    b, a = np.asarray(b) / a[0], np.asarray(a) / a[0]
    n = len(a) - 1
    system = np.eye(n)
    system[:, 0] += a[1:]
    system[:-1, 1:] -= np.eye(n - 1)
    return np.linalg.solve(system, b[1:] - a[1:] * b[0])


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed; rows of x are filtered side by side."""
    y, z = np.empty_like(x, dtype=float), np.repeat(state[None], len(x), 0) if state.ndim == 1 else state.copy()
    for t in range(x.shape[1]):
        y[:, t] = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:] + b[1:-1] * x[:, t, None] - a[1:-1] * y[:, t, None]
        z[:, -1] = b[-1] * x[:, t] - a[-1] * y[:, t]
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter rows forwards and backwards, ends extended by odd reflection."""
    x = np.atleast_2d(np.asarray(x, float))
    pad = min(3 * max(len(a), len(b)), x.shape[1] - 1)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    zi = steady_state(b, a)
    for _ in range(2):
        wide = run_filter(b, a, wide, zi[None] * wide[:, :1])[:, ::-1]
    return wide[:, pad : pad + x.shape[1]]


def without_drift(x: np.ndarray, fs: float, cutoff: float = 1.0) -> np.ndarray:
    t = math.tan(math.pi * cutoff / fs)
    return zero_phase(np.array([1, -1]) / (1 + t), np.array([1, -(1 - t) / (1 + t)]), x)


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Rows to n samples through their Fourier transform. The wave of half the lower rate, which
    has no phase, keeps its values at the samples that both rates share."""
    old = x.shape[1]
    least = min(n, old)
    kept = np.zeros((len(x), n // 2 + 1), complex)
    kept[:, : least // 2 + 1] = np.fft.rfft(x, axis=1)[:, : least // 2 + 1]
    if least % 2 == 0 and n != old:
        kept[:, least // 2] *= 0.5 if n > old else 2
    return np.fft.irfft(kept, n, axis=1) * (n / old)


def earlier_neighbours(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """For every place, the places before it whose suffixes come next to its own in order, below
    and above (-1: none). keys: the 64 bits from each place on, zeros behind the last. Suffixes
    are sorted by the bits that ranks tell, twice as many in every round."""
    n, h = len(keys), 64
    values, rank = np.unique(np.r_[keys, np.uint64(0)], return_inverse=True)  # one more place, of zeros
    told = len(values)
    while told <= n and h < n:
        both = rank * (n + 1)
        both[: n + 1 - h] += rank[h:]
        values, rank = np.unique(both, return_inverse=True)
        told, h = len(values), 2 * h
    order = np.argsort(rank[:n], kind="stable").tolist()
    below, above, stack = [-1] * n, [-1] * n, []
    for i in order:
        while stack and stack[-1] > i:
            above[stack.pop()] = i
        if stack:
            below[i] = stack[-1]
        stack.append(i)
    return below, above


def lempel_ziv(bits: np.ndarray) -> float:
    """Number of new words met from left to right, over n / log2 n. A word that the end cuts
    short is not one. The longest stretch that was met before begins at a neighbour among the
    sorted suffixes."""
    keys = (np.asarray(bits) != 0).astype(np.uint64)
    n = len(keys)
    if n < 2:
        return 0.0
    for k in (1, 2, 4, 8, 16, 32):
        keys = keys << np.uint64(k) | np.r_[keys[k:], np.zeros(min(k, n), np.uint64)]
    below, above = earlier_neighbours(keys)
    held, words, start = keys.tolist(), 0, 0
    while start < n:
        longest = 0
        for at in (below[start], above[start]):
            same = 0
            while at >= 0 and start + same < n:
                apart = held[start + same] ^ held[at + same]
                if apart:
                    same += 64 - apart.bit_length()
                    break
                same += 64
            longest = max(longest, min(same, n - start))
        start += longest + 1
        words += start <= n
    return words * math.log2(n) / n


def binarised(x: np.ndarray) -> np.ndarray:
    """0/1 around zero, or around a fifth of the peak of the side with fewer small samples
    where four tenths or more of the samples are small."""
    high, low = x.max(), x.min()
    up = ((x > 0) & (x < 0.1 * high)).sum()
    down = ((x < 0) & (x > 0.1 * low)).sum()
    if up + down < 0.4 * len(x):
        return x > 0
    return x > 0.2 * (high if up < down else low)


def sample_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    """Log ratio of template matches of m and m + 1 samples, within share of the deviation."""
    r, n = share * x.std(), len(x)
    close, size = np.abs(x[:, None] - x) <= r, n - m + 1
    near = np.logical_and.reduce([close[k : size + k, k : size + k] for k in range(m)])
    np.fill_diagonal(near, False)
    longer = near[:-1, :-1] & close[m:, m:]
    return float(np.log((near.sum() + 1e-100) / (longer.sum() + 1e-100)))


def taper(n: int, alpha: float) -> np.ndarray:
    """Flat window with cosine ends that take up the share alpha of it."""
    edge = alpha * (n - 1) / 2
    inward = np.minimum(np.arange(n), np.arange(n)[::-1])
    return np.where(inward <= math.floor(edge), 0.5 * (1 - np.cos(np.pi * np.minimum(inward / edge, 1))), 1.0)


def threshold_crossings(x: np.ndarray, fs: int, seconds: float = 3.0, level: float = 0.2) -> float:
    """Mean percentage, over windows a second apart, of tapered samples beyond a share of
    the window's largest."""
    n = min(int(seconds * fs), len(x))
    window = taper(n, 0.5 / seconds)
    shares = []
    for start in range(0, len(x) - n + 1, fs):
        size = np.abs(x[start : start + n] * window)
        shares.append(100 * (size > level * size.max()).mean())
    return float(np.mean(shares))


def lifted_exponential(x: np.ndarray, fs: int, tau: float = 0.2) -> float:
    """Lifts a second of a decaying curve that starts anew at the next local maximum each
    time the signal rises through it."""
    reach = max(1, round(0.05 * fs))
    ends = np.full(reach, -np.inf)
    most = np.lib.stride_tricks.sliding_window_view(np.r_[ends, x, ends], reach).max(axis=1)  # of the samples before each, and from each on
    tops = (np.flatnonzero(x[1:-1] > np.maximum(most[1 : len(x) - 1], most[reach + 2 : reach + len(x)])) + 1).tolist()
    lifts, k = 0, 0
    while k < len(tops):
        t0 = tops[k]
        later = np.arange(t0 + 1, len(x))
        above = later[x[later] > x[t0] * np.exp(-(later - t0) / (tau * fs))]
        if not len(above):
            break
        k = int(np.searchsorted(tops, above[0], side="right"))
        lifts += k < len(tops)
    return lifts * fs / len(x)


def hilbert_cells(x: np.ndarray, cells: int = 40) -> np.ndarray:
    """Share of a grid that each row's points (signal, quadrature) visit."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0], gain[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        gain[n // 2] = 1
    pair = np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)
    grid = lambda v: np.floor((v - v.min(1, keepdims=True)) * (cells - 1) / np.maximum(np.ptp(v, axis=1, keepdims=True), 1e-300)).astype(int)
    at = grid(pair.real) * cells + grid(pair.imag)
    return np.array([len(np.unique(r)) for r in at]) / cells**2


def peak_amplitude(x: np.ndarray, fs: int) -> float:
    """Largest height of a local maximum over a neighbouring local minimum."""
    turn = np.flatnonzero(np.diff(np.sign(np.diff(x))) != 0) + 1
    v = x[np.r_[0, turn, len(x) - 1]]
    return float(np.abs(np.diff(v)).max()) if len(v) > 1 else 0.0


def detrended_fluctuation(x: np.ndarray, sizes: list[int]) -> float:
    """Slope of log fluctuation about a line against log box size."""
    walk = np.cumsum(x - x.mean())
    logs = []
    for n in sizes:
        boxes = walk[: len(walk) // n * n].reshape(-1, n)
        t = np.arange(n) - (n - 1) / 2
        rest = boxes - boxes.mean(1, keepdims=True)
        rest = rest - np.outer(rest @ t / (t @ t), t)
        logs.append((math.log(n), math.log(math.sqrt((rest**2).mean()) + 1e-300)))
    return float(np.polyfit(*zip(*logs), 1)[0])


def higuchi(x: np.ndarray, kmax: int) -> float:
    """Fractal dimension from curve lengths at growing steps."""
    n, logs = len(x), []
    for k in range(1, kmax + 1):
        lengths = []
        for m in range(k):
            steps = (n - 1 - m) // k
            lengths.append(np.abs(np.diff(x[m : m + steps * k + 1 : k])).sum() * (n - 1) / (steps * k) / k)
        logs.append((math.log(1 / k), math.log(np.mean(lengths) + 1e-300)))
    return float(np.polyfit(*zip(*logs), 1)[0])


def hurst(x: np.ndarray) -> float:
    """Slope of log rescaled range against log length of the beginning of the series."""
    n = np.arange(2, len(x) + 1)
    total = np.cumsum(x)
    logs = []
    for k in n:
        walk = total[:k] - np.arange(1, k + 1) * total[k - 1] / k
        s = x[:k].std()
        if s > 0 and np.ptp(walk) > 0:
            logs.append((math.log(k), math.log(np.ptp(walk) / s)))
    return float(np.polyfit(*zip(*logs), 1)[0]) if len(logs) > 1 else 0.0


def singular_entropy(x: np.ndarray, lag: int, dim: int) -> tuple[float, float]:
    """(entropy, Fisher information) of the normalised singular values of the embedding."""
    rows = np.stack([x[i * lag : len(x) - (dim - 1 - i) * lag] for i in range(dim)], axis=1)
    s = np.linalg.svd(rows, compute_uv=False)
    s = s / s.sum()
    return float(-(s * np.log(s + 1e-300)).sum()), float((np.diff(s) ** 2 / (s[:-1] + 1e-300)).sum())


def morlet(f: float, fs: float, width: int = 5) -> np.ndarray:
    """A Morlet wavelet of unit energy, three and a half deviations to either side."""
    s = width / (2 * math.pi * f)
    t = np.arange(-math.ceil(3.5 * s * fs), math.ceil(3.5 * s * fs) + 1) / fs
    w = np.exp(-(t**2) / (2 * s * s)) * np.exp(2j * math.pi * f * t)
    return w / np.sqrt((np.abs(w) ** 2).sum())


def wavelets(x: np.ndarray, freqs: list[float], fs: float, width: int = 5) -> np.ndarray:
    """(rows, frequencies, samples): the complex transform of each row; its square is power
    and its angle phase. ValueError where a wavelet is longer than the rows."""
    n, out = x.shape[1], []
    for f in freqs:
        w = morlet(f, fs, width)
        if len(w) > n:
            raise ValueError(f"{n} samples are too few for a wavelet of {len(w)} at {f} Hz")
        size = 1 << (n + len(w) - 2).bit_length()
        both = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(w, size), axis=1)
        start = (len(w) - 1) // 2
        out.append(both[:, start : start + n])
    return np.stack(out, axis=1)


def wavelet_power(x: np.ndarray, freqs: list[float], fs: float, width: int = 5) -> np.ndarray:
    """Mean power of each row at each frequency; wavelets longer than the rows count too."""
    n, out = x.shape[1], []
    for f in freqs:
        wide = np.pad(x, ((0, 0), (0, max(0, len(morlet(f, fs, width)) - n))))
        out.append((np.abs(wavelets(wide, [f], fs, width)[:, 0, :n]) ** 2).mean(1))
    return np.stack(out, axis=1)


#: Low-pass taps of orthogonal wavelets (fixed values).
LOW_TAPS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db3": (0.3326705529500825, 0.8068915093110924, 0.4598775021184914, -0.1350110200102546, -0.0854412738820267, 0.0352262918857095),
}


def _responses(taps: tuple[float, ...], n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency responses of the low and the high pass, spread out for a level."""
    low = np.zeros(n)
    high = np.zeros(n)
    for k, tap in enumerate(taps):
        low[(k << level) % n] += tap
        high[(k << level) % n] += (-1) ** k * taps[len(taps) - 1 - k]
    return np.fft.fft(low), np.fft.fft(high)


def stationary(x: np.ndarray, levels: int, wavelet: str = "db3") -> list[np.ndarray]:
    """Undecimated transform of rows, taken as circular: the details of each level, then what
    is left. Lengths must be multiples of 2 ** levels."""
    n = x.shape[1]
    if n % (1 << levels):
        raise ValueError(f"{n} samples are no multiple of {1 << levels}")
    rest, out = np.fft.fft(x, axis=1), []
    for level in range(levels):
        low, high = _responses(LOW_TAPS[wavelet], n, level)
        out.append(np.real(np.fft.ifft(rest * high, axis=1)))
        rest = rest * low
    return [*out, np.real(np.fft.ifft(rest, axis=1))]


def inverse_stationary(parts: list[np.ndarray], wavelet: str = "db3") -> np.ndarray:
    """The rows that stationary() took apart."""
    *details, rest = (np.fft.fft(p, axis=1) for p in parts)
    for level in reversed(range(len(details))):
        low, high = _responses(LOW_TAPS[wavelet], rest.shape[1], level)
        rest = (rest * low.conj() + details[level] * high.conj()) / 2
    return np.real(np.fft.ifft(rest, axis=1))


def without_buffer(x: np.ndarray, fs: float, seconds: float) -> np.ndarray:
    """Rows less a stretch at either end; ValueError for a negative or too long one."""
    n = round(seconds * fs)
    if n < 0 or 2 * n >= x.shape[1]:
        raise ValueError(f"cannot take {n} samples from both ends of {x.shape[1]}")
    return x[:, n : x.shape[1] - n]


def cepstrum(x: np.ndarray, fs: float, fastest: float = 400.0) -> np.ndarray:
    """First half of the cepstrum of rows, without periods shorter than `fastest` a minute."""
    found = np.abs(np.fft.ifft(np.log(np.abs(np.fft.fft(x, axis=1)) + 1e-300), axis=1))[:, : x.shape[1] // 2]
    found[:, : int(60.0 / fastest * fs)] = 0
    return found


def linear_phase(taps: int, bands: list[tuple[float, float, float, float]], fs: float) -> np.ndarray:
    """Taps (an odd number) of the symmetric filter whose gain is nearest, by weighted squares,
    to that of bands (from, to, gain, weight) in Hz."""
    if taps % 2 == 0:
        raise ValueError("the number of taps must be odd")
    grid = [(f, gain, math.sqrt(weight)) for low, high, gain, weight in bands for f in np.linspace(low, high, 16 * taps)]
    f, gain, weight = map(np.array, zip(*grid))
    rows = np.cos(2 * math.pi * np.outer(f / fs, np.arange(taps // 2 + 1)))
    half = np.linalg.lstsq(rows * weight[:, None], gain * weight, rcond=None)[0]
    return np.r_[half[:0:-1] / 2, half[0], half[1:] / 2]


def running_averages(x: np.ndarray, fast: float = 0.5, slow: float = 0.975) -> np.ndarray:
    """Product over two of fast averages about slow ones, forwards and backwards, of rows."""

    def forward(rows: np.ndarray) -> np.ndarray:
        quick, steady = np.zeros(len(rows)), rows[:, :10].mean(1)
        out = np.empty(rows.shape)
        for t in range(rows.shape[1]):
            quick = fast * quick + (1 - fast) * (rows[:, t] - steady)
            steady = slow * steady + (1 - slow) * rows[:, t]
            out[:, t] = quick
        return out

    return forward(x) * forward(x[:, ::-1])[:, ::-1] / 2


def blinks(x: np.ndarray, reach: int) -> np.ndarray:
    """Samples of each row within `reach` of one where the running averages exceed their deviation."""
    size = np.abs(running_averages(x))
    over = size > size.std(1, keepdims=True)
    near = np.stack([np.convolve(r, np.ones(2 * reach + 1), "same") > 0 for r in over.astype(float)])
    return near.sum(1)


def approximate_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    """Difference of the mean log shares of like templates of m and m + 1 samples, each
    template like itself."""
    r = share * x.std()

    def phi(k: int) -> float:
        far = np.zeros((len(x) - k + 1,) * 2)
        for i in range(k):
            part = x[i : len(x) - k + 1 + i]
            far = np.maximum(far, np.abs(part[:, None] - part))
        return float(np.log((far <= r).mean(1)).mean())

    return phi(m) - phi(m + 1)


def lyapunov(x: np.ndarray, lag: int, dim: int, fs: float, apart: int) -> float:
    """Slope of the mean log distance of nearest neighbours (over `apart` samples from one
    another) as both move on."""
    rows = np.stack([x[i * lag : len(x) - (dim - 1 - i) * lag] for i in range(dim)], axis=1)
    n = len(rows)
    far = np.sqrt(((rows[:, None] - rows) ** 2).sum(2))
    far[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= apart] = np.inf
    near = far.argmin(1)
    logs = []
    for k in range(1, n // 2):
        i = np.flatnonzero((np.arange(n) + k < n) & (near + k < n))
        d = np.sqrt(((rows[i + k] - rows[near[i] + k]) ** 2).sum(1))
        if (d > 0).any():
            logs.append((k / fs, np.log(d[d > 0]).mean()))
    return float(np.polyfit(*zip(*logs), 1)[0]) if len(logs) > 1 else 0.0


def resonance(x: np.ndarray) -> np.ndarray:
    """Rows through the 14.6 Hz resonator of the beat counts, at 250 samples a second."""
    y = np.zeros(x.shape)
    for t in range(2, x.shape[1]):
        y[:, t] = (14 * y[:, t - 1] - 7 * y[:, t - 2] + (x[:, t] - x[:, t - 2]) / 2) / 8
    return y


def resonance_counts(x: np.ndarray, fs: int, kind: int) -> np.ndarray:
    """Samples of the resonator's output, second by second, over half the largest (1), over
    the mean (2), or within the mean deviation of the mean (3)."""
    y = resonance(resample(x, x.shape[1] * 250 // fs) if fs != 250 else x)
    total = np.zeros(len(y))
    for start in range(0, y.shape[1], 250):
        part = y[:, start : start + 250]
        mid = part.mean(1, keepdims=True)
        dev = np.abs(part - mid).mean(1, keepdims=True)
        on = {1: part >= 0.5 * part.max(1, keepdims=True), 2: part >= mid, 3: (part >= mid - dev) & (part <= mid + dev)}[kind]
        total += on.sum(1)
    return total


def decimate(x: np.ndarray, step: int, fs: float) -> np.ndarray:
    """Every step-th sample of the rows after a low pass."""
    return zero_phase(*butterworth(8, 0.8 * fs / 2 / step, fs), x)[:, ::step]


def band_envelope(x: np.ndarray, low: float, high: float, fs: float) -> np.ndarray:
    """Mean power of the analytic signal of each row within a band of frequencies."""
    n = x.shape[1]
    f = np.fft.fftfreq(n, 1 / fs)
    pair = np.fft.ifft(np.fft.fft(x, axis=1) * np.where((f >= low) & (f < high), 2.0, 0.0), axis=1)
    return (np.abs(pair) ** 2).mean(1)
