"""Signal features of array<double> columns as plain column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Body = Callable[[Column], Column]


def let(value: Column, body: Body) -> Column:
    """body(value), with value computed once however often body reads it."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def squares(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)


def centred(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def min_max(x: Column) -> Column:
    """Scaled to 0..1; a constant series becomes zeros."""
    ends = F.struct(F.array_min(x).alias("low"), (F.array_max(x) - F.array_min(x)).alias("range"))
    return let(ends, lambda e: F.transform(x, lambda v: F.coalesce(F.try_divide(v - e["low"], e["range"]), F.lit(0.0))))


def moving_average(x: Column, order: int = 5) -> Column:
    """Centred, zeros beyond the ends, always divided by the order."""
    half = order // 2

    def at(i: Column) -> Column:
        first = F.greatest(i - half, F.lit(0))
        return total(F.slice(x, first + 1, F.least(i + half, F.size(x) - 1) - first + 1)) / order

    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), at)


def phase_space(x: Column, lag: int, cells: int = 40) -> Column:
    """Share of a grid of cells that the points (x[t], x[t + lag]) visit."""
    grid = lambda v: F.floor(v * (cells - 1)).cast("int")
    points = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - lag), F.slice(s, lag + 1, F.size(s) - lag), lambda a, b: grid(a) * cells + grid(b))
    return let(min_max(x), lambda s: F.size(F.array_distinct(points(s)))) / (cells * cells)


def exponential_crossings(x: Column, fs: float, seconds: float = 3.0) -> Column:
    """Crossings a second of the curve M exp(-|t - tm| / tau) through the largest sample.
    Touching it changes nothing, and the last sample is not looked at."""
    peak = F.struct(F.array_max(x).alias("m"), (F.array_position(x, F.array_max(x)) - 1).alias("at"))

    def count(p: Column) -> Column:
        curve = lambda t: p["m"] * F.exp(-F.abs(t - p["at"]) / (seconds * fs))
        start = F.struct((x[0] > curve(F.lit(0))).alias("up"), F.lit(0).alias("n"))

        def step(acc: Column, t: Column) -> Column:
            crossed = F.when(acc["up"], x[t] < curve(t)).otherwise(x[t] > curve(t))
            return F.struct((acc["up"] != crossed).alias("up"), (acc["n"] + crossed.cast("int")).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.size(x) - 2), start, step, lambda acc: acc["n"])

    return let(peak, count) / (F.size(x) / fs)


def mean_absolute_value(x: Column, fs: int, seconds: int = 2) -> Column:
    """Mean over windows a second apart of the mean of |x| over the window's largest |x|."""
    size = fs * seconds
    starts = F.sequence(F.lit(0), F.size(x) - size, F.lit(fs))
    window = lambda i: F.transform(F.slice(x, i + 1, size), F.abs)
    return mean(F.transform(starts, lambda i: let(window(i), lambda w: F.try_divide(mean(w), F.array_max(w)))))


def hjorth(x: Column) -> Column:
    """(mobility, complexity); the first difference counts from zero."""

    def of(d: Column) -> Column:
        n = F.size(x)
        parts = F.struct((squares(d) / n).alias("m2"), squares(x).alias("tp"), (squares(differences(d)) / n).alias("m4"))
        mobility = lambda p: F.sqrt(F.try_divide(p["m2"], p["tp"]))
        complexity = lambda p: F.sqrt(F.try_divide(p["m4"] * p["tp"], p["m2"] * p["m2"]))
        return let(parts, lambda p: F.struct(mobility(p).alias("mobility"), complexity(p).alias("complexity")))

    return let(F.concat(F.slice(x, 1, 1), differences(x)), of)


def sign_changes(x: Column) -> Column:
    d = differences(x)
    return let(d, lambda d: F.size(F.filter(F.zip_with(F.slice(d, 2, F.size(d) - 1), F.slice(d, 1, F.size(d) - 1), lambda b, a: a * b), lambda p: p < 0)))


def petrosian(x: Column) -> Column:
    n = F.size(x)
    return F.log10(n) / (F.log10(n) + F.log10(1 + 0.4 * sign_changes(x)))


def weighted_index(a: Column) -> Column:
    """Sum of index times value."""
    return total(F.transform(a, lambda v, i: v * i))


def central_frequency(amplitudes: Column, n: int, fs: float) -> Column:
    """Mean frequency, weighted by power, in Hz."""
    return let(F.transform(amplitudes, lambda v: v * v), lambda p: F.try_divide(weighted_index(p), total(p)) * (fs / n))


def spectral_shape(amplitudes: Column, n: int, fs: float) -> Column:
    """(moment, a2): the first moment over the peak frequency (0.5 to 9 Hz), of amplitudes
    of 5 % of the peak or more up to the lesser of 20 peaks and 100 Hz; and the share of
    amplitude strictly between 0.7 and 1.4 peaks."""
    low, high = math.floor(0.5 / fs * n + 1e-9) + 1, min(math.ceil(9.0 / fs * n - 1e-9), math.ceil(n / 2))

    def of(peak: Column) -> Column:
        at = F.array_position(F.slice(amplitudes, low + 1, high - low), peak) - 1 + low

        def shape(k: Column) -> Column:
            kept = F.transform(amplitudes, lambda v, i: F.when((v >= 0.05 * peak) & (i < F.least(20 * k, F.lit(100.0 / fs * n))), v).otherwise(0.0))
            near = lambda a: total(F.transform(a, lambda v, i: F.when((i > 0.7 * k) & (i < 1.4 * k), v).otherwise(0.0)))
            return let(kept, lambda a: F.struct((F.try_divide(weighted_index(a), total(a)) / k).alias("moment"), F.try_divide(near(a), total(a)).alias("a2")))

        return let(at, shape)

    return let(F.array_max(F.slice(amplitudes, low + 1, high - low)), of)


def band_powers(amplitudes: Column, edges: list[float], n: int, fs: float) -> Column:
    """Sums of amplitudes from each edge (Hz) up to the next."""
    cuts = [math.floor(e / fs * n) for e in edges]
    return F.array(*(total(F.slice(amplitudes, a + 1, b - a)) for a, b in zip(cuts, cuts[1:])))


def spectral_entropy(powers: Column, bands: int) -> Column:
    """Entropy of the bands' shares over that of even ones; the last band is left out."""
    shares = lambda p: F.transform(F.slice(p, 1, bands - 1), lambda v: v / total(p))
    return let(powers, lambda p: -total(F.transform(shares(p), lambda r: r * F.ln(r)))) / math.log(bands)


def half_period_leak(x: Column, amplitudes: Column, n: int) -> Column:
    """Residue of adding the signal to itself half a period of its strongest wave later."""

    def of(k: Column) -> Column:
        half = F.when(k > 0, F.floor(F.lit(n) / k / 2)).otherwise(F.lit(n // 2)).cast("int")
        pairs = lambda h: F.zip_with(F.slice(x, h + 1, n - h), F.slice(x, 1, n - h), lambda a, b: F.struct(F.abs(a + b).alias("both"), (F.abs(a) + F.abs(b)).alias("each")))
        return let(pairs(half), lambda p: F.try_divide(total(F.transform(p, lambda v: v["both"])), total(F.transform(p, lambda v: v["each"]))))

    return let(F.array_position(amplitudes, F.array_max(amplitudes)) - 1, of)


def ordinal_patterns(x: Column, lag: int = 1) -> Column:
    """The order of every three samples `lag` apart, as a string of their ranks."""
    rank = lambda a, b, c: F.concat((F.when(a > b, 1).otherwise(0) + F.when(a > c, 1).otherwise(0)).cast("string"), (F.when(b >= a, 1).otherwise(0) + F.when(b > c, 1).otherwise(0)).cast("string"))
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1 - 2 * lag), lambda i: rank(x[i], x[i + lag], x[i + 2 * lag]))


def permutation_entropy(x: Column, lag: int = 1) -> Column:
    """Bits of the distribution of ordinal patterns of three samples."""
    share = lambda p, k: F.size(F.filter(p, lambda v: v == k)) / F.size(p)
    return let(ordinal_patterns(x, lag), lambda p: -total(F.transform(F.array_distinct(p), lambda k: let(share(p, k), lambda s: s * F.log2(s)))))


def pulses(w: Column, share: float = 0.2) -> Column:
    """(head, tail, n) of a second of samples: samples before the first rise over a share of
    its largest, samples from the last fall on (none if it never fell), and rises. Without
    a rise head and tail are the whole second."""

    def of(limit: Column) -> Column:
        start = F.struct(F.lit(False).alias("up"), F.lit(0).alias("i"), F.lit(-1).alias("rise"), F.lit(-1).alias("fall"), F.lit(0).alias("n"))

        def step(acc: Column, v: Column) -> Column:
            up = v > limit
            rises, falls = up & ~acc["up"], ~up & acc["up"]
            return F.struct(
                up.alias("up"), (acc["i"] + 1).alias("i"), F.when(rises & (acc["rise"] < 0), acc["i"]).otherwise(acc["rise"]).alias("rise"),
                F.when(falls, acc["i"]).otherwise(acc["fall"]).alias("fall"), (acc["n"] + rises.cast("int")).alias("n"),
            )

        def ends(acc: Column) -> Column:
            tail = F.when(acc["n"] == 0, acc["i"]).when(acc["fall"] < 0, 0).otherwise(acc["i"] - acc["fall"])
            return F.struct(F.when(acc["n"] == 0, acc["i"]).otherwise(acc["rise"]).alias("head"), tail.alias("tail"), acc["n"].alias("n"))

        return F.aggregate(w, start, step, ends)

    return let(F.array_max(w) * share, of)


def crossing_interval(x: Column, fs: int, share: float = 0.2) -> Column:
    """Mean over inner seconds of 1000 ms over their pulses, pulses cut by the second's edges
    counting by the part of the silence that is theirs; 1000 below three seconds."""
    seconds = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / fs).cast("int") - 1), lambda k: pulses(F.slice(x, k * fs + 1, fs), share))
    part = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))

    def interval(s: Column) -> Column:
        def one(k: Column) -> Column:
            n = s[k]["n"] - 1 + part(s[k]["head"], s[k - 1]["tail"]) + part(s[k]["tail"], s[k + 1]["head"])
            return let(n, lambda v: 1000.0 / F.when(v > 0, v).otherwise(1.0))

        inner = F.when(F.size(s) >= 3, F.sequence(F.lit(1), F.size(s) - 2))
        return F.coalesce(mean(F.transform(inner, one)), F.lit(1000.0))

    return let(seconds, interval)


def converted(x: Column, n: int, to: int) -> Column:
    """n samples to `to`, by straight lines between neighbours, ends kept."""

    def at(k: Column) -> Column:
        place = k * ((n - 1) / (to - 1))
        i = F.least(F.floor(place), F.lit(n - 2)).cast("int")
        return x[i] + (x[i + 1] - x[i]) * (place - i)

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at)


def first_match(x: Column, needle: Column, most: float) -> Column:
    """First place from which the series exceeds the needle by less than `most` all along;
    null if there is none. Only an excess counts, and the very last place is not tried."""
    size = F.size(needle)
    places = F.sequence(F.lit(0), F.size(x) - size - 1)
    excess = lambda i: F.array_max(F.zip_with(F.slice(x, i + 1, size), needle, lambda a, b: a - b))
    return F.get(F.filter(places, lambda i: excess(i) < most), F.lit(0))


#: Haar filters of the stationary transform (fixed values).
LOW, HIGH = (0.5**0.5, 0.5**0.5), (0.5**0.5, -(0.5**0.5))


def stationary_level(x: Column, n: int, level: int, taps: tuple[float, ...]) -> Column:
    """One level of the undecimated wavelet transform: the filter with 2^level - 1 gaps,
    wrapped around the ends."""
    step = 1 << level
    return F.transform(x, lambda v, i: sum((F.lit(h) * x[(i + k * step) % n] for k, h in enumerate(taps)), F.lit(0.0)))


def word_ranks(x: Column, bits: int) -> Column:
    """Array by word (rises and falls of `bits` steps, the first step lowest) of its share of
    the words and its rank by that, from 1; equally frequent words rank by their number."""
    total = F.size(x) - bits
    rises = F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: (F.get(x, i + 1) > F.get(x, i)).cast("int"))

    def of_rises(up: Column) -> Column:
        word = lambda i: sum((F.get(up, i + k) * (1 << k) for k in range(1, bits)), F.get(up, i))
        words = F.transform(F.sequence(F.lit(0), total - 1), word)
        return F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda k: F.size(F.filter(w, lambda v: v == k))))[0]

    def ranked(counts: Column) -> Column:
        ahead = lambda n, k: F.size(F.filter(F.transform(counts, lambda m, j: (m > n) | ((m == n) & (j < k))), lambda b: b))
        return F.transform(counts, lambda n, k: F.struct((n / total).alias("share"), (ahead(n, k) + 1).alias("rank")))

    counts = F.transform(F.array(rises), of_rises)[0]
    return F.transform(F.array(counts), ranked)[0]


def word_distance(x: Column, y: Column, bits: int) -> Column:
    """Mean difference of the words' ranks in two series, weighted by their entropies, over the
    largest rank but one: 0 for series of one ranking."""

    def told(p: Column) -> Column:
        return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)

    def apart(both: Column) -> Column:
        sums = F.aggregate(
            both, F.struct(F.lit(0.0).alias("far"), F.lit(0.0).alias("all")),
            lambda acc, w: F.struct((acc["far"] + w["far"] * w["weight"]).alias("far"), (acc["all"] + w["weight"]).alias("all")),
        )
        return F.transform(F.array(sums), lambda s: F.try_divide(s["far"], s["all"]))[0]

    both = F.zip_with(word_ranks(x, bits), word_ranks(y, bits), lambda a, b: F.struct(F.abs(a["rank"] - b["rank"]).cast("double").alias("far"), (told(a["share"]) + told(b["share"])).alias("weight")))
    return F.transform(F.array(both), apart)[0] / ((1 << bits) - 1)


def muscle_noise(x: Column, mark: int, average: int = 5) -> Column:
    """High-frequency noise around a beat, in percent of a quarter of its height: the largest sum of
    `average` second differences in a row, outside the beat itself. x: whole numbers, a hundred a
    second; mark: place of the beat, 30 samples or more from either end. Flat beats have 0."""
    at = lambda i: F.get(x, i)
    rough = F.transform(F.sequence(F.lit(mark - 28), F.lit(mark + 27)), lambda i: F.abs(at(i) - 2 * at(i - 1) + at(i - 2)))

    def summed(rough: Column) -> Column:
        sums = F.transform(rough, lambda _, k: F.aggregate(F.slice(rough, F.greatest(F.lit(1), k + 2 - average), F.least(k + 1, F.lit(average))), F.lit(0).cast("long"), lambda s, v: s + v))
        outside = F.filter(sums, lambda _, k: (k + (mark - 28) < mark - 5) | (k + (mark - 28) > mark + 11))
        return F.array_max(outside)

    most = F.element_at(F.transform(F.array(rough), summed), 1)
    beat = F.slice(x, mark - 7 + 1, 15)
    height = F.greatest(F.array_max(beat), F.lit(0)) - F.least(F.array_min(beat), F.lit(0))
    return F.when(height >= 4, F.floor(most * (50 // average) / F.shiftright(height.cast("long"), 2))).otherwise(0)
