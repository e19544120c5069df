import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as K

FS = 200
T = np.arange(4 * FS) / FS


def sine(f):
    return np.sin(2 * math.pi * f * T)


def test_butterworth_gain():
    for order, cutoff in ((5, 30.0), (4, 10.0)):
        b, a = K.butterworth(order, cutoff, FS)
        gain = lambda f: abs(np.polyval(b, np.exp(2j * math.pi * f / FS)) / np.polyval(a, np.exp(2j * math.pi * f / FS)))
        assert gain(0) == pytest.approx(1) and gain(cutoff) == pytest.approx(math.sqrt(0.5)) and gain(80) < 0.01
    b, a = K.butterworth(3, 20.0, FS, "high")
    assert abs(b.sum()) < 1e-9 and abs(np.polyval(b, -1) / np.polyval(a, -1)) == pytest.approx(1)


def test_zero_phase_keeps_and_removes():
    b, a = K.butterworth(5, 30.0, FS)
    out = K.zero_phase(b, a, np.stack([sine(5), sine(90), np.ones_like(T)]))
    assert np.abs(out[0] - sine(5)).max() < 0.01 and np.abs(out[1][50:-50]).max() < 1e-3 and np.allclose(out[2], 1)
    assert np.abs(K.without_drift(np.stack([sine(20) + 5]), FS)[0] - sine(20))[200:-200].max() < 0.1


def test_resample_sines():
    x = np.stack([sine(10), sine(5)])
    for n in (400, 1600):
        t = np.arange(n) * 4 / n
        assert np.allclose(K.resample(x, n), np.stack([np.sin(2 * math.pi * f * t) for f in (10, 5)]), atol=1e-9)


def test_lempel_ziv_by_hand():
    # 1 | 11110 | 1101 and a last word that the end cuts short
    bits = np.array([1, 1, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1])
    assert K.lempel_ziv(bits) == pytest.approx(3 * math.log2(12) / 12)
    assert K.lempel_ziv(np.array([0, 1])) == pytest.approx(1)


def test_sample_entropy_brute():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(80)
    r, m = 0.2 * x.std(), 2

    def close(i, j, n):
        return all(abs(x[i + k] - x[j + k]) <= r for k in range(n))

    short = sum(close(i, j, m) for i in range(79) for j in range(79) if i != j)
    long = sum(close(i, j, m + 1) for i in range(78) for j in range(78) if i != j)
    assert K.sample_entropy(x) == pytest.approx(math.log(short / long))


def test_shapes_of_features():
    assert K.taper(100, 0.2)[0] == 0 and K.taper(100, 0.2)[50] == 1
    assert K.threshold_crossings(np.ones(8 * FS), FS) > 90
    assert K.peak_amplitude(sine(5) * 3, FS) == pytest.approx(6, rel=0.01)
    assert K.hilbert_cells(np.stack([sine(5), np.random.default_rng(0).standard_normal(len(T))]))[0] < 0.12
    walk = np.random.default_rng(0).standard_normal(4096)
    assert K.detrended_fluctuation(walk, [8, 16, 32, 64, 128]) == pytest.approx(0.5, abs=0.1)
    assert K.detrended_fluctuation(np.cumsum(walk), [8, 16, 32, 64, 128]) == pytest.approx(1.5, abs=0.15)
    assert K.higuchi(T, 8) == pytest.approx(1, abs=0.02) and K.higuchi(walk, 8) == pytest.approx(2, abs=0.1)
    assert K.hurst(walk) == pytest.approx(0.55, abs=0.15)
    power = K.wavelet_power(np.stack([sine(8)]), [4.0, 8.0, 16.0], FS)[0]
    assert power.argmax() == 1


def test_lifts_need_a_rise():
    x = np.zeros(400)
    x[[50, 150, 250]] = 1
    assert K.lifted_exponential(x, FS) == pytest.approx(1 / 2)  # a spike is itself the crossing; the next one lifts


def test_modes_add_up():
    from pulsegrid.functions import modes as D

    t = np.linspace(0, 30 * math.pi, 1000)
    x = np.sin(t) + np.sin(t / 2) + np.sin(t / 4)
    found = D.decompose(x, 5)
    assert np.allclose(found.sum(0), x) and len(found) >= 3
    assert abs(np.corrcoef(found[0][100:-100], np.sin(t)[100:-100])[0, 1]) > 0.9
    assert D.maxima(np.array([0, 2, 2, 2, 0, 1, 0])).tolist() == [2, 5]
    assert D.waves(sine(10), FS) == pytest.approx((1, 10), rel=0.02)
    assert len(D.mode_features(x, 10.0)) == 7


def test_chaos():
    rng = np.random.default_rng(3)
    noise, wave = rng.standard_normal(300), np.sin(np.arange(300) / 5)
    assert K.approximate_entropy(noise) > K.approximate_entropy(wave)
    logistic = [0.3]
    for _ in range(299):
        logistic.append(4 * logistic[-1] * (1 - logistic[-1]))
    assert K.lyapunov(np.array(logistic), 1, 2, 1.0, 5) > K.lyapunov(wave, 1, 2, 1.0, 5)
    assert K.band_envelope(np.stack([sine(5)]), 4, 6, FS)[0] == pytest.approx(1, rel=0.01)
    assert np.abs(K.decimate(np.stack([sine(5)]), 4, FS)[0] - sine(5)[::4])[20:-20].max() < 0.05
    assert K.resonance_counts(np.stack([sine(14.6)]), FS, 2)[0] == pytest.approx(500, abs=30)


def gain_of(b, a, f, fs=FS):
    z = np.exp(2j * math.pi * f / fs)
    return abs(np.polyval(b, z) / np.polyval(a, z))


def test_band_pass_and_stop():
    for order in (2, 4):
        b, a = K.butterworth(order, (10.0, 20.0), FS, "pass")
        assert [gain_of(b, a, f) for f in (10, 20)] == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6) and gain_of(b, a, 14.2) > 0.99
        assert gain_of(b, a, 1) < 0.01 and gain_of(b, a, 80) < 0.01
        b, a = K.butterworth(order, (10.0, 20.0), FS, "stop")
        assert [gain_of(b, a, f) for f in (10, 20)] == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6) and gain_of(b, a, 14.2) < 0.01
        assert gain_of(b, a, 0) == pytest.approx(1) and gain_of(b, a, 99) > 0.99
    b, a = K.butterworth(4, (8.0, 20.0), FS, "stop")
    out = K.zero_phase(b, a, np.stack([sine(12), sine(5)]))
    assert np.abs(out[0][200:-200]).max() < 0.02 and np.abs(out[1] - sine(5))[200:-200].max() < 0.2


def test_resample_keeps_shared_samples():
    x = np.random.default_rng(2).standard_normal((3, 64))
    assert np.allclose(K.resample(x, 128)[:, ::2], x) and np.allclose(K.resample(x, 64), x)


def test_buffers():
    x = np.stack([sine(10), sine(5)])
    assert K.without_buffer(x, FS, 1).shape == (2, 2 * FS) and np.array_equal(K.without_buffer(x, FS, 1), x[:, FS:-FS])
    assert K.without_buffer(x, FS, 0).shape == x.shape
    for bad in (-1, 2):
        with pytest.raises(ValueError):
            K.without_buffer(x, FS, bad)


@pytest.mark.parametrize("wavelet", ["haar", "db3"])
def test_stationary_transform_comes_back(wavelet):
    x = np.random.default_rng(3).standard_normal((4, 128))
    parts = K.stationary(x, 4, wavelet)
    assert len(parts) == 5 and np.allclose(K.inverse_stationary(parts, wavelet), x)
    flat = K.stationary(np.ones((1, 16)), 2, wavelet)
    assert np.allclose(flat[0], 0) and np.allclose(flat[2], 2)
    with pytest.raises(ValueError):
        K.stationary(x[:, :100], 4)


def test_wavelet_phase_and_power():
    ramp = np.tile(np.arange(1000.0), (2, 1))
    found = K.wavelets(ramp, [10.0, 60.0], 100)
    assert found.shape == (2, 2, 1000) and np.allclose(found[0], found[1])
    x = np.stack([sine(10), np.cos(2 * math.pi * 10 * T)])
    mid = np.angle(K.wavelets(x, [10.0], FS)[:, 0, 300:500])
    assert np.allclose(np.angle(np.exp(1j * (mid[1] - mid[0]))), math.pi / 2, atol=1e-3)
    assert len(K.morlet(5.0, FS)) > len(K.morlet(10.0, FS)) and len(K.morlet(5.0, FS, 7)) > len(K.morlet(5.0, FS, 5))
    with pytest.raises(ValueError):
        K.wavelets(x[:, :20], [1.0], FS)


def test_linear_phase_filter_and_cepstrum():
    taps = K.linear_phase(61, [(0, 20, 1, 1), (30, 100, 0, 10)], FS)
    assert np.allclose(taps, taps[::-1]) and len(taps) == 61
    assert gain_of(taps, [1], 10) == pytest.approx(1, abs=0.02) and gain_of(taps, [1], 50) < 0.02
    beat = np.zeros((1, 800))
    beat[0, ::160] = 1.0
    smooth = K.zero_phase(*K.butterworth(2, 30.0, FS), beat) + 0.01 * np.random.default_rng(1).standard_normal(beat.shape)
    assert K.cepstrum(smooth, FS)[0, :30].max() == 0 and abs(K.cepstrum(smooth, FS)[0].argmax() - 160) <= 2


def test_running_averages_find_a_blink():
    x = np.zeros((1, 200))
    x[0, 100:104] = 5
    found = np.abs(K.running_averages(x))[0]
    assert 98 <= found.argmax() <= 106 and 4 <= K.blinks(x, 2)[0] < 30


def test_ensemble_modes_average_the_noise_away():
    from pulsegrid.functions import modes

    x = sine(3) + 0.5 * sine(20)
    found = modes.ensemble(x, times=30, noise=0.1)
    assert found.shape == (6, len(x)) and np.abs(found.sum(0) - x).max() < 0.12 * x.std()
    assert np.array_equal(found, modes.ensemble(x, times=30, noise=0.1))


def test_complexity_of_long_signals_is_counted_in_good_time():
    """A quadratic search takes minutes here."""
    rng = np.random.default_rng(3)
    start = time.monotonic()
    assert K.lempel_ziv(rng.integers(0, 2, 400_000)) == pytest.approx(1, abs=0.1)
    assert K.lempel_ziv(np.zeros(400_000)) < 0.001
    assert time.monotonic() - start < 15


def test_job_segments_are_dealt_over_all_tasks(spark):
    from pulsegrid.plans import kernels as P

    rows = P.job_segments(spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() == 4
