import numpy as np
import pytest
from hypothesis import given, settings, strategies as s

from pulseloom.functions import dsp

RNG = np.random.default_rng(0)
SIGNALS = RNG.standard_normal((5, 128))


def tone(bin_, n=128, fps=30.0):
    return np.sin(2 * np.pi * bin_ * np.arange(n) / n)[None]


def response(b, a, hz, fps=30.0):
    z = np.exp(-2j * np.pi * np.asarray(hz) / fps)
    return np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("stop", [False, True])
def test_butterworth_edges_and_centre(order, stop):
    b, a = dsp.design("butter", order, 0.8, 2.5, 30.0, stop)
    assert len(b) == len(a) == 2 * order + 1 and a[0] == pytest.approx(1)
    assert response(b, a, [0.8, 2.5]) == pytest.approx([np.sqrt(0.5)] * 2, rel=1e-6)
    assert response(b, a, [0.0])[0] == pytest.approx(float(stop), abs=1e-6)
    warp = lambda f: np.tan(np.pi * f / 30)
    centre = np.arctan(np.sqrt(warp(0.8) * warp(2.5))) * 30 / np.pi
    assert response(b, a, [centre])[0] == pytest.approx(float(not stop), abs=1e-6)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("stop", [False, True])
def test_chebyshev_stop_band(order, stop):
    b, a = dsp.design("cheby2", order, 0.8, 2.5, 30.0, stop, 50.0)
    level = 10 ** (-50 / 20)
    assert response(b, a, [0.8, 2.5]) == pytest.approx([level] * 2, rel=1e-4)
    blocked = np.linspace(0.8, 2.5, 50) if stop else np.concatenate([np.linspace(0, 0.8, 30), np.linspace(2.5, 15, 50)])
    assert response(b, a, blocked).max() <= level * 1.001


def test_filtfilt_against_loops():
    b, a = dsp.design("butter", 2, 0.8, 2.5, 30.0, False)

    def once(x, zi):
        z, y = list(zi), []
        for v in x:
            out = b[0] * v + z[0]
            for k in range(len(z) - 1):
                z[k] = z[k + 1] + b[k + 1] * v - a[k + 1] * out
            z[-1] = b[-1] * v - a[-1] * out
            y.append(out)
        return np.array(y)

    zi = dsp.steady_state(b, a)
    for x in SIGNALS:
        pad = 3 * len(a)
        long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        y = once(long, zi * long[0])
        y = once(y[::-1], zi * y[-1])[::-1][pad:-pad]
        assert dsp.filtfilt(b, a, x[None])[0] == pytest.approx(y, abs=1e-12)
    constant = np.full((1, 128), 3.0)
    b, a = dsp.design("butter", 2, 0.8, 2.5, 30.0, True)
    assert dsp.filtfilt(b, a, constant) == pytest.approx(constant, abs=1e-8)
    with pytest.raises(ValueError):
        dsp.filtfilt(b, a, SIGNALS[:, :10])


def test_band_filters_are_complements():
    kept, cut = dsp.band_filter(SIGNALS, 0.8, 2.5, 30, False), dsp.band_filter(SIGNALS, 0.8, 2.5, 30, True)
    assert kept + cut == pytest.approx(SIGNALS)


def test_rates_of_a_tone():
    assert dsp.peak_rate(tone(6), 30)[0] == pytest.approx(84.375)
    assert dsp.peak_rate(tone(6), 30, compat=True)[0] == pytest.approx(5 * 30 / 128 * 60)
    assert dsp.interval_rate(tone(6), 30)[0] == pytest.approx(84.375, rel=0.03)
    assert dsp.instantaneous_rate(dsp.analytic(tone(6)), 30)[0] == pytest.approx(84.375 * 127 / 128, rel=1e-6)
    assert np.abs(dsp.envelope_normal(3 * tone(6))) == pytest.approx(np.abs(tone(6)), abs=1e-6)


@pytest.mark.parametrize("x, distance, want", [([0, 1, 0, 2, 0], 1, [1, 3]), ([0, 1, 0, 2, 0], 3, [3]), ([0, 1, 1, 1, 0], 1, [2]), ([1, 1, 1], 1, []), ([3, 2, 1], 1, []), ([0, 2, 0, 2, 0], 4, [3])])
def test_peaks(x, distance, want):
    assert dsp.find_peaks(np.array(x, float), distance).tolist() == want


@pytest.mark.parametrize("name", ["haar", "db2", "db3", "db4", "db8", "sym3", *(f"{f}{n}" for f in ("bior", "rbio") for n in dsp.SPLINES)])
@pytest.mark.parametrize("n", [16, 50, 127, 128])
def test_wavelets_reconstruct(name, n):
    x = RNG.standard_normal((3, n))
    coefficients, sizes = dsp.decompose(x, name)
    assert dsp.recompose(coefficients, sizes, name) == pytest.approx(x, abs=1e-8)


def test_daubechies_two_taps_and_moments():
    r3 = np.sqrt(3)
    want = np.array([1 + r3, 3 + r3, 3 - r3, 1 - r3]) / (4 * np.sqrt(2))
    assert dsp.wavelet("db2")[2] == pytest.approx(want)
    for n in range(1, 9):
        low = dsp.wavelet(f"db{n}")[0]
        assert low @ low == pytest.approx(1, abs=1e-6) and dsp.wavelet(f"db{n}")[1].sum() == pytest.approx(0, abs=1e-6)


def test_biorthogonal_values():
    half = 1 / (2 * np.sqrt(2))
    assert dsp.wavelet("bior2.2")[0] == pytest.approx(np.array([0, -0.5, 1, 3, 1, -0.5]) * half)
    assert dsp.wavelet("bior2.2")[2] == pytest.approx(np.array([0, 1, 2, 1, 0, 0]) * half)
    assert dsp.wavelet("bior4.4")[0][5] == pytest.approx(0.8526986790088938) and dsp.wavelet("bior4.4")[2][4] == pytest.approx(0.7884856164055829)
    assert dsp.wavelet("rbio2.2")[0] == pytest.approx(dsp.wavelet("bior2.2")[2][::-1])


def test_denoising_helps():
    clean = tone(4)
    noisy = clean + 0.3 * RNG.standard_normal(clean.shape)
    assert ((dsp.wavelet_denoise(noisy, "db4", 1) - clean) ** 2).mean() < 0.8 * ((noisy - clean) ** 2).mean()


def test_modes_add_up_and_find_the_pulse():
    x = tone(6)[0] + 0.5 * tone(25)[0]
    modes = dsp.empirical_modes(x)
    assert 1 <= len(modes) <= 8
    _, rate = dsp.hilbert_huang(x[None], 30)
    assert abs(rate[0] - 84.4) < 12


@pytest.mark.parametrize("method", dsp.FILTERS)
def test_all_filters_run(method):
    y, rate = dsp.apply_filter(SIGNALS, method)
    assert y.shape == SIGNALS.shape and np.isfinite(y).all() and np.isfinite(rate).all()


def test_unknown_names():
    for call in (lambda: dsp.apply_filter(SIGNALS, "no"), lambda: dsp.snr(SIGNALS, SIGNALS, "no"), lambda: dsp.wavelet("no")):
        with pytest.raises(ValueError):
            call()


def test_snr_sentinels_and_methods():
    x = SIGNALS
    assert (dsp.snr(0 * x, x) == 0).all() and (dsp.snr(x, x) == 1000).all()
    y = 0.5 * x
    assert dsp.snr(y, x, "ratio") == pytest.approx(np.ones(5)) and dsp.snr(y, x) == pytest.approx(np.zeros(5), abs=1e-12)
    assert dsp.snr(y, x, "voltage") == pytest.approx(dsp.snr(y, x, "power"))


@settings(max_examples=30, deadline=None)
@given(s.floats(0.1, 0.9))
def test_snr_is_monotone(share):
    x = SIGNALS
    noise = RNG.standard_normal(x.shape) * 0.01
    assert (dsp.snr(x - share * noise, x, "ratio") > dsp.snr(x - noise, x, "ratio")).all()


def test_batched_peaks_and_rates_as_one_by_one():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((200, 64)), rng.integers(0, 3, (200, 64)).astype(float), np.zeros((1, 64)), np.ones((1, 64)).cumsum(-1)])
    mask = dsp.peak_mask(x)
    for k, own in enumerate(x):
        assert np.flatnonzero(mask[k]).tolist() == dsp.find_peaks(own, 1).tolist()
    want = []
    for own in x:
        peaks = dsp.find_peaks(own, 15)
        want.append(60 * 30 / np.diff(peaks).mean() if len(peaks) > 1 else 0)
    assert dsp.interval_rate(x, 30) == pytest.approx(want)


def test_covers_pass_through_their_peaks_and_solve_the_spline_system():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 64))
    mask = dsp.peak_mask(x)
    cover = dsp._cover(x, mask)
    assert cover[mask] == pytest.approx(x[mask])
    for own, peaks, got in zip(x, mask, cover):
        at = np.flatnonzero(peaks)
        at, values = np.array([-at[0] - 1, *at, 2 * 63 - at[-1] + 1], float), np.array([own[at[0]], *own[at], own[at[-1]]])
        h, m = np.diff(at), len(at)
        system, right = np.eye(m), np.zeros(m)
        for i in range(1, m - 1):
            system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((values[i + 1] - values[i]) / h[i] - (values[i] - values[i - 1]) / h[i - 1])
        bend = np.linalg.solve(system, right)
        for t in range(64):
            k = np.searchsorted(at, t, "right") - 1
            u, w = t - at[k], at[k + 1] - t
            want = (bend[k] * w**3 + bend[k + 1] * u**3) / (6 * h[k]) + (values[k] / h[k] - bend[k] * h[k] / 6) * w + (values[k + 1] / h[k] - bend[k + 1] * h[k] / 6) * u
            assert got[t] == pytest.approx(want, abs=1e-9)


def test_modes_of_many_signals_are_those_of_each():
    x = np.concatenate([SIGNALS, np.zeros((1, 128)), tone(3)])
    together, rates = dsp.hilbert_huang(x, 30)
    for k, own in enumerate(x):
        alone, rate = dsp.hilbert_huang(own[None], 30)
        assert together[k] == pytest.approx(alone[0], abs=1e-8) and rates[k] == pytest.approx(rate[0], abs=1e-6)
