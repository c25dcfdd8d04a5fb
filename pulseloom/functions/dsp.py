"""Signal kernels over batches: arrays of shape (signals, samples), float64.

Everything is written from the published definitions; recurrences run over time and are
vectorised over the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np

EPS = 1e-8

# Names of the filters, in their order; each also with _wt, _ht and _hht.
FILTER_BASES = ("bandstop", "bandpass", "cheby2_bandpass", "cheby2_bandstop", "fft_bandpass", "fft_bandstop")
FILTERS = tuple(base + end for base in FILTER_BASES for end in ("", "_wt", "_ht", "_hht"))
#: Zeros at the highest frequency of the synthesis and analysis low-pass filters of the biorthogonal families.
SPLINES = ("1.1", "1.3", "1.5", "2.2", "2.4", "2.6", "2.8", "3.1", "3.3", "3.5", "3.7", "3.9", "4.4")
WAVELETS = ("haar", *(f"db{n}" for n in range(1, 21)), "sym2", "sym3", *(f"bior{n}" for n in SPLINES), *(f"rbio{n}" for n in SPLINES))


def zscore(x: np.ndarray) -> np.ndarray:
    """Centred and divided by the population deviation plus a small constant."""
    return (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + EPS)


# --- recursive filters ------------------------------------------------------------------


def _prototype(kind: str, order: int, attenuation: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analogue low-pass prototype."""
    at = np.arange(-order + 1, order, 2)
    if kind == "butter":
        return np.empty(0), -np.exp(1j * np.pi * at / (2 * order)), 1.0
    ripple = 1 / np.sqrt(10 ** (0.1 * attenuation) - 1)
    mu = np.arcsinh(1 / ripple) / order
    used = at[at != 0]
    zeros = -np.conj(1j / np.sin(used * np.pi / (2 * order)))
    poles = -np.exp(1j * np.pi * at / (2 * order))
    poles = 1 / (np.sinh(mu) * poles.real + 1j * np.cosh(mu) * poles.imag)
    return zeros, poles, float((np.prod(-poles) / np.prod(-zeros)).real)


@lru_cache(maxsize=256)
def design(kind: str, order: int, low: float, high: float, fps: float, stop: bool, attenuation: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital band filter by the bilinear transform (kind: butter or cheby2)."""
    z, p, k = _prototype(kind, order, attenuation)
    edges = 4.0 * np.tan(np.pi * np.array([low, high]) / fps)  # warped, at a rate of two
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    degree = len(p) - len(z)
    if stop:
        k *= float(np.real(np.prod(-z) / np.prod(-p)))
        zs, ps = (width / 2) / z, (width / 2) / p
    else:
        zs, ps = z * width / 2, p * width / 2
    spread = lambda r: np.concatenate([r + np.sqrt(r.astype(complex) ** 2 - centre**2), r - np.sqrt(r.astype(complex) ** 2 - centre**2)])
    zs, ps = spread(zs), spread(ps)
    if stop:
        zs = np.concatenate([zs, np.full(degree, 1j * centre), np.full(degree, -1j * centre)])
    else:
        zs = np.concatenate([zs, np.zeros(degree)])
        k *= width**degree
    k *= float(np.real(np.prod(4 - zs) / np.prod(4 - ps)))
    zd = np.concatenate([(4 + zs) / (4 - zs), -np.ones(len(ps) - len(zs))])
    pd = (4 + ps) / (4 - ps)
    return k * np.real(np.poly(zd)), np.real(np.poly(pd))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form over the last axis from the given state (signals, order)."""
    y = np.empty_like(x)
    state = state.copy()
    for n in range(x.shape[-1]):
        y[..., n] = b[0] * x[..., n] + state[..., 0]
        state[..., :-1] = state[..., 1:]
        state[..., -1] = 0
        state += b[1:] * x[..., n, None] - a[1:] * y[..., n, None]
    return y


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State in which a constant one passes unchanged in level."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] += np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, over an odd extension of three filter lengths. Shorter signals raise ValueError."""
    pad = 3 * max(len(a), len(b))
    if x.shape[-1] <= pad:
        raise ValueError(f"a signal needs more than {pad} samples")
    head = 2 * x[..., :1] - x[..., pad:0:-1]
    tail = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    long = np.concatenate([head, x, tail], -1)
    zi = steady_state(b, a)
    y = lfilter(b, a, long, zi * long[..., :1])
    y = lfilter(b, a, y[..., ::-1], zi * y[..., -1:])[..., ::-1]
    return y[..., pad:-pad]


# --- spectra ----------------------------------------------------------------------------


def band_filter(x: np.ndarray, low: float, high: float, fps: float, stop: bool) -> np.ndarray:
    """Brick-wall band-pass or band-stop by the Fourier transform; bounds are inclusive."""
    n = x.shape[-1]
    away = np.abs(np.fft.fftfreq(n, 1 / fps))
    inside = (away >= low) & (away <= high)
    return np.fft.ifft(np.where(inside ^ stop, np.fft.fft(x), 0)).real


def peak_rate(x: np.ndarray, fps: float, compat: bool = False) -> np.ndarray:
    """Beats a minute of the largest bin in 0..N/2-1 (first wins); ``compat`` takes the bin of positive frequencies one too low."""
    n = x.shape[-1]
    size = np.abs(np.fft.fft(x))[..., : n // 2]
    if compat:
        return np.argmax(size[..., 1:], -1) * fps / n * 60
    return np.argmax(size, -1) * fps / n * 60


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal: negative frequencies removed, positive ones doubled."""
    n = x.shape[-1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


def instantaneous_rate(z: np.ndarray, fps: float) -> np.ndarray:
    """Mean instantaneous frequency in beats a minute; a zero stands in front of the differences."""
    turn = np.diff(np.unwrap(np.angle(z)), axis=-1) / (2 * np.pi) * fps
    return np.concatenate([np.zeros((*turn.shape[:-1], 1)), turn], -1).mean(-1) * 60


def envelope_normal(x: np.ndarray) -> np.ndarray:
    """The signal over its envelope."""
    envelope = np.abs(analytic(x))
    return x / np.where(envelope == 0, EPS, envelope)


# --- peaks ------------------------------------------------------------------------------


def find_peaks(x: np.ndarray, distance: float) -> np.ndarray:
    """Strict local maxima (middle of a plateau) of one signal; of peaks closer than the distance the highest stay."""
    edges = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, edges + 1), np.append(edges, len(x) - 1)
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.empty(0, int)
    peaks = (starts[top] + ends[top]) // 2
    least = int(np.ceil(distance))
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < least
            near[k] = False
            keep &= ~near
    return peaks[keep]


def peak_mask(x: np.ndarray) -> np.ndarray:
    """Where the signals have strict local maxima (middle of a plateau)."""
    rises, falls = x[..., 1:] > x[..., :-1], x[..., 1:] < x[..., :-1]
    out = np.zeros(x.shape, bool)
    out[..., 1:-1] = rises[..., :-1] & falls[..., 1:]
    flat = np.flatnonzero(~(rises | falls).all(-1))  # signals with plateaus
    if len(flat):
        out[flat] = _plateau_peaks(x[flat])
    return out


def _plateau_peaks(x: np.ndarray) -> np.ndarray:
    inner = np.zeros(x.shape, bool)
    inner[..., 1:] = x[..., 1:] != x[..., :-1]
    start = np.maximum.accumulate(np.where(inner, np.arange(x.shape[-1]), 0), -1)  # of each sample's plateau
    rises = np.zeros(x.shape, bool)
    rises[..., 1:] = x[..., 1:] > x[..., :-1]
    ends = np.zeros(x.shape, bool)
    ends[..., :-1] = (x[..., :-1] > x[..., 1:]) & np.take_along_axis(rises, start, -1)[..., :-1]
    out = np.zeros(x.shape, bool)
    row, end = np.nonzero(ends)
    out[row, (start[row, end] + end) // 2] = True
    return out


def interval_rate(x: np.ndarray, fps: float) -> np.ndarray:
    """Beats a minute from the mean interval of peaks at least half a second apart; 0 with fewer than two.

    As ``find_peaks`` does for one signal, the highest peak left (of equal ones the last) stays and those near it go, in all signals at once.
    """
    n, least = x.shape[-1], int(np.ceil(fps / 2))
    height = np.where(peak_mask(x), x, -np.inf)[..., ::-1]
    first, last, count = np.full(len(x), n), np.full(len(x), -1), np.zeros(len(x), int)
    left = np.flatnonzero(np.isfinite(height).any(-1))
    height = height[left]
    while len(left):
        at = height.argmax(-1)
        place = n - 1 - at
        first[left], last[left] = np.minimum(first[left], place), np.maximum(last[left], place)
        count[left] += 1
        height[np.abs(np.arange(n) - at[:, None]) < least] = -np.inf
        more = np.isfinite(height).any(-1)
        left, height = left[more], height[more]
    many = count > 1
    return np.where(many, 60 * fps * (count - 1) / np.where(many, last - first, 1), 0.0)


# --- wavelets ---------------------------------------------------------------------------


def _half_band_roots(n: int) -> np.ndarray:
    """Roots in y of the polynomial that completes n double zeros to a half-band filter."""
    return np.roots([comb(n - 1 + k, k) for k in range(n)][::-1]) if n > 1 else np.empty(0)


def _biorthogonal(zeros: int, dual_zeros: int) -> tuple[np.ndarray, np.ndarray]:
    """Analysis and synthesis low-pass filters of equal, even length.

    The half-band polynomial goes to the analysis side, but for 4.4, where its real root goes to the synthesis side.
    """
    roots = _half_band_roots((zeros + dual_zeros) // 2)
    real = roots[np.abs(roots.imag) < 1e-9] if zeros == 4 else roots[:0]

    def built(count: int, ys: np.ndarray) -> np.ndarray:
        taps = np.poly(-np.ones(count))
        for y in ys:
            taps = np.convolve(taps, [1, 4 * y - 2, 1])
        return np.real(taps) * np.sqrt(2) / np.real(taps).sum()

    low, back = built(dual_zeros, np.array([y for y in roots if y not in real])), built(zeros, real)
    size = len(low) + len(low) % 2
    middle = size // 2 - (1 if len(back) % 2 else 0)  # odd filters lie around one tap, which differs by one between the two
    padded = np.zeros(size)
    padded[middle - len(back) // 2 : middle - len(back) // 2 + len(back)] = back
    return np.concatenate([np.zeros(size - len(low)), low]), padded


@lru_cache(maxsize=128)
def wavelet(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Analysis and synthesis filters (low, high, low, high): haar, db1..db20, sym2 and sym3 by spectral factorisation, bior* and rbio* from splines."""
    if name[:4] in ("bior", "rbio") and name[4:] in SPLINES:
        low, back = _biorthogonal(*map(int, name[4:].split(".")))
        if name[0] == "r":
            low, back = back[::-1], low[::-1]
    elif name in ("haar", "sym2", "sym3") or name.startswith("db"):
        n = 1 if name == "haar" else int(name.lstrip("dbsym"))
        inner = []
        for y in _half_band_roots(n):  # y = (2 - z - 1/z) / 4
            pair = np.roots([1, 4 * y - 2, 1])
            inner.append(pair[np.argmin(np.abs(pair))])
        back = np.real(np.poly(np.concatenate([-np.ones(n), inner])))
        back *= np.sqrt(2) / back.sum()
        low = back[::-1]
    else:
        raise ValueError(f"unknown wavelet {name}")
    sign = (-1.0) ** np.arange(len(low))
    return low, -sign * back, back, sign * low


def max_level(samples: int, name: str) -> int:
    """Deepest useful decomposition."""
    reach = len(wavelet(name)[0]) - 1
    return max(0, int(np.floor(np.log2(samples / reach)))) if samples > reach else 0


def decompose(x: np.ndarray, name: str) -> tuple[list[np.ndarray], list[int]]:
    """Periodic coefficients [approximation, details from coarse to fine] at the deepest level, and the lengths on the way."""
    low, high, _, _ = wavelet(name)
    taps = len(low)
    details, sizes = [], []
    for _ in range(max_level(x.shape[-1], name)):
        sizes.append(x.shape[-1])
        if x.shape[-1] % 2:
            x = np.concatenate([x, x[..., -1:]], -1)
        n = x.shape[-1]
        around = x[..., np.arange(-taps, n + taps) % n]
        detail, level = np.zeros((*x.shape[:-1], n // 2)), np.zeros((*x.shape[:-1], n // 2))
        for j in range(taps):  # tap by tap: a signal's sums don't depend on which others are in the batch
            at = taps + taps // 2 - j
            part = around[..., at : at + n : 2]
            detail += high[j] * part
            level += low[j] * part
        details.append(detail)
        x = level
    return [x, *details[::-1]], sizes


def recompose(coefficients: list[np.ndarray], sizes: list[int], name: str) -> np.ndarray:
    """Signals from their periodic coefficients."""
    _, _, low, high = wavelet(name)
    taps = len(low)
    x = coefficients[0]
    for detail, size in zip(coefficients[1:], reversed(sizes)):
        half = detail.shape[-1]
        wrapped = np.arange(-taps, half + taps) % half
        rough, fine = x[..., wrapped], detail[..., wrapped]
        out = np.zeros((*detail.shape[:-1], 2 * half))
        for j in range(taps):
            shift = j + 1 - taps // 2
            at = taps + (shift % 2 - shift) // 2
            out[..., shift % 2 :: 2] += low[j] * rough[..., at : at + half] + high[j] * fine[..., at : at + half]
        x = out[..., :size]
    return x


def soft_threshold(coefficients: list[np.ndarray], sizes: list[int], name: str, level: int, samples: int) -> np.ndarray:
    """Signals from coefficients whose details are shrunk by the universal level, with noise from the median of the detail band ``level`` from the end."""
    band = coefficients[-min(level, len(coefficients))]
    limit = np.median(np.abs(band), -1, keepdims=True) / 0.6745 * np.sqrt(2 * np.log(samples))
    soft = [np.sign(c) * np.maximum(np.abs(c) - limit, 0) for c in coefficients[1:]]
    return recompose([coefficients[0], *soft], sizes, name)


def wavelet_denoise(x: np.ndarray, name: str = "rbio3.1", level: int = 5) -> np.ndarray:
    """Soft threshold at the universal level; signals too short for the wavelet stay as they are."""
    coefficients, sizes = decompose(x, name)
    return soft_threshold(coefficients, sizes, name, level, x.shape[-1]) if len(coefficients) > 1 else x


# --- empirical mode decomposition -------------------------------------------------------


def _cover(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Natural cubic splines of all signals through their peaks and the outer ones mirrored at the ends, at every sample.

    The tridiagonal systems are padded to the longest and solved together, column by column.
    """
    rows, n = x.shape
    upto = np.cumsum(peaks, -1)
    inner = upto[:, -1]
    width = int(inner.max()) + 2
    at = np.zeros((rows, width))
    values = np.zeros((rows, width))
    row, place = np.nonzero(peaks)
    slot = upto[row, place]
    at[row, slot], values[row, slot] = place, x[row, place]
    each = np.arange(rows)
    at[:, 0], values[:, 0] = -at[:, 1] - 1, values[:, 1]
    at[each, inner + 1], values[each, inner + 1] = 2 * (n - 1) - at[each, inner] + 1, values[each, inner]
    used = np.arange(width - 1) <= inner[:, None]  # the intervals that a signal has
    h = np.where(used, np.diff(at), 1.0)
    slope = np.where(used, np.diff(values), 0.0) / h
    bend = np.zeros((rows, width))
    over = np.zeros((rows, width))
    for i in range(1, width - 1):
        own = i <= inner
        scale = 2 * (h[:, i - 1] + h[:, i]) - h[:, i - 1] * over[:, i - 1]
        over[:, i] = np.where(own, h[:, i] / scale, 0.0)
        bend[:, i] = np.where(own, (6 * (slope[:, i] - slope[:, i - 1]) - h[:, i - 1] * bend[:, i - 1]) / scale, 0.0)
    for i in range(width - 2, 0, -1):
        bend[:, i] -= over[:, i] * bend[:, i + 1]
    place = upto + (each * width)[:, None]
    take = lambda a, k: a.ravel().take(k)
    bent, level, t = np.append(h, np.ones((rows, 1)), 1), np.zeros((rows, width)), np.arange(n)
    level[:, :-1] = values[:, :-1] / h - bend[:, :-1] * h / 6
    next_level = np.zeros((rows, width))
    next_level[:, :-1] = values[:, 1:] / h - bend[:, 1:] * h / 6
    u, w = t - take(at, place), take(at, place + 1) - t
    return (take(bend, place) * (w * w * w) + take(bend, place + 1) * (u * u * u)) / take(6 * bent, place) + take(level, place) * w + take(next_level, place) * u


def modes_of(x: np.ndarray, most: int = 8, sift: int = 10) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Intrinsic modes of all signals, one after the other: (the signals that have one more, their modes), by a fixed number of sifting steps."""
    rest = x.astype(float)
    at = np.arange(len(x))
    for _ in range(most):
        mode = rest[at]
        more = peak_mask(mode).sum(-1) + peak_mask(-mode).sum(-1) >= 4
        at, mode = at[more], mode[more]
        if not len(at):
            return
        moving = np.arange(len(at))
        for _ in range(sift):
            own = mode[moving]
            top, low = peak_mask(own), peak_mask(-own)
            enough = (top.sum(-1) > 1) & (low.sum(-1) > 1)
            moving, own, top, low = moving[enough], own[enough], top[enough], low[enough]
            if not len(moving):
                break
            mode[moving] = own - (_cover(own, top) + _cover(own, low)) / 2
        yield at, mode
        rest[at] -= mode


def empirical_modes(x: np.ndarray, most: int = 8, sift: int = 10) -> list[np.ndarray]:
    """Intrinsic modes of one signal."""
    return [mode[0] for _, mode in modes_of(x[None], most, sift)]


def hilbert_huang(x: np.ndarray, fps: float, expected: float = 80.0) -> tuple[np.ndarray, np.ndarray]:
    """For each signal the envelope-normalised mode whose rate is nearest the expected one (first wins), and that rate. A signal without modes stands for its own."""
    chosen, rates, gap = x.astype(float), np.zeros(len(x)), np.full(len(x), np.inf)
    for at, mode in modes_of(x):
        found = instantaneous_rate(analytic(mode), fps)
        away = np.abs(found - expected)
        nearer = away < gap[at]
        k = at[nearer]
        chosen[k], rates[k], gap[k] = mode[nearer], found[nearer], away[nearer]
    none = np.isinf(gap)
    if none.any():
        rates[none] = instantaneous_rate(analytic(chosen[none]), fps)
    return envelope_normal(chosen), rates


# --- dispatch ---------------------------------------------------------------------------


def split_name(method: str) -> tuple[str, str]:
    """The base filter of one of FILTERS and its ending without the line; ValueError for another name."""
    if method not in FILTERS:
        raise ValueError(f"unknown filter {method}")
    base, _, end = method.rpartition("_") if method.endswith(("_wt", "_ht", "_hht")) else (method, "", "")
    return base, end


def base_filter(x: np.ndarray, base: str, fps: float, order: int, low: float = 0.8, high: float = 2.5, attenuation: float = 50.0) -> np.ndarray:
    """Signals filtered by one of FILTER_BASES; ValueError for those too short."""
    stop = base.endswith("bandstop")
    if base.startswith("fft"):
        return band_filter(x, low, high, fps, stop)
    return filtfilt(*design("cheby2" if base.startswith("cheby2") else "butter", order, low, high, fps, stop, attenuation), x)


def apply_filter(x: np.ndarray, method: str, fps: float = 30.0, order: int = 2, low: float = 0.8, high: float = 2.5, name: str = "rbio3.1", level: int = 5, attenuation: float = 50.0, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Filtered signals and their rates by one of FILTERS; ValueError for another name.

    Without an ending the rate comes from peaks (recursive filters) or the largest bin
    (Fourier); _wt denoises and takes peaks, _ht and _hht take the instantaneous frequency.
    """
    base, end = split_name(method)
    y = base_filter(x, base, fps, order, low, high, attenuation)
    if end == "wt":
        y = wavelet_denoise(y, name, level)
        return y, interval_rate(y, fps)
    if end == "ht":
        return envelope_normal(y), instantaneous_rate(analytic(y), fps)
    if end == "hht":
        return hilbert_huang(y, fps)
    return y, peak_rate(y, fps, compat) if base.startswith("fft") else interval_rate(y, fps)


def snr(filtered: np.ndarray, original: np.ndarray, method: str = "decibels") -> np.ndarray:
    """Signal to noise, noise being what was filtered out. No signal gives 0, no noise 1000. ValueError for another method."""
    noise = original - filtered
    ps, pn = (filtered**2).mean(-1), (noise**2).mean(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kinds: dict[str, Callable[[], np.ndarray]] = {
            "ratio": lambda: ps / pn,
            "decibels": lambda: 10 * np.log10(ps / pn),
            "power": lambda: 10 * np.log10(ps / pn),
            "voltage": lambda: 20 * np.log10(np.sqrt(ps) / np.sqrt(pn)),
            "cov": lambda: filtered.mean(-1) / noise.std(-1),
        }
        if method not in kinds:
            raise ValueError(f"unknown method {method}")
        return np.where(ps <= 0, 0.0, np.where(pn < 1e-7, 1000.0, kinds[method]()))
