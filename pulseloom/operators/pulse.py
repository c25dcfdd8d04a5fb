"""Pulse signals from colour series by two passes of window algebra.

Every method is linear in a row's colours once its window's means, variances and
covariances are known. A backward frame gives each window's coefficients at its last
row; a forward frame sums the coefficients of all windows that cover a row. Neither
rows nor windows are multiplied, and both frames use one sort.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-8
RGB_SIGNALS = ("R", "G", "B", "RG", "RB", "GB", "RGB", "POS", "APOS")
ORGB_SIGNALS = ("oRG", "oYB", "oRGYB", "aT")


def _mixes(names: Sequence[str], channels: Sequence[str]) -> dict[str, dict[str, Column]]:
    """Weights of the plain mixes on normalised channels: a channel weighs the ratio of deviations, which are one, or nearly nothing where a channel is constant."""
    sd = {c: F.when(F.col(f"v_{c}") > 0, F.lit(1.0)).otherwise(F.lit(EPS)) for c in channels}
    one = {c: {c: F.lit(1.0)} for c in channels}
    mix = lambda a, *rest: {a: F.lit(1.0)} | {b: sd[a] / sd[b] for b in rest}
    if len(channels) == 2:
        a, b = channels
        return dict(zip(names, (one[a], one[b], mix(a, b))))
    r, g, b = channels
    return dict(zip(names, (one[r], one[g], one[b], mix(r, g), mix(r, b), mix(g, b), mix(r, g, b))))


def _ratio(top: Column, bottom: Column) -> Column:
    """Ratio of deviations from variances; null where the lower one vanishes."""
    return F.when(bottom > 1e-12, F.sqrt(F.greatest(top, F.lit(0.0))) / F.sqrt(bottom))


def _with_weights(known: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Weights of POS and APOS (or aT) on normalised channels as columns a_<signal>_<channel>, step by step so that no expression repeats another."""
    u = {c: F.when(F.col(f"v_{c}") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) for c in channels}
    known = known.withColumns({f"u_{c}": v for c, v in u.items()})
    if len(channels) == 2:
        a, b = channels
        return known.withColumns({f"a_aT_{a}": F.lit(1.0), f"a_aT_{b}": -_ratio(F.col(f"u_{a}"), F.col(f"u_{b}"))})
    r, g, b = channels
    pair = lambda x, y: F.col(f"c_{x}{y}") / (F.col(f"d_{x}") * F.col(f"d_{y}"))
    known = known.withColumns({"_rg": pair(r, g), "_rb": pair(r, b), "_gb": pair(g, b)})
    R, G, B, rg, rb, gb = (F.col(c) for c in (f"u_{r}", f"u_{g}", f"u_{b}", "_rg", "_rb", "_gb"))
    det = R * G - rg * rg
    known = known.withColumns({"_alpha": _ratio(G + B - 2 * gb, 4 * R + G + B - 4 * rg - 4 * rb + 2 * gb), "_q": F.when(F.abs(det) > 1e-12, (rb * G - rg * gb + gb * R - rg * rb) / det)})
    size = 2 + F.col("_q") * F.col("_q")
    known = known.withColumns({"_p1": 1 - 1 / size, "_p2": -1 / size, "_p3": -F.col("_q") / size})
    p1, p2, p3 = F.col("_p1"), F.col("_p2"), F.col("_p3")
    spread = lambda x, y: x * x * R + y * y * G + p3 * p3 * B + 2 * x * y * rg + 2 * x * p3 * rb + 2 * y * p3 * gb
    known = known.withColumn("_beta", _ratio(spread(p1, p2), spread(p2, p1)))
    alpha, beta = F.col("_alpha"), F.col("_beta")
    return known.withColumns({f"a_POS_{r}": 2 * alpha, f"a_POS_{g}": 1 - alpha, f"a_POS_{b}": -1 - alpha, f"a_APOS_{r}": p1 - beta * p2, f"a_APOS_{g}": p2 - beta * p1, f"a_APOS_{b}": p3 - beta * p3})


def pulse_signals(rows: DataFrame, key: Sequence[str], order: str, channels: Sequence[str], length: int, signals: Sequence[str] | None = None, prefix: str = "signal_") -> DataFrame:
    """``rows`` with a column (prefix and name) for each signal; windows of ``length`` rows, stride one.

    Three channels give RGB_SIGNALS, two ORGB_SIGNALS. Rows that no full window covers get 0; a window in which a
    signal is undefined (its deviations vanish) adds nothing to it.
    """
    names = list(signals or (RGB_SIGNALS if len(channels) == 3 else ORGB_SIGNALS))
    time = Window.partitionBy(*key).orderBy(order)
    back, ahead = time.rowsBetween(-(length - 1), 0), time.rowsBetween(0, length - 1)
    x = {c: F.col(c).cast("double") for c in channels}
    moments = {f"m_{c}": F.avg(x[c]).over(back) for c in channels} | {f"v_{c}": F.var_pop(x[c]).over(back) for c in channels}
    moments |= {f"c_{a}{b}": F.covar_pop(x[a], x[b]).over(back) for i, a in enumerate(channels) for b in channels[i + 1 :]}
    moments["_full"] = F.row_number().over(time) >= length
    known = rows.withColumns(moments).withColumns({f"d_{c}": F.when(F.col(f"v_{c}") > 0, F.sqrt(F.col(f"v_{c}"))).otherwise(F.lit(1.0)) for c in channels})
    known = _with_weights(known, channels)
    tuned = ("POS", "APOS") if len(channels) == 3 else ("aT",)
    weights = _mixes(RGB_SIGNALS[:7] if len(channels) == 3 else ORGB_SIGNALS[:3], channels) | {n: {c: F.col(f"a_{n}_{c}") for c in channels} for n in tuned}
    sums = {}
    for n in names:
        for c in channels:
            own = weights[n].get(c)
            sums[f"w_{n}_{c}"] = F.when(F.col("_full"), own / F.col(f"d_{c}")) if own is not None else F.lit(None).cast("double")
        level = [weights[n][c] * F.col(f"m_{c}") / F.col(f"d_{c}") for c in channels if c in weights[n]]
        sums[f"w_{n}_"] = F.when(F.col("_full"), -sum(level[1:], level[0]))
    weighed = known.withColumns(sums)
    added = weighed.withColumns({f"s_{k}": F.coalesce(F.sum(k).over(ahead), F.lit(0.0)) for k in sums})
    out = {n: sum((F.col(f"s_w_{n}_{c}") * x[c] for c in channels), F.col(f"s_w_{n}_")) for n in names}
    return added.select(*[F.col(c) for c in rows.columns], *[v.alias(prefix + n) for n, v in out.items()])


def orgb(r: str, g: str, b: str) -> tuple[Column, Column]:
    """Opponent colours (red-green, yellow-blue): the chroma plane turned by a piecewise angle."""
    R, G, B = (F.col(c).cast("double") for c in (r, g, b))
    c1, c2 = 0.5 * R + 0.5 * G - B, 0.866 * R - 0.866 * G
    angle = F.atan2(c2, c1)
    turned = F.when(angle < F.pi() / 3, 1.5 * angle).otherwise(F.pi() / 2 + 0.75 * (angle - F.pi() / 3))
    by = turned - angle
    yellow = F.cos(by) * c1 - F.sin(by) * c2
    red = F.sin(by) * c1 + F.cos(by) * c2
    return red, yellow


def normalised_colour(rows: DataFrame, key: Sequence[str], value: str, name: str = "normalised") -> DataFrame:
    """(x - mean) / deviation within a key: zero differences and tiny deviations become 1e-8."""
    stats = rows.groupBy(*key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    away = F.col(value) - F.col("_m")
    return rows.join(stats, list(key)).withColumn(name, F.when(away == 0, EPS).otherwise(away) / F.when(F.col("_s") < EPS, EPS).otherwise(F.col("_s"))).drop("_m", "_s")


def spatial_rotation(colours: np.ndarray, length: int) -> np.ndarray:
    """The 2SR signal of an N x 3 colour series, or o2SR of an N x 2 one."""
    n_rows, dims = colours.shape
    out = np.zeros(n_rows)
    for n in range(length - 1, n_rows):
        m = n - length + 1
        if m == 0:
            continue
        own = colours[m : n + 1]
        sd = own.std(0)
        z = (own - own.mean(0)) / np.where(sd == 0, 1, sd)
        values, vectors = np.linalg.eigh(z.T @ z / length)
        before = colours[m - 1 : n]
        old_values, old_vectors = np.linalg.eigh(before.T @ before / length)
        turn = np.clip(vectors.T @ old_vectors, -1, 1)
        scale = np.sqrt(max(values[0], 0.0)) / np.sqrt(np.maximum(old_values[1:], 1e-6))
        out[m : n + 1] += (scale * np.sin(np.arccos(turn[0, 1:]))) @ old_vectors[1:, 0]
    return out


def rotation_signals(segments: DataFrame, channels: Sequence[str], length: int, name: str = "2SR") -> DataFrame:
    """Packed segments (an array for each channel) with their rotation signal; null where a channel is null or incomplete."""

    @F.pandas_udf("array<double>")
    def run(*parts: pd.Series) -> pd.Series:
        out = []
        for rows in zip(*parts):
            if any(x is None for x in rows):
                out.append(None)
                continue
            colours = np.stack([np.asarray(x, float) for x in rows], 1)
            out.append(spatial_rotation(colours, length) if np.isfinite(colours).all() else None)
        return pd.Series(out)

    return segments.withColumn(name, run(*[F.col(c).cast("array<double>") for c in channels]))


def mean_colour(pixels: DataFrame, region: DataFrame, on: Sequence[str], group: Sequence[str], channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Mean colours of the pixels that a region's membership rows name."""
    return pixels.join(region, list(on)).groupBy(*group).agg(*[F.avg(c).alias(c) for c in channels], F.count("*").alias("n_pixels"))
