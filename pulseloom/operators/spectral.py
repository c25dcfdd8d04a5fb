"""Filters, spectra, rates and signal-to-noise ratios over signals stored as arrays.

What Column functions express stays there; the kernels of ``functions.dsp`` run over
Arrow batches, all signals of one length at a time. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseloom.functions import dsp

#: Signals of a sweep that are read at a time, samples that are swept at a time, and tasks whose outcomes are one batch.
READ, SAMPLES, OUTCOMES = 1024, 4096, 1000


def _doubles(c: str) -> Column:
    return F.col(c).cast("array<double>")


def mean_of(x: str) -> str:
    return f"(aggregate({x}, 0D, (a, v) -> a + v) / nullif(size({x}), 0))"


def detrend(c: str) -> Column:
    """z-score of an array column, with population deviation plus 1e-8."""
    x = f"cast({c} AS array<double>)"
    stats = f"aggregate({x}, struct(0D AS s, 0D AS q), (a, v) -> struct(a.s + v AS s, a.q + v * v AS q), a -> struct(a.s / nullif(size({c}), 0) AS m, sqrt(greatest(a.q / nullif(size({c}), 0) - pow(a.s / nullif(size({c}), 0), 2), 0D)) AS d))"
    return F.expr(f"transform(array({stats}), t -> transform({x}, v -> (v - t.m) / (t.d + 1e-8D)))[0]")


def signal_to_noise(filtered: str, original: str, method: str = "decibels") -> Column:
    """SNR of two array columns: 0 without signal, 1000 without noise."""
    if method not in ("ratio", "decibels", "power", "voltage", "cov"):
        raise ValueError(f"unknown method {method}")
    x, y = f"cast({filtered} AS array<double>)", f"cast({original} AS array<double>)"
    noise = f"zip_with({y}, {x}, (o, f) -> o - f)"
    power = lambda a: f"(aggregate({a}, 0D, (s, v) -> s + v * v) / nullif(size({filtered}), 0))"
    ps, pn, mn = power(x), power(noise), mean_of(noise)
    kinds = {"ratio": "p.s / p.n", "decibels": "10 * log10(p.s / p.n)", "power": "10 * log10(p.s / p.n)", "voltage": "20 * log10(sqrt(p.s) / sqrt(p.n))", "cov": f"{mean_of(x)} / nullif(sqrt(greatest(p.n - p.m * p.m, 0D)), 0D)"}
    return F.expr(f"transform(array(struct({ps} AS s, {pn} AS n, {mn} AS m)), p -> CASE WHEN p.s <= 0 THEN 0D WHEN p.n < 1e-7D THEN 1000D ELSE {kinds[method]} END)[0]")


def by_length(signals: Sequence, kernel: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> list[tuple | None]:
    """The kernel's results for each signal, all of one length together; None for null, empty, incomplete, or too short ones."""
    out: list[tuple | None] = [None] * len(signals)
    groups: dict[int, list[int]] = {}
    for k, s in enumerate(signals):
        if s is not None and len(s):
            x = np.asarray(s, np.float64)
            if np.isfinite(x).all():
                groups.setdefault(len(x), []).append(k)
    for at in groups.values():
        try:
            found = kernel(np.stack([np.asarray(signals[k], np.float64) for k in at]))
        except ValueError:
            continue
        for i, k in enumerate(at):
            out[k] = tuple(part[i] for part in found)
    return out


def filter_signals(df: DataFrame, method: str, signal: str = "signal", **options) -> DataFrame:
    """``df`` with filtered (array) and heart_rate; null where a signal is null, has gaps, or is too short for the filter."""
    if method not in dsp.FILTERS:
        raise ValueError(f"unknown filter {method}")

    @F.pandas_udf("struct<filtered:array<double>,heart_rate:double>")
    def run(signals: pd.Series) -> pd.DataFrame:
        found = by_length(signals.tolist(), lambda x: dsp.apply_filter(x, method, **options))
        return pd.DataFrame({"filtered": [None if f is None else f[0] for f in found], "heart_rate": [None if f is None else float(f[1]) for f in found]})

    return df.withColumn("_f", run(_doubles(signal))).select("*", "_f.filtered", "_f.heart_rate").drop("_f")


def spectrum(df: DataFrame, key: str, signal: str = "signal") -> DataFrame:
    """Fourier coefficients as (key, bin, re, im), bins 0..N-1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = by_length(batch["signal"].tolist(), lambda x: (np.fft.fft(x),))
            parts = [pd.DataFrame({"key": name, "bin": np.arange(len(f[0])), "re": f[0].real, "im": f[0].imag}) for name, f in zip(batch["key"], found) if f is not None]
            yield pd.concat(parts) if parts else pd.DataFrame({"key": [], "bin": [], "re": [], "im": []})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), _doubles(signal).alias("signal")).mapInPandas(run, f"key {kind}, bin int, re double, im double").withColumnRenamed("key", key)


def inverse(spectra: DataFrame, key: str) -> DataFrame:
    """Real parts of inverse transforms of (key, bin, re, im): (key, signal)."""
    packed = spectra.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "re", "im"))).alias("c"))

    @F.pandas_udf("array<double>")
    def run(coefficients: pd.Series) -> pd.Series:
        return pd.Series([np.fft.ifft(np.array([x["re"] + 1j * x["im"] for x in c])).real for c in coefficients])

    return packed.select(key, run("c").alias("signal"))


def dominant_rate(signal: str = "signal", fps: float = 30.0, compat: bool = False) -> Column:
    """Beats a minute of an array column's largest Fourier bin."""

    @F.pandas_udf("double")
    def run(signals: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else float(f[0]) for f in by_length(signals.tolist(), lambda x: (dsp.peak_rate(x, fps, compat),))], dtype="float64")

    return run(_doubles(signal))


def peaks(signal: str = "signal", fps: float = 30.0) -> Column:
    """Places of peaks at least half a second apart."""

    @F.pandas_udf("array<int>")
    def run(signals: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else dsp.find_peaks(np.asarray(s, float), fps / 2).astype(np.int32) for s in signals])

    return run(_doubles(signal))


def post_process(df: DataFrame, signal: str = "signal", method: str = "fft_bandstop_wt", snr_method: str = "decibels", **options) -> DataFrame:
    """Detrended, filtered, with SNR and rate: columns detrended, filtered, snr, heart_rate."""
    rows = filter_signals(df.withColumn("detrended", detrend(signal)), method, "detrended", **options)
    return rows.withColumn("snr", signal_to_noise("filtered", "detrended", snr_method))


def sweep_grid(spark: SparkSession, samples: int, wavelets: Sequence[str] = dsp.WAVELETS, orders: Sequence[int] = (2, 3, 4, 5, 6), methods: Sequence[str] = dsp.FILTERS) -> DataFrame:
    """Every task of a sweep: filter, filter_order, wavelet, wavelet_level ('None' and 0 where no wavelet is used)."""
    deep = [(w, level) for w in wavelets for level in range(1, dsp.max_level(samples, w) + 1)]
    rows = [(m, o, w, level) for o in orders for m in methods for w, level in (deep if m.endswith("_wt") else [("None", 0)])]
    return spark.createDataFrame(rows, "filter string, filter_order int, wavelet string, wavelet_level int")


def _swept(x: np.ndarray, tasks: Sequence[tuple], fps: float, snr_method: str) -> Iterator[tuple[list[tuple[list[tuple], slice]], np.ndarray, Callable[[np.ndarray | slice], np.ndarray]]]:
    """([tasks with one outcome, where its signals are], SNR, rates of the rows asked for) over signals of one length; a base filter that they are too short for gives none.

    The z-score and each base filter (with its order, where it has one) are made once. All of them together go through each
    wavelet's decomposition, which serves every level, and through the mode decomposition.
    """
    z = dsp.zscore(x)
    wanted: dict[tuple[str, str, int], dict[tuple[str, int], list[tuple]]] = {}
    for task in tasks:
        method, order, name, level = task
        base, end = dsp.split_name(method)
        wanted.setdefault((end, base, 0 if base.startswith("fft") else order), {}).setdefault((name, level), []).append(task)
    made: dict[tuple[str, int], np.ndarray] = {}
    for _, base, order in wanted:
        if (base, order) not in made:
            try:
                made[base, order] = dsp.base_filter(z, base, fps, order or 2)
            except ValueError:
                made[base, order] = np.empty((0, x.shape[-1]))
    for end in ("", "ht", "hht", "wt"):
        bases = [(base, order) for e, base, order in wanted if e == end and len(made[base, order])]
        if not bases:
            continue
        y, original = np.concatenate([made[b] for b in bases]), np.tile(z, (len(bases), 1))

        def given(filtered: np.ndarray, rates: Callable[[np.ndarray | slice], np.ndarray], variant: tuple[str, int] | None = None) -> tuple:
            found = []
            for k, (base, order) in enumerate(bases):
                own = wanted[end, base, order]
                for own_tasks in [own[variant]] if variant in own else own.values() if variant is None else []:
                    found.append((own_tasks, slice(k * len(z), (k + 1) * len(z))))
            return found, dsp.snr(filtered, original, snr_method), rates

        if end == "":
            fourier = np.repeat([base.startswith("fft") for base, _ in bases], len(z))
            yield given(y, lambda r, y=y, fourier=fourier: np.where(fourier[r], dsp.peak_rate(y[r], fps), dsp.interval_rate(y[r], fps)))
        elif end == "ht":
            yield given(dsp.envelope_normal(y), lambda r, y=y: dsp.instantaneous_rate(dsp.analytic(y[r]), fps))
        elif end == "hht":
            filtered, rate = dsp.hilbert_huang(y, fps)
            yield given(filtered, lambda r, rate=rate: rate[r])
        else:
            variants = dict.fromkeys(v for base, order in bases for v in wanted[end, base, order])
            for name in dict.fromkeys(n for n, _ in variants):
                coefficients, sizes = dsp.decompose(y, name)
                for level in [k for n, k in variants if n == name]:
                    clean = dsp.soft_threshold(coefficients, sizes, name, level, y.shape[-1]) if len(coefficients) > 1 else y
                    yield given(clean, lambda r, clean=clean: dsp.interval_rate(clean[r], fps), (name, level))


def _by_length(signals: Sequence) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and values of the complete signals of each length."""
    groups: dict[int, list[int]] = {}
    for k, s in enumerate(signals):
        if s is not None and len(s) and np.isfinite(np.asarray(s, np.float64)).all():
            groups.setdefault(len(s), []).append(k)
    for at in groups.values():
        yield at, np.stack([np.asarray(signals[k], np.float64) for k in at])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Keys and values of signals of one length, SAMPLES samples at a time: what a sweep holds doesn't grow with Arrow's batches."""
    for batch in batches:
        for first in range(0, batch.num_rows, READ):
            part = batch.slice(first, READ)
            keys = part.select(part.schema.names[:-1])
            for at, x in _by_length(part.column(part.num_columns - 1).to_pylist()):
                step = max(1, SAMPLES // x.shape[-1])
                for k in range(0, len(at), step):
                    yield keys.take(pa.array(at[k : k + step])), x[k : k + step]


def _outcomes(keys: pa.RecordBatch, tasks: Sequence[tuple], which: np.ndarray, snr: np.ndarray, rate: np.ndarray) -> pa.RecordBatch:
    """Rows of keys, the task of each, and what it gave."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32())
    columns = [pa.array([t[i] for t in tasks], kind).take(pa.array(which)) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*keys.columns, *columns, pa.array(snr, pa.float64()), pa.array(rate, pa.float64())], names=[*keys.schema.names, "filter", "filter_order", "wavelet", "wavelet_level", "snr", "heart_rate"])


def _dealt(df: DataFrame, key: Sequence[str], signal: str) -> DataFrame:
    """Keys and signals in at least as many partitions as there are cores: a sweep's work is per signal, a few files of signals would be a few tasks."""
    rows = df.select(*key, _doubles(signal).alias("signal"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sweep(df: DataFrame, grid: DataFrame, key: Sequence[str], signal: str = "signal", fps: float = 30.0, snr_method: str = "decibels") -> DataFrame:
    """SNR and rate of every signal under every task of the grid.

    Fourier filters don't depend on the order: their results are given to every order. The grid
    is small and travels with the function.
    """
    tasks = [tuple(r) for r in grid.collect()]  # as many as there are parameter sets
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in key) + ", filter string, filter_order int, wavelet string, wavelet_level int, snr double, heart_rate double"

    number = {task: k for k, task in enumerate(tasks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _slices(batches):
            which, snr, rate = [], [], []
            for found, values, rates in _swept(x, tasks, fps, snr_method):
                all_rates = rates(slice(None))
                for own, at in found:
                    for task in own:
                        which.append(number[task])
                        snr.append(values[at])
                        rate.append(all_rates[at])
            for k in range(0, len(which), OUTCOMES):
                some = which[k : k + OUTCOMES]
                rows = keys.take(pa.array(np.tile(np.arange(len(x)), len(some))))
                yield _outcomes(rows, tasks, np.repeat(some, len(x)), np.concatenate(snr[k : k + OUTCOMES]), np.concatenate(rate[k : k + OUTCOMES]))

    return _dealt(df, key, signal).mapInArrow(run, schema)


def best_of_sweep(df: DataFrame, grid: DataFrame, key: Sequence[str], signal: str = "signal", fps: float = 30.0, low: float = 48, high: float = 150, snr_method: str = "decibels") -> DataFrame:
    """For every signal the grid's task of highest SNR among those with a rate in range and some noise left; of equal ones the first by name, order, wavelet and level.

    The best is kept while a task's signals are filtered: one row a signal leaves it. Signals without such a task give no row.
    """
    tasks = sorted(tuple(r) for r in grid.collect())
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in key) + ", filter string, filter_order int, wavelet string, wavelet_level int, snr double, heart_rate double"

    rank = {task: k for k, task in enumerate(tasks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _slices(batches):
            n = len(x)
            best, value, rate = np.full(n, len(tasks)), np.full(n, -np.inf), np.zeros(n)
            for found, values, rates in _swept(x, tasks, fps, snr_method):
                level = np.where(np.isnan(values), -np.inf, values)
                # rates only where the SNR would do
                open_ = (values != 1000) & (level >= np.tile(value, len(values) // n))
                rows = np.flatnonzero(open_)
                fits = np.zeros(len(values), bool)
                own_rate = np.zeros(len(values))
                if len(rows):
                    own_rate[rows] = rates(rows)
                    fits[rows] = (own_rate[rows] >= low) & (own_rate[rows] <= high)
                for own, at in found:
                    first = min(rank[t] for t in own)
                    better = fits[at] & ((level[at] > value) | (level[at] == value) & (first < best))
                    best[better], value[better], rate[better] = first, level[at][better], own_rate[at][better]
            has = np.flatnonzero(best < len(tasks))
            if len(has):
                yield _outcomes(keys.take(pa.array(has)), tasks, best[has], np.where(np.isinf(value[has]), np.nan, value[has]), rate[has])

    return _dealt(df, key, signal).mapInArrow(run, schema)
