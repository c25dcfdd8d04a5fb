"""The three jobs from end to end: frames to pulse signals, sweep results to rankings, signals to a classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseloom.operators import balance, metrics, pulse, scoring, segments, significance, spectral, trials
from pulseloom.session import scratch
from pulseloom.sources import files


def extract_pulse(colours: DataFrame, fps: float, size: int = 128, overlap: int = 32, method: str = "fft_bandstop_wt", opponent: bool = False, done: DataFrame | None = None, **options) -> DataFrame:
    """``colours(video_id, region, patch_idx, frame_idx, valid, r, g, b)`` to pulse signals with SNR and rate.

    Segments of gap-free runs become colour arrays; window algebra runs within a segment; each signal is detrended,
    filtered and scored. Keys in ``done`` are passed over, so that running again repeats nothing.
    """
    key = ["video_id", "region", "patch_idx"]
    rows = colours if done is None else files.pending(colours, done.select(*key).distinct(), key)
    held = segments.segments(rows, key, ["frame_idx"], size=size, overlap=overlap)
    channels = ["r", "g", "b"]
    if opponent:
        red, yellow = pulse.orgb("r", "g", "b")
        held, channels = held.withColumns({"org": red, "oyb": yellow}), ["org", "oyb"]
    own = [*key, "run_id", "segment_id"]
    length = segments.window_length(fps)
    names = pulse.ORGB_SIGNALS if opponent else pulse.RGB_SIGNALS
    signals = pulse.pulse_signals(held, own, "t", channels, length)
    packed = segments.pack_segments(signals, key, [*channels, *[f"signal_{n}" for n in names]])
    turned = "o2SR" if opponent else "2SR"
    packed = pulse.rotation_signals(packed, channels, length, f"signal_{turned}")
    long = packed.select(*own, F.explode(F.array(*[F.struct(F.lit(n).alias("signal_type"), F.col(f"signal_{n}").alias("signal")) for n in (*names, turned)])).alias("s")).select(*own, "s.*")
    return spectral.post_process(long, "signal", method, fps=fps, **options)


def rank_results(results: DataFrame, groupings: Sequence[Sequence[str]], n: int = 20, out: str | None = None) -> DataFrame:
    """Sweep results to the best categories of each list of columns; written as CSV by grouping if a folder is given."""
    best = scoring.best_combinations(scoring.clean_results(results), groupings, n)
    if out:
        files.save(best, out, ["grouping"], kind="csv")
    return best


def compare_best(results: DataFrame, columns: Sequence[str], n: int = 10, values: Sequence[str] = ("snr", "heart_rate")) -> dict[str, dict]:
    """Tests of difference among the best n categories, for each metric."""
    keyed = scoring.composite_key(scoring.clean_results(results), columns, "category")
    _, _, rows = scoring.analyze_category(keyed, "category", n)
    return {v: significance.compare_groups(rows, "category", v) for v in values}


def quantile_points(df: DataFrame, value: str) -> DataFrame:
    """(value, expected): each distinct value against the normal quantile of its middle rank."""
    from pulseloom.functions import special

    ranks = significance.ranked(df.withColumn("_g", F.lit(0)), "_g", value)
    total = F.lit(df.where(F.col(value).isNotNull()).count())

    @F.pandas_udf("double")
    def quantile(shares: pd.Series) -> pd.Series:
        return shares.map(special.normal_quantile)

    return ranks.select("value", quantile((F.col("rank") - 0.5) / total).alias("expected"))


def training_data(real: DataFrame, fake: DataFrame, features: str, id_: str, balancing: str | None = "undersample", seed: int = 42) -> DataFrame:
    """Both classes cleaned, labelled 0 and 1, split, and the training part balanced (undersample, oversample or None)."""
    rows = balance.split(balance.labelled({"real": balance.drop_invalid(real, features), "fake": balance.drop_invalid(fake, features)}), ["label"], id_, seed=seed)
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    if balancing == "undersample":
        train = balance.undersample(train, "label", id_)
    elif balancing == "oversample":
        train = balance.oversample(train, "label", id_, seed).drop("copy")
    elif balancing is not None:
        raise ValueError(f"unknown balancing {balancing}")
    return train.unionByName(rest)


def fit_trial(rows: DataFrame, features: str, params: Mapping[str, float]) -> tuple[object, DataFrame]:
    """A regularised logistic model of the training part, and its metrics on every split. params: regParam, elasticNetParam, maxIter."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = rows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    settings = {k: int(v) if k == "maxIter" else float(v) for k, v in params.items()}
    model = LogisticRegression(featuresCol="_x", labelCol="label", **settings).fit(points.where("split = 'train'"))
    scored = model.transform(points).select("split", F.col("label").alias("y"), vector_to_array("probability")[1].alias("score"))
    return model, metrics.binary_metrics(scored, ["split"])


def study(spark: SparkSession, rows: DataFrame, features: str, space: Mapping, n: int = 10, metric: str = "f1", seed: int = 42) -> DataFrame:
    """Trials over a parameter space with the metric of each on the validation split, ranked. A failed trial has no metric and comes last."""
    plan = trials.suggest(spark, space, n, seed).collect()  # one row a trial
    kept = rows.cache()
    found = []
    for t in plan:
        params = {k: t[k] for k in space}
        try:
            value = fit_trial(kept, features, params)[1].where("split = 'val'").first()[metric]
        except Exception as failure:  # a trial may ask for what the model can't do
            print(f"trial {t['trial_id']} failed: {failure}")
            value = None
        found.append((t["trial_id"], {k: str(v) for k, v in params.items()}, value))
    kept.unpersist()
    return trials.rank_trials(spark.createDataFrame(found, "trial_id long, params map<string,string>, value double"), "value", ascending=False)


def halving(spark: SparkSession, rows: DataFrame, features: str, space: Mapping, n: int = 9, metric: str = "f1", least: int = 5, eta: int = 3, most: int = 45, together: int = 4, seed: int = 42) -> DataFrame:
    """Trials that end early when they aren't among the best: trial_id, rung, epochs, params, value, place, pruned.

    All trials run for ``least`` epochs, the best 1 / ``eta`` of them for ``eta`` times as many, and so on to ``most``. A rung's trials are
    jobs that run ``together`` at a time over one stored copy of the rows. A row tells where a trial ended: its last rung, the epochs spent on it over all rungs and its
    metric there. Places go by rung, then by metric; a trial that fails has no metric and ends at its first rung. The driver holds a row a trial.
    """
    from concurrent.futures import ThreadPoolExecutor

    path = scratch(spark, "study")
    rows.write.parquet(path)
    kept = spark.read.parquet(path)
    alive = {t["trial_id"]: {k: t[k] for k in space} for t in trials.suggest(spark, space, n, seed).collect()}
    ended: dict[int, tuple[int, int, dict, float | None]] = {}
    spent, epochs, rung = dict.fromkeys(alive, 0), least, 0

    def run(params: dict) -> float | None:
        try:
            return fit_trial(kept, features, params | {"maxIter": epochs})[1].where("split = 'val'").first()[metric]
        except Exception as failure:  # a trial may ask for what the model can't do
            print(f"trial with {params} failed: {failure}")
            return None

    while alive:
        with ThreadPoolExecutor(together) as pool:
            found = dict(zip(alive, pool.map(inheritable_thread_target(spark)(run), alive.values())))
        for k in alive:
            spent[k] += epochs
            ended[k] = (rung, spent[k], alive[k], found[k])
        good = sorted((k for k in alive if found[k] is not None), key=lambda k: (-found[k], k))
        if epochs >= most:
            break
        alive = {k: alive[k] for k in good[: max(1, len(good) // eta)]}
        epochs, rung = min(most, epochs * eta), rung + 1
    last = max((e[0] for e in ended.values()), default=0)
    table = [(k, r, e, {x: str(v) for x, v in p.items()}, None if m is None else float(m), r < last) for k, (r, e, p, m) in ended.items()]
    frame = spark.createDataFrame(table, "trial_id long, rung int, epochs int, params map<string,string>, value double, pruned boolean")
    order = Window.orderBy(F.desc("rung"), F.desc_nulls_last("value"), "trial_id")  # as many rows as trials
    return frame.withColumn("place", F.row_number().over(order))


def running_results(outputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Outputs of segments with how many of their key came before, in order of segment: what a growing list would hold."""
    return outputs.withColumn("so_far", F.row_number().over(Window.partitionBy(*key).orderBy("run_id", "segment_id")) - 1)
