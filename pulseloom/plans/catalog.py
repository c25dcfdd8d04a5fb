"""Every registered query of the engine with its DuckDB counterpart.

Queries apply the operators to whole tables through the views of ``plans.views``. Floats are
rounded on both sides, because sums in another order differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from pulseloom.functions import dsp
from pulseloom.operators import balance, cluster, geometry, inference, metrics, neighbours, pulse, scoring, segments, significance, spectral, trials
from pulseloom.plans import pipelines
from pulseloom.plans.views import oracle, view
from pulseloom.session import scratch, table
from pulseloom.sources import features, files, items
from pulseloom.streaming import ingest, running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "best_combinations"


def query(sql: str | None = None, digits: int = 6):
    """Register a query under its function's name; with SQL, floats of both sides are rounded to ``digits``."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            doubles = {c.name: F.round(F.col(f"`{c.name}`").cast("double"), digits) + 0.0 for c in df.schema if isinstance(c.dataType, (DoubleType, FloatType))}
            return df.withColumns(doubles) if sql and doubles else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = _rounded(oracle(sql), digits)
        return f

    return register


def _rounded(sql: str, digits: int) -> str:
    """The SQL with ``~name`` items rounded: ``~(expr) AS name``."""
    return sql.replace("~(", "0e0 + round(").replace(")~", f", {digits})")


# --- scoring --------------------------------------------------------------------------------

_CLEAN = "r AS (SELECT *, concat_ws('_', signal_type, filter, wavelet) AS category FROM v_results WHERE snr IS NOT NULL AND isfinite(snr) AND heart_rate IS NOT NULL AND snr <> 0 AND heart_rate <> 0)"
_SNR = """s0 AS (SELECT category, avg(snr) AS mean, median(snr) AS median, stddev_samp(snr) AS std, count(snr) AS count FROM r GROUP BY category),
    s AS (SELECT s0.*, m.mad, CASE WHEN mean < 0 THEN greatest(1 - ln(1 + 0.001 * abs(mean)), 0.1) ELSE 1.0 END AS penalty_factor
          FROM s0 JOIN (SELECT r.category, avg(abs(r.snr - s0.mean)) AS mad FROM r JOIN s0 USING (category) GROUP BY r.category) m USING (category)),
    snr AS (SELECT *, penalty_factor / (1 + 0.5 * std + 0.5 * mad) AS snr_score FROM s)"""
_HR = """g AS (SELECT category, subfolder, avg(heart_rate) AS mean, stddev_samp(heart_rate) AS std, count(*) AS n FROM r GROUP BY category, subfolder),
    gm AS (SELECT category, sum(mean * n) / sum(n) AS cm, sum(n) AS nn FROM g GROUP BY category),
    gd AS (SELECT a.category, a.mean, a.n, avg(abs(a.mean - b.mean)) AS mad FROM g a JOIN g b USING (category) GROUP BY a.category, a.mean, a.n, a.subfolder),
    h0 AS (SELECT g.category, any_value(cm) AS combined_mean, sqrt(sum(n * (std * std + (mean - cm) * (mean - cm))) / any_value(nn)) AS combined_std FROM g JOIN gm USING (category) GROUP BY g.category),
    h1 AS (SELECT category, sum(mad * n) / sum(n) AS combined_mad FROM gd GROUP BY category),
    h2 AS (SELECT *, CASE WHEN combined_mean < 48 THEN greatest(1 - ln(1 + 0.001 * abs(48 - combined_mean)), 0.1) WHEN combined_mean > 150 THEN greatest(1 - ln(1 + 0.001 * abs(combined_mean - 150)), 0.1) ELSE 1.0 END AS penalty_factor FROM h0 JOIN h1 USING (category)),
    hr AS (SELECT *, penalty_factor / (1 + 0.5 * combined_std + 0.5 * combined_mad) AS hr_score FROM h2)"""
_PROP = """p AS (SELECT category, avg(CASE WHEN heart_rate BETWEEN 48 AND 150 THEN 1.0 ELSE 0 END) AS hr_in_range_proportion, avg(CASE WHEN snr > 0 THEN 1.0 ELSE 0 END) AS snr_above_threshold_proportion,
    avg(CASE WHEN heart_rate BETWEEN 48 AND 150 AND snr > 0 THEN 1.0 ELSE 0 END) AS combined_in_range_proportion FROM r GROUP BY category)"""
_ALL = f"WITH {_CLEAN}, {_SNR}, {_HR}, {_PROP}, c AS (SELECT category, snr_score, hr_score, combined_in_range_proportion, 0.33 * snr_score + 0.33 * hr_score + 0.33 * combined_in_range_proportion AS combined_score FROM snr JOIN hr USING (category) JOIN p USING (category))"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.composite_key(scoring.clean_results(view(spark, sf_dir, "v_results")), ["signal_type", "filter", "wavelet"], "category")


@query(f"{_ALL} SELECT category, ~(snr_score)~ AS snr_score, ~(hr_score)~ AS hr_score, ~(combined_in_range_proportion)~ AS combined_in_range_proportion, ~(combined_score)~ AS combined_score FROM c ORDER BY c.combined_score DESC, category LIMIT 20")
def best_combinations(spark, sf_dir):
    """The twenty best signal, filter and wavelet combinations."""
    best = scoring.top_n(scoring.combined_scores(_results(spark, sf_dir), "category"), "combined_score", 20, "category")
    return best.select("category", "snr_score", "hr_score", "combined_in_range_proportion", "combined_score")


@query(f"WITH {_CLEAN}, {_SNR} SELECT category, ~(mean)~ AS mean, ~(median)~ AS median, ~(std)~ AS std, count, ~(mad)~ AS mad, ~(penalty_factor)~ AS penalty_factor, ~(snr_score)~ AS snr_score FROM snr")
def snr_scores(spark, sf_dir):
    """A1: SNR scores."""
    return scoring.snr_scores(_results(spark, sf_dir), "category").select("category", "mean", "median", "std", "count", "mad", "penalty_factor", "snr_score")


@query(f"WITH {_CLEAN}, {_HR} SELECT category, ~(combined_mean)~ AS combined_mean, ~(combined_std)~ AS combined_std, ~(combined_mad)~ AS combined_mad, ~(penalty_factor)~ AS penalty_factor, ~(hr_score)~ AS hr_score FROM hr")
def hr_scores(spark, sf_dir):
    """Two-level heart-rate scores."""
    return scoring.hr_scores(_results(spark, sf_dir), "category")


@query(f"WITH {_CLEAN}, {_PROP} SELECT category, ~(hr_in_range_proportion)~ AS hr_in_range_proportion, ~(snr_above_threshold_proportion)~ AS snr_above_threshold_proportion, ~(combined_in_range_proportion)~ AS combined_in_range_proportion FROM p")
def in_range_proportions(spark, sf_dir):
    """A4 A10: shares in range."""
    return scoring.proportions(_results(spark, sf_dir), "category")


@query(f"{_ALL}, t AS (SELECT category FROM c ORDER BY combined_score DESC, category LIMIT 10) SELECT r.category, count(*) AS n, ~(sum(snr))~ AS sum_snr FROM r WHERE category IN (SELECT category FROM t) GROUP BY r.category", digits=4)
def rows_of_best(spark, sf_dir):
    """Rows of the ten best categories, by semi-join."""
    _, _, kept = scoring.analyze_category(_results(spark, sf_dir), "category", 10)
    return kept.groupBy("category").agg(F.count("*").alias("n"), F.sum("snr").alias("sum_snr"))


@query(f"WITH {_CLEAN}, {_SNR} SELECT r.region_id, count(*) AS n, ~(avg(snr_score))~ AS avg_score FROM r LEFT JOIN snr USING (category) GROUP BY r.region_id")
def scores_joined_back(spark, sf_dir):
    """Facts with their category's score."""
    df = _results(spark, sf_dir)
    return scoring.with_scores(df, scoring.snr_scores(df, "category"), "category", "snr_score").groupBy("region_id").agg(F.count("*").alias("n"), F.avg("snr_score").alias("avg_score"))


@query(f"""WITH {_CLEAN}, x AS (SELECT 'signal_type_filter' AS grouping, concat_ws('_', signal_type, filter) AS category, snr FROM r UNION ALL SELECT 'filter_order_wavelet', concat_ws('_', filter_order, wavelet), snr FROM r)
    SELECT grouping, category, count(*) AS n, ~(avg(snr))~ AS mean FROM x GROUP BY grouping, category""")
def grouping_lists(spark, sf_dir):
    """Several lists of grouping columns in one frame."""
    df = scoring.clean_results(view(spark, sf_dir, "v_results"))
    return scoring.by_groupings(df, [["signal_type", "filter"], ["filter_order", "wavelet"]]).groupBy("grouping", "category").agg(F.count("*").alias("n"), F.avg("snr").alias("mean"))


@query("""WITH r AS (SELECT * FROM v_results WHERE isfinite(snr)), m AS (SELECT unnest(['snr', 'heart_rate', 'filter_order']) AS a), c AS (SELECT corr(snr, heart_rate) AS sh, corr(snr, filter_order) AS so, corr(heart_rate, filter_order) AS ho FROM r)
    SELECT a.a AS metric_a, b.a AS metric_b, ~(CASE WHEN a.a = b.a THEN 1.0 WHEN 'filter_order' NOT IN (a.a, b.a) THEN sh WHEN 'heart_rate' NOT IN (a.a, b.a) THEN so ELSE ho END)~ AS correlation FROM m a CROSS JOIN m b CROSS JOIN c""")
def metric_correlations(spark, sf_dir):
    """Correlation matrix."""
    return scoring.correlations(scoring.clean_results(view(spark, sf_dir, "v_results")), ["snr", "heart_rate", "filter_order"])


@query("""SELECT region_id, count_if(signal_type = 'A') AS n_A, count_if(signal_type = 'N') AS n_N, count_if(signal_type = 'R') AS n_R, ~(100.0 * count_if(signal_type = 'A') / count(*))~ AS pct_A,
    ~(100.0 * count_if(signal_type = 'N') / count(*))~ AS pct_N, ~(100.0 * count_if(signal_type = 'R') / count(*))~ AS pct_R FROM v_results GROUP BY region_id""")
def crosstab_shares(spark, sf_dir):
    """Counts and row percentages."""
    return scoring.crosstab(view(spark, sf_dir, "v_results"), "region_id", "signal_type", ["A", "N", "R"])


@query("""WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY lang)
    SELECT doc_id, lang, n_chars FROM documents JOIN q USING (lang) WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark, sf_dir):
    """Rows outside exact whiskers."""
    return scoring.iqr_outliers(table(spark, sf_dir, "documents"), "lang", "n_chars").select("doc_id", "lang", "n_chars")


@query("WITH d AS (SELECT p_type AS t, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part) x) SELECT p_type, any_value(code)::BIGINT AS code, count(*) AS n, list_aggregate(list_transform(string_split(replace(any_value(p_type), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM part JOIN d ON t = p_type GROUP BY p_type")
def label_codes(spark, sf_dir):
    """Alphabetical codes and titles."""
    coded = scoring.label_codes(table(spark, sf_dir, "part"), "p_type")
    return coded.groupBy("p_type").agg(F.first("code").cast("long").alias("code"), F.count("*").alias("n")).withColumn("title", scoring.title_case("p_type"))


@query("SELECT l_orderkey, l_linenumber, ~(snr)~ AS snr, ~(heart_rate)~ AS heart_rate FROM v_results WHERE heart_rate BETWEEN 48 AND 150 AND snr <> 1000 ORDER BY v_results.snr DESC, l_orderkey LIMIT 1")
def best_in_range(spark, sf_dir):
    """the best result with a plausible rate."""
    return scoring.best_in_range(view(spark, sf_dir, "v_results"), order="l_orderkey").select("l_orderkey", "l_linenumber", "snr", "heart_rate")


@query()
def density_peaks(spark, sf_dir):
    """A10: where each signal type's SNR is densest."""
    return scoring.kde_peak(view(spark, sf_dir, "v_results"), "signal_type", "snr")


# --- frames, segments, pulse ------------------------------------------------------------------

_RUNS = """f AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS run_id FROM v_frames),
    k AS (SELECT *, row_number() OVER (PARTITION BY video_id, run_id ORDER BY frame_idx) - 1 AS place, count(*) OVER (PARTITION BY video_id, run_id) AS n FROM f WHERE valid)"""


@query(f"""WITH {_RUNS}, s AS (SELECT video_id, run_id, frame_idx, unnest(range(0, 100000)) AS segment_id FROM k WHERE false
    UNION ALL SELECT video_id, run_id, frame_idx, g.s FROM k JOIN range(0, 2000) g(s) ON g.s * 6 <= place AND place < g.s * 6 + 8 AND g.s * 6 + 8 <= n)
    SELECT video_id, run_id::BIGINT AS run_id, segment_id::BIGINT AS segment_id, frame_idx::BIGINT AS frame_idx FROM s""")
def frame_segments(spark, sf_dir):
    """Gap-free runs cut into segments of 8 frames that overlap by 2."""
    rows = segments.segments(view(spark, sf_dir, "v_frames"), ["video_id"], ["frame_idx"], size=8, overlap=2)
    return rows.select("video_id", F.col("run_id").cast("long").alias("run_id"), F.col("segment_id").cast("long").alias("segment_id"), F.col("frame_idx").cast("long").alias("frame_idx"))


@query("""SELECT video_id, frame_idx::BIGINT AS frame_idx, ~(CASE WHEN frame_idx >= 4 THEN (r - avg(r) OVER w) / CASE WHEN stddev_pop(r) OVER w = 0 THEN 1 ELSE stddev_pop(r) OVER w END END)~ AS normalised,
    ~(r - lag(r) OVER (PARTITION BY video_id ORDER BY frame_idx))~ AS difference FROM v_frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def sliding_normalisation(spark, sf_dir):
    """Sliding normalisation and first differences."""
    rows = segments.sliding_normalised(view(spark, sf_dir, "v_frames"), ["video_id"], "frame_idx", "r", 5)
    return segments.differences(rows, ["video_id"], "frame_idx", "r").select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "normalised", "difference")


_W = "(PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_PULSE = f"""WITH m AS (SELECT video_id, frame_idx, r, g, b, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) >= 10 AS ok, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb,
      var_pop(r) OVER w AS vr, var_pop(g) OVER w AS vg, var_pop(b) OVER w AS vb, covar_pop(r, g) OVER w AS crg, covar_pop(r, b) OVER w AS crb, covar_pop(g, b) OVER w AS cgb FROM v_frames WINDOW w AS {_W}),
    d AS (SELECT *, CASE WHEN vr > 0 THEN sqrt(vr) ELSE 1 END AS dr, CASE WHEN vg > 0 THEN sqrt(vg) ELSE 1 END AS dg, CASE WHEN vb > 0 THEN sqrt(vb) ELSE 1 END AS db,
      CASE WHEN vr > 0 THEN 1e0 ELSE 0 END AS ur, CASE WHEN vg > 0 THEN 1e0 ELSE 0 END AS ug, CASE WHEN vb > 0 THEN 1e0 ELSE 0 END AS ub FROM m WHERE ok),
    n AS (SELECT *, crg / (dr * dg) AS prg, crb / (dr * db) AS prb, cgb / (dg * db) AS pgb FROM d),
    a AS (SELECT *, 4 * ur + ug + ub - 4 * prg - 4 * prb + 2 * pgb AS low2, ug + ub - 2 * pgb AS top2, ur * ug - prg * prg AS det FROM n),
    q AS (SELECT *, CASE WHEN low2 > 1e-12 THEN sqrt(greatest(top2, 0)) / sqrt(low2) END AS alpha, CASE WHEN abs(det) > 1e-12 THEN (prb * ug - prg * pgb + pgb * ur - prg * prb) / det END AS q FROM a),
    z AS (SELECT *, 2 + q * q AS sz FROM q),
    v AS (SELECT *, 1 - 1 / sz AS a1, -1 / sz AS a2, -q / sz AS a3 FROM z),
    y AS (SELECT *, a1 * a1 * ur + a2 * a2 * ug + a3 * a3 * ub + 2 * a1 * a2 * prg + 2 * a1 * a3 * prb + 2 * a2 * a3 * pgb AS s1, a2 * a2 * ur + a1 * a1 * ug + a3 * a3 * ub + 2 * a1 * a2 * prg + 2 * a2 * a3 * prb + 2 * a1 * a3 * pgb AS s2 FROM v),
    x AS (SELECT *, CASE WHEN s2 > 1e-12 THEN sqrt(greatest(s1, 0)) / sqrt(s2) END AS beta FROM y),
    c AS (SELECT video_id, frame_idx, 1 / dr AS rr, -mr / dr AS rd, 2 * alpha / dr AS pr, (1 - alpha) / dg AS pg, (-1 - alpha) / db AS pb, -(2 * alpha * mr / dr + (1 - alpha) * mg / dg + (-1 - alpha) * mb / db) AS pd,
      (a1 - beta * a2) / dr AS ar, (a2 - beta * a1) / dg AS ag, (a3 - beta * a3) / db AS ab, -((a1 - beta * a2) * mr / dr + (a2 - beta * a1) * mg / dg + (a3 - beta * a3) * mb / db) AS ad,
      (CASE WHEN vr > 0 THEN 1 ELSE 1e-8 END) / (CASE WHEN vg > 0 THEN 1 ELSE 1e-8 END) AS krg, dg, mg FROM x),
    j AS (SELECT f.video_id, f.frame_idx, f.r, f.g, f.b, c.* EXCLUDE (video_id, frame_idx) FROM v_frames f LEFT JOIN c USING (video_id, frame_idx)),
    t AS (SELECT video_id, frame_idx, coalesce(r * sum(rr) OVER w + sum(rd) OVER w, 0) AS p0, coalesce(r * sum(rr) OVER w + g * sum(krg / dg) OVER w + sum(rd - krg * mg / dg) OVER w, 0) AS p1,
      coalesce(r * sum(pr) OVER w + g * sum(pg) OVER w + b * sum(pb) OVER w + sum(pd) OVER w, 0) AS POS, coalesce(r * sum(ar) OVER w + g * sum(ag) OVER w + b * sum(ab) OVER w + sum(ad) OVER w, 0) AS APOS
      FROM j WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT video_id, frame_idx::BIGINT AS frame_idx, ~(p0)~ AS sig_r, ~(p1)~ AS sig_rg, ~(POS)~ AS sig_pos, ~(APOS)~ AS sig_apos FROM t"""


@query(_PULSE, digits=4)
def pulse_windows(spark, sf_dir):
    """R, RG, POS and APOS by two passes of window algebra."""
    rows = pulse.pulse_signals(view(spark, sf_dir, "v_frames"), ["video_id"], "frame_idx", ["r", "g", "b"], 10, ["R", "RG", "POS", "APOS"])
    return rows.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("signal_R").alias("sig_r"), F.col("signal_RG").alias("sig_rg"), F.col("signal_POS").alias("sig_pos"), F.col("signal_APOS").alias("sig_apos"))


@query("""WITH c AS (SELECT video_id, frame_idx, 0.5 * r + 0.5 * g - b AS c1, 0.866 * r - 0.866 * g AS c2 FROM v_frames), a AS (SELECT *, atan2(c2, c1) AS t FROM c),
    u AS (SELECT *, CASE WHEN t < pi() / 3 THEN 1.5 * t ELSE pi() / 2 + 0.75 * (t - pi() / 3) END - t AS w FROM a)
    SELECT video_id, frame_idx::BIGINT AS frame_idx, ~(sin(w) * c1 + cos(w) * c2)~ AS red_green, ~(cos(w) * c1 - sin(w) * c2)~ AS yellow_blue FROM u""")
def opponent_colours(spark, sf_dir):
    """Opponent colours."""
    red, yellow = pulse.orgb("r", "g", "b")
    return view(spark, sf_dir, "v_frames").select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), red.alias("red_green"), yellow.alias("yellow_blue"))


@query("""WITH s AS (SELECT video_id, avg(r) AS m, stddev_pop(r) AS d FROM v_frames GROUP BY video_id)
    SELECT event_id, ~(CASE WHEN r - m = 0 THEN 1e-8 ELSE r - m END / CASE WHEN d < 1e-8 THEN 1e-8 ELSE d END)~ AS normalised FROM v_frames JOIN s USING (video_id)""", digits=4)
def colour_normalisation(spark, sf_dir):
    """Guarded normalisation of a channel."""
    return pulse.normalised_colour(view(spark, sf_dir, "v_frames"), ["video_id"], "r").select("event_id", "normalised")


@query("""WITH m AS (SELECT video_id, var_pop(r) AS v1, var_pop(g) AS v2, covar_pop(r, g) AS c12, covar_pop(r, b) AS c1, covar_pop(g, b) AS c2, avg(r) AS m1, avg(g) AS m2, avg(b) AS mb FROM v_frames GROUP BY video_id HAVING count(*) > 5),
    s AS (SELECT *, (c1 * v2 - c12 * c2) / (v1 * v2 - c12 * c12) AS a, (c2 * v1 - c12 * c1) / (v1 * v2 - c12 * c12) AS b FROM m) SELECT video_id, ~(a)~ AS a, ~(b)~ AS b, ~(mb - a * m1 - b * m2)~ AS c FROM s""", digits=4)
def colour_regression(spark, sf_dir):
    """Blue on red and green."""
    frames = view(spark, sf_dir, "v_frames")
    many = frames.groupBy("video_id").count().where("count > 5").select("video_id")
    return cluster.regression(frames.join(many, "video_id", "left_semi"), ["video_id"], "b", "r", "g")


@query("""WITH c AS (SELECT video_id, frame_idx, 0.5 * r + 0.5 * g - b AS c1, 0.866 * r - 0.866 * g AS c2 FROM v_frames), u AS (SELECT *, CASE WHEN atan2(c2, c1) < pi() / 3 THEN 0.5 * atan2(c2, c1) ELSE pi() / 2 - pi() / 4 - 0.25 * atan2(c2, c1) END AS turn FROM c),
    x AS (SELECT video_id, frame_idx, sin(turn) * c1 + cos(turn) * c2 AS a, cos(turn) * c1 - sin(turn) * c2 AS b FROM u),
    m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k, avg(a) OVER w AS ma, avg(b) OVER w AS mb, var_pop(a) OVER w AS va, var_pop(b) OVER w AS vb FROM x WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, CASE WHEN va > 0 THEN sqrt(va) ELSE 1 END AS da, CASE WHEN vb > 0 THEN sqrt(vb) ELSE 1 END AS db, CASE WHEN va > 0 THEN 1 ELSE 1e-8 END / CASE WHEN vb > 0 THEN 1 ELSE 1e-8 END AS mix, CASE WHEN vb > 0 THEN CASE WHEN va > 0 THEN 1 ELSE 0 END END AS ratio FROM m),
    z AS (SELECT *, CASE WHEN k >= 10 THEN 1 / da END AS wa, CASE WHEN k >= 10 THEN 1 / db END AS wb, CASE WHEN k >= 10 THEN mix / db END AS wm, CASE WHEN k >= 10 THEN -ratio / db END AS wt, CASE WHEN k >= 10 THEN ma / da END AS la, CASE WHEN k >= 10 THEN mb / db END AS lb FROM d),
    t AS (SELECT *, coalesce(sum(wa) OVER f, 0) AS sa, coalesce(sum(wb) OVER f, 0) AS sb, coalesce(sum(wm) OVER f, 0) AS sm, coalesce(sum(wt) OVER f, 0) AS st, coalesce(sum(la) OVER f, 0) AS ga, coalesce(sum(lb) OVER f, 0) AS gb, coalesce(sum(la + mix * lb) OVER f, 0) AS gm, coalesce(sum(la - ratio * lb) OVER f, 0) AS gt FROM z WINDOW f AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT video_id, frame_idx::BIGINT AS frame_idx, ~(sa * a - ga)~ AS sig_org, ~(sb * b - gb)~ AS sig_oyb, ~(sa * a + sm * b - gm)~ AS sig_orgyb, ~(sa * a + st * b - gt)~ AS sig_at FROM t""", digits=4)
def opponent_pulse(spark, sf_dir):
    """oRG, oYB, their mix and aT over opponent colours."""
    red, yellow = pulse.orgb("r", "g", "b")
    rows = view(spark, sf_dir, "v_frames").select("video_id", "frame_idx", red.alias("org"), yellow.alias("oyb"))
    rows = pulse.pulse_signals(rows, ["video_id"], "frame_idx", ["org", "oyb"], 10)
    return rows.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("signal_oRG").alias("sig_org"), F.col("signal_oYB").alias("sig_oyb"), F.col("signal_oRGYB").alias("sig_orgyb"), F.col("signal_aT").alias("sig_at"))


@query()
def rotation_pulse(spark, sf_dir):
    """2SR over packed segments."""
    held = segments.segments(view(spark, sf_dir, "v_frames"), ["video_id"], ["frame_idx"], size=8, overlap=2)
    packed = segments.pack_segments(held, ["video_id"], ["r", "g", "b"])
    return pulse.rotation_signals(packed, ["r", "g", "b"], 5).select("video_id", "run_id", "segment_id", "2SR")


# --- spectra ------------------------------------------------------------------------------------

_DFT = "x AS (SELECT sample_id, unnest(signal)::DOUBLE AS v, generate_subscripts(signal, 1) - 1 AS n FROM v_signals), k AS (SELECT unnest(range(0, 64)) AS k), d AS (SELECT sample_id, k, sum(v * cos(2 * pi() * k * n / 64)) AS re, -sum(v * sin(2 * pi() * k * n / 64)) AS im FROM x CROSS JOIN k GROUP BY sample_id, k)"


@query(f"WITH {_DFT} SELECT sample_id, k::INT AS k, ~(re)~ AS re, ~(im)~ AS im FROM d", digits=4)
def fourier_spectrum(spark, sf_dir):
    """Fourier coefficients of all signals."""
    return spectral.spectrum(view(spark, sf_dir, "v_signals"), "sample_id").withColumnRenamed("bin", "k")


@query(f"WITH {_DFT}, r AS (SELECT sample_id, k, row_number() OVER (PARTITION BY sample_id ORDER BY round(sqrt(re * re + im * im), 9) DESC, k) AS o FROM d WHERE k < 32) SELECT sample_id, ~(k * 30e0 / 64 * 60)~ AS heart_rate FROM r WHERE o = 1")
def dominant_rates(spark, sf_dir):
    """Rate of the largest bin."""
    return view(spark, sf_dir, "v_signals").select("sample_id", spectral.dominant_rate("signal", 30.0).alias("heart_rate"))


@query(f"""WITH {_DFT}, f AS (SELECT * FROM d WHERE least(k, 64 - k) * 30e0 / 64 BETWEEN 0.8 AND 2.5), y AS (SELECT x.sample_id, x.n, any_value(x.v) AS v, sum(f.re * cos(2 * pi() * f.k * x.n / 64) - f.im * sin(2 * pi() * f.k * x.n / 64)) / 64 AS y FROM x JOIN f USING (sample_id) GROUP BY x.sample_id, x.n)
    SELECT sample_id, ~(10 * log10(avg(y * y) / avg((v - y) * (v - y))))~ AS decibels, ~(avg(y * y) / avg((v - y) * (v - y)))~ AS ratio, ~(20 * log10(sqrt(avg(y * y)) / sqrt(avg((v - y) * (v - y)))))~ AS voltage, ~(avg(y) / stddev_pop(v - y))~ AS cov FROM y GROUP BY sample_id""")
def band_snr(spark, sf_dir):
    """Brick-wall band-pass and its signal-to-noise ratio by all methods."""
    rows = spectral.filter_signals(view(spark, sf_dir, "v_signals"), "fft_bandpass")
    return rows.select("sample_id", *[spectral.signal_to_noise("filtered", "signal", m).alias(m) for m in ("decibels", "ratio", "voltage", "cov")])


@query("""WITH x AS (SELECT sample_id, unnest(signal)::DOUBLE AS v, generate_subscripts(signal, 1) - 1 AS n FROM v_signals), m AS (SELECT sample_id, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY sample_id)
    SELECT sample_id, n::INT AS n, ~((v - m) / (d + 1e-8))~ AS value FROM x JOIN m USING (sample_id)""", digits=5)
def detrended(spark, sf_dir):
    """Z-scores of signals."""
    return view(spark, sf_dir, "v_signals").select("sample_id", F.posexplode(spectral.detrend("signal")).alias("n", "value"))


@query(f"""WITH {_DFT}, s AS (SELECT sample_id, avg(v) AS m, stddev_pop(v) + 1e-8 AS s FROM x GROUP BY sample_id), f AS (SELECT * FROM d WHERE least(k, 64 - k) * 30e0 / 64 BETWEEN 0.8 AND 2.5),
    y AS (SELECT x.sample_id, x.n, any_value(x.v) AS v, sum(f.re * cos(2 * pi() * f.k * x.n / 64) - f.im * sin(2 * pi() * f.k * x.n / 64)) / 64 AS y FROM x JOIN f USING (sample_id) GROUP BY x.sample_id, x.n),
    z AS (SELECT y.sample_id, (v - m) / s AS z, y / s AS y FROM y JOIN s USING (sample_id)), q AS (SELECT sample_id, 10 * log10(avg(y * y) / avg((z - y) * (z - y))) AS snr FROM z GROUP BY sample_id),
    r AS (SELECT sample_id, k, row_number() OVER (PARTITION BY sample_id ORDER BY round(sqrt(re * re + im * im), 9) DESC, k) AS o FROM f WHERE k < 32) SELECT sample_id, ~(snr)~ AS snr, ~(k * 30e0 / 64 * 60)~ AS heart_rate FROM q JOIN r USING (sample_id) WHERE o = 1""", digits=5)
def post_processed(spark, sf_dir):
    """Signals detrended and band-passed, with SNR and rate."""
    return spectral.post_process(view(spark, sf_dir, "v_signals"), "signal", "fft_bandpass").select("sample_id", "snr", "heart_rate")


@query()
def filter_bank(spark, sf_dir):
    """SNR and rate under every task of the full grid."""
    return spectral.sweep(view(spark, sf_dir, "v_signals"), spectral.sweep_grid(spark, 64), ["sample_id"])


@query()
def parameter_sweep(spark, sf_dir):
    """All filters by order, wavelet and level, and the best for each signal."""
    return spectral.best_of_sweep(view(spark, sf_dir, "v_signals"), spectral.sweep_grid(spark, 64), ["sample_id"])


@query()
def peak_places(spark, sf_dir):
    """Peaks half a second apart."""
    return view(spark, sf_dir, "v_signals").select("sample_id", spectral.peaks("signal").alias("peaks"))


@query("SELECT f AS filter, (5 * CASE WHEN f LIKE '%\\_wt' ESCAPE '\\' THEN (SELECT sum(floor(log2(128.0 / (taps - 1)))) FROM (VALUES (2), (4), (8), (4)) w(taps)) ELSE 1 END)::BIGINT AS n FROM (SELECT unnest([" + ", ".join(f"'{m}'" for m in dsp.FILTERS) + "]) AS f) m")
def sweep_size(spark, sf_dir):
    """Tasks of the full grid by filter, for signals of 128 samples."""
    return spectral.sweep_grid(spark, 128, wavelets=("haar", "db2", "db4", "rbio3.1")).groupBy("filter").agg(F.count("*").alias("n"))


# --- balancing ------------------------------------------------------------------------------------

_F1 = lambda c: f"(({c} % 1000003 * 2654435761 + 42 * 97) % 4294967296)"
_MIX = lambda c: f"(({_F1(c)} % 65536 * 40503 + floor({_F1(c)} / 65536)::BIGINT * 60493 + {c} % 65536) % 4294967296)"


@query(f"""WITH r AS (SELECT item_id, class, row_number() OVER (PARTITION BY class ORDER BY {_MIX('item_id')}, item_id) - 1 AS n, count(*) OVER (PARTITION BY class) AS t FROM v_items)
    SELECT item_id, class, CASE WHEN n < t - 2 * floor(0.2 * t) THEN 'train' WHEN n < t - floor(0.2 * t) THEN 'val' ELSE 'test' END AS split FROM r""")
def three_way_split(spark, sf_dir):
    """Exact sizes by class, in mixed order."""
    return balance.split(view(spark, sf_dir, "v_items"), ["class"], "item_id").select("item_id", "class", "split")


@query("SELECT item_id, floor((row_number() OVER (ORDER BY item_id) - 1) / 64)::BIGINT AS batch FROM v_items")
def id_batches(spark, sf_dir):
    """Batches of 64."""
    return balance.batches(view(spark, sf_dir, "v_items"), "item_id", 64).select("item_id", "batch")


@query("WITH c AS (SELECT class, count(*) AS n FROM v_items GROUP BY class), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY item_id) AS k FROM v_items) SELECT item_id, class FROM r WHERE k <= (SELECT min(n) FROM c)")
def undersampled(spark, sf_dir):
    """B1 B2: the first rows of each class."""
    return balance.undersample(view(spark, sf_dir, "v_items"), "class", "item_id").select("item_id", "class")


@query(f"""WITH c AS (SELECT class, count(*) AS n FROM v_items GROUP BY class), k AS (SELECT class, n, unnest(range(0, (SELECT max(n) FROM c) - n)) AS k FROM c), p AS (SELECT class, ({_MIX('k')} % n)::BIGINT AS r, count(*) AS times FROM k GROUP BY ALL),
    o AS (SELECT item_id, class, row_number() OVER (PARTITION BY class ORDER BY {_MIX('item_id')}, item_id) - 1 AS r FROM v_items) SELECT item_id, class, 1 + coalesce(times, 0) AS copies FROM o LEFT JOIN p USING (class, r)""")
def oversampled(spark, sf_dir):
    """Classes as large as the largest: how often each row is taken."""
    rows = balance.oversample(view(spark, sf_dir, "v_items"), "class", "item_id")
    return rows.groupBy("item_id", "class").agg(F.count("*").alias("copies"))


@query("WITH c AS (SELECT y, count(*) AS n FROM v_predictions GROUP BY y) SELECT y::BIGINT AS y, n AS count, ~((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE))~ AS balanced, ~(1 / n::DOUBLE / (SELECT sum(1 / n::DOUBLE) FROM c))~ AS weighted FROM c")
def class_weights(spark, sf_dir):
    """Class counts and weights."""
    df = view(spark, sf_dir, "v_predictions")
    return balance.class_weights(df, "y").join(balance.class_counts(df, "y").select("y"), "y").select(F.col("y").cast("long").alias("y"), "count", "balanced", "weighted")


@query("SELECT ~(count_if(y = 0) / count_if(y = 1)::DOUBLE)~ AS pos_weight FROM v_predictions")
def positive_weight(spark, sf_dir):
    """Weight of positives."""
    return balance.positive_weight(view(spark, sf_dir, "v_predictions"), "y")


@query("SELECT parent, count(DISTINCT class) AS splits FROM v_items GROUP BY parent HAVING count(DISTINCT class) > 1")
def split_overlap(spark, sf_dir):
    """Ids that occur in several splits."""
    return balance.overlapping(view(spark, sf_dir, "v_items"), "parent", "class")


@query("SELECT label::BIGINT AS label, count(*) AS n FROM v_signals WHERE len(signal) > 0 AND len(list_filter(signal, lambda x: NOT isfinite(x))) = 0 GROUP BY label")
def clean_samples(spark, sf_dir):
    """Complete samples of both classes, labelled in order of the classes."""
    rows = view(spark, sf_dir, "v_signals").withColumnRenamed("label", "_class")
    classes = {name: balance.drop_invalid(rows.where(F.col("_class") == k), "signal").drop("_class") for k, name in enumerate(("real", "fake"))}
    return balance.labelled(classes).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT sample_id, (p.i)::INT AS patch_idx, ~(list_sum(signal[p.i * 16 + 1 : p.i * 16 + 16])::DOUBLE)~ AS total FROM v_signals, range(0, 4) p(i)", digits=4)
def flat_patches(spark, sf_dir):
    """Signals as four patches."""
    rows = view(spark, sf_dir, "v_signals").select("sample_id", balance.reshape("signal", 16).alias("patches"))
    return balance.flatten_patches(rows, "patches").select("sample_id", "patch_idx", F.aggregate("patch", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""WITH d AS (SELECT a.label AS g, a.sample_id AS id, b.sample_id AS neighbour, list_distance(a.signal::DOUBLE[], b.signal::DOUBLE[]) AS distance FROM v_signals a JOIN v_signals b ON a.label = b.label AND a.sample_id <> b.sample_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY distance, neighbour) AS place FROM d) SELECT g, id, place::INT AS place, neighbour, ~(distance)~ AS distance FROM r WHERE place <= 5""")
def exact_neighbours(spark, sf_dir):
    """The five nearest signals of each signal's class."""
    return neighbours.nearest_neighbours(view(spark, sf_dir, "v_signals"), "sample_id", "signal", 5, group="label")


@query()
def smote_samples(spark, sf_dir):
    """Synthetic samples of the smaller class."""
    return balance.smote(view(spark, sf_dir, "v_signals"), "label", "sample_id", "signal", k=5)


@query(f"""WITH o AS (SELECT item_id, weight, sum(weight) OVER (ORDER BY item_id % 1024, item_id) AS hi FROM v_items WHERE weight > 0), d AS (SELECT id AS draw, ({_MIX('id')} + 0.5) / 4294967296 * (SELECT sum(weight) FROM o) AS at FROM range(0, 5000) t(id))
    SELECT d.draw, o.item_id FROM d ASOF JOIN o ON d.at < o.hi""")
def weighted_sampling(spark, sf_dir):
    """Draws in proportion to weight, one row each."""
    return balance.weighted_draws(view(spark, sf_dir, "v_items"), "item_id", "weight", 5000)


@query(f"""WITH c AS (SELECT y, count(*) AS n FROM v_predictions GROUP BY y), s AS (SELECT 32 // (SELECT count(*) FROM c) AS each, ((SELECT sum(n) FROM c)::BIGINT + 31) // 32 AS batches), k AS (SELECT each, unnest(range(0, each * batches)) AS k FROM s),
    o AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {_MIX('doc_id')}, doc_id) - 1 AS r FROM v_predictions) SELECT k // each AS batch, c.y::BIGINT AS y, k % each AS slot, o.doc_id FROM k CROSS JOIN c JOIN o ON o.y = c.y AND o.r = {_MIX('k')} % c.n""")
def balanced_batches(spark, sf_dir):
    """Batches with as many rows of each class."""
    rows = balance.balanced_batches(view(spark, sf_dir, "v_predictions"), "y", "doc_id", 32)
    return rows.select("batch", F.col("y").cast("long").alias("y"), "slot", "doc_id")


@query()
def weighted_batches(spark, sf_dir):
    """Batches drawn by inverse class size."""
    return balance.weighted_batches(view(spark, sf_dir, "v_predictions"), "y", "doc_id", 32)


# --- metrics ---------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT stage, count_if(score > 0.5 AND y = 1) AS tp, count_if(score > 0.5 AND y = 0) AS fp, count_if(score <= 0.5 AND y = 1) AS fn, count_if(score <= 0.5 AND y = 0) AS tn FROM v_predictions GROUP BY stage)
    SELECT stage, tp, fp, fn, tn, ~(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)::DOUBLE)~ AS accuracy, ~(coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE)~ AS precision, ~(coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE)~ AS recall, ~(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE)~ AS f1,
    ~((1 + coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0)) / 2::DOUBLE)~ AS auroc_thresholded FROM t""")
def stage_metrics(spark, sf_dir):
    """Metrics by stage."""
    return metrics.binary_metrics(view(spark, sf_dir, "v_predictions"), ["stage"])


@query("SELECT y, (score > 0.5)::INT AS y_hat, count(*) AS count FROM v_predictions GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    """Confusion matrix."""
    return metrics.confusion(view(spark, sf_dir, "v_predictions"))


@query("""WITH t AS (SELECT score AS threshold, sum(count_if(y = 1)) OVER (ORDER BY score DESC) AS tp, sum(count_if(y = 0)) OVER (ORDER BY score DESC) AS fp FROM v_predictions GROUP BY score)
    SELECT ~(threshold)~ AS threshold, ~(tp / (SELECT count_if(y = 1) FROM v_predictions)::DOUBLE)~ AS tpr, ~(fp / (SELECT count_if(y = 0) FROM v_predictions)::DOUBLE)~ AS fpr FROM t""")
def roc_points(spark, sf_dir):
    """The curve."""
    return metrics.roc_curve(view(spark, sf_dir, "v_predictions"))


@query("SELECT ~(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*))~ AS auc FROM v_predictions p, v_predictions n WHERE p.y = 1 AND n.y = 0")
def area_under_curve(spark, sf_dir):
    """Its area."""
    return metrics.auc(view(spark, sf_dir, "v_predictions"))


@query("SELECT stage, ~(avg(-(2 * y * ln(score) + (1 - y) * ln(1 - score))))~ AS loss FROM v_predictions WHERE score > 1e-12 AND score < 1 - 1e-12 GROUP BY stage", digits=5)
def cross_entropy(spark, sf_dir):
    """M2: weighted cross-entropy of logits."""
    df = view(spark, sf_dir, "v_predictions").where("score > 1e-12 AND score < 1 - 1e-12").withColumn("logit", F.log(F.col("score") / (1 - F.col("score"))))
    return metrics.bce_loss(df, ["stage"], pos_weight=2.0)


#: Attention vector of the readout query: -0.5, 0 and 0.5 in turn.
_ATTENTION = [0.5 * (j % 3 - 1) for j in range(16)]


@query("""WITH s AS (SELECT sample_id, t, j, signal[t * 16 + j + 1]::DOUBLE AS v FROM v_signals, range(0, 4) a(t), range(0, 16) b(j)),
    q AS (SELECT sample_id, t, sum(0.5 * (j % 3 - 1) * v) AS q FROM s GROUP BY sample_id, t), w AS (SELECT sample_id, t, exp(q - max(q) OVER (PARTITION BY sample_id)) AS w FROM q),
    p AS (SELECT sample_id, j, max(CASE WHEN t = 3 THEN v END) AS last, avg(v) AS mean, max(v) AS max, min(v) AS min, sum(w * v) / sum(w) AS attention FROM s JOIN w USING (sample_id, t) GROUP BY sample_id, j),
    k AS (SELECT sample_id, 'last' AS kind, j, last AS v FROM p UNION ALL SELECT sample_id, unnest(['mean', 'avg_pool', 'mean_max', 'mean_min', 'adaptive_pool']), j, mean FROM p UNION ALL SELECT sample_id, unnest(['max', 'max_pool']), j, max FROM p
      UNION ALL SELECT sample_id, unnest(['min', 'min_max']), j, min FROM p UNION ALL SELECT sample_id, unnest(['mean_max', 'min_max', 'adaptive_pool']), 16 + j, max FROM p UNION ALL SELECT sample_id, 'mean_min', 16 + j, min FROM p UNION ALL SELECT sample_id, 'attention', j, attention FROM p)
    SELECT sample_id, kind, j::INT AS j, ~(v)~ AS value FROM k""")
def state_readouts(spark, sf_dir):
    """M1: all readouts of a sequence of states."""
    rows = view(spark, sf_dir, "v_signals").select("sample_id", balance.reshape("signal", 16).alias("states"))
    each = [F.struct(F.lit(k).alias("kind"), metrics.readout("states", k, _ATTENTION).alias("z")) for k in inference.READOUTS]
    rows = rows.select("sample_id", F.explode(F.array(*each)).alias("r"))
    return rows.select("sample_id", "r.kind", F.posexplode("r.z").alias("j", "value"))


@query()
def sequence_classifier(spark, sf_dir):
    """M1 M5: probabilities by an LSTM of one layer, and over four patches by way of the encoder, with weights drawn from a seed."""
    rng = np.random.default_rng(7)
    draw = lambda *shape: rng.standard_normal(shape) * 0.3
    lstm = [{"w_in": draw(32, 4), "w_state": draw(32, 8), "bias": draw(32)}]
    layer = {"w_qkv": draw(24, 8), "b_qkv": draw(24), "w_out": draw(8, 8), "b_out": draw(8), "w_up": draw(16, 8), "b_up": draw(16), "w_down": draw(8, 16), "b_down": draw(8), "scale1": np.ones(8), "shift1": np.zeros(8), "scale2": np.ones(8), "shift2": np.zeros(8)}
    weights = {"lstm": lstm, "encoder": [layer], "heads": 2, "attention": draw(8), "fc": draw(8), "bias": 0.1}
    rows = view(spark, sf_dir, "v_signals")
    return rows.select("sample_id", "label", inference.classify("signal", 4, weights, "attention").alias("whole"), inference.classify("signal", 4, weights, "mean", patches=4).alias("patches"))


@query("SELECT p.range::BIGINT AS position, j.range::INT AS j, ~(CASE WHEN j.range % 2 = 0 THEN sin(p.range * exp(-ln(10000.0) * (j.range - j.range % 2) / 8)) ELSE cos(p.range * exp(-ln(10000.0) * (j.range - j.range % 2) / 8)) END)~ AS value FROM range(0, 32) p, range(0, 8) j")
def position_table(spark, sf_dir):
    """M5: positional encoding."""
    return metrics.positional_encoding(spark, 32, 8)


# --- significance and clusters --------------------------------------------------------------------

_GROUPS = "x AS (SELECT signal_type AS g, snr AS v FROM v_results)"


@query(f"""WITH {_GROUPS}, m AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY g), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS a FROM m), b AS (SELECT sum(n * (m - (SELECT a FROM t)) ** 2) AS b, sum((n - 1) * s) AS w FROM m)
    SELECT k AS groups, n::BIGINT AS n, ~(b)~ AS ss_between, ~(w)~ AS ss_within, ~(b / (k - 1) / (w / (n - k)))~ AS f, ~(b / (b + w))~ AS eta_squared, ~(pow(1 + (k - 1) * (b / (k - 1) / (w / (n - k))) / (n - k), -(n - k) / 2e0))~ AS p_value FROM t, b WHERE k = 3""", digits=3)
def anova_table(spark, sf_dir):
    """T5: analysis of variance."""
    return significance.anova(view(spark, sf_dir, "v_results"), "signal_type", "snr")


@query(f"""WITH {_GROUPS}, d AS (SELECT x.g, abs(v - md) AS v FROM x JOIN (SELECT g, median(v) AS md FROM x GROUP BY g) q ON q.g = x.g), m AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM d GROUP BY g),
    t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS a FROM m), b AS (SELECT sum(n * (m - (SELECT a FROM t)) ** 2) AS b, sum((n - 1) * s) AS w FROM m) SELECT k AS groups, n::BIGINT AS n, ~(b / (k - 1) / (w / (n - k)))~ AS f, ~(pow(1 + (k - 1) * (b / (k - 1) / (w / (n - k))) / (n - k), -(n - k) / 2e0))~ AS p_value FROM t, b WHERE k = 3""", digits=4)
def levene_test(spark, sf_dir):
    """T4: equality of spreads."""
    return significance.levene(view(spark, sf_dir, "v_results"), "signal_type", "snr").select("groups", "n", "f", "p_value")


_RANKS = "q AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v)::DOUBLE AS t FROM q), ti AS (SELECT sum(t * t - 1) AS c, count(*)::DOUBLE AS n FROM r), o AS (SELECT g, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS s FROM r GROUP BY g)"


@query(f"WITH {_RANKS}, k AS (SELECT count(*) AS groups, sum(o.n)::BIGINT AS n, (12 / (any_value(ti.n) * (any_value(ti.n) + 1)) * sum(s * s / o.n) - 3 * (any_value(ti.n) + 1)) / (1 - any_value(c) / (any_value(ti.n) ** 3 - any_value(ti.n))) AS h FROM o, ti) SELECT groups, n, ~(h)~ AS h, ~(exp(-h / 2))~ AS p_value FROM k WHERE groups = 3", digits=4)
def kruskal_test(spark, sf_dir):
    """Ranks of groups, corrected for ties, with the chi-squared tail (of three groups: exp(-h / 2))."""
    return significance.kruskal(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


#: Two-sided normal tail of a column z by Simpson's rule.
_TAIL = "2 * greatest(0.5 - least(abs(z), 10) / 2400 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 801), lambda i: (CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (i * least(abs(z), 10) / 800) ** 2))), 0)"


@query(f"WITH {_RANKS}, d AS (SELECT a.g AS group_a, b.g AS group_b, (a.s / a.n - b.s / b.n) / sqrt((ti.n * (ti.n + 1) / 12 - c / (12 * (ti.n - 1))) * (1 / a.n + 1 / b.n)) AS z FROM o a, o b, ti WHERE a.g < b.g) SELECT group_a, group_b, ~(z)~ AS z, ~(least(1, {_TAIL} * (SELECT count(*) FROM d)))~ AS p_adjusted FROM d", digits=4)
def dunn_test(spark, sf_dir):
    """Pairs of groups after a rank test, two-sided, with Bonferroni's adjustment."""
    return significance.dunn(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("WITH m AS (SELECT filter AS g, avg(snr) AS m, var_samp(snr) AS s FROM v_results GROUP BY filter ORDER BY filter) SELECT ~((first(m ORDER BY g) - last(m ORDER BY g)) / sqrt(avg(s)))~ AS d FROM m HAVING count(*) = 2")
def effect_size(spark, sf_dir):
    """Cohen's d."""
    return significance.cohens_d(view(spark, sf_dir, "v_results"), "filter", "snr")


@query()
def normality_tests(spark, sf_dir):
    """Shapiro-Wilk or Kolmogorov-Smirnov by group size."""
    return significance.normality(view(spark, sf_dir, "v_results"), "signal_type", "snr")


@query()
def group_comparison(spark, sf_dir):
    """Which test applies to both metrics, its outcome, and the pairs of groups that it then compares."""
    df, out = view(spark, sf_dir, "v_results"), None
    for metric in ("snr", "heart_rate"):
        r = significance.compare_groups(df, "signal_type", metric)
        head = spark.createDataFrame([(metric, r["test_used"], r["p_value"], r["significant"])], "metric string, test_used string, p_value double, significant boolean")
        pairs = r["post_hoc"] if r["post_hoc"] is not None else spark.createDataFrame([(None,) * 4], "group_a string, group_b string, z double, p_adjusted double")
        rows = pairs.join(F.broadcast(head))  # one row
        out = rows if out is None else out.unionByName(rows)
    return out.select("metric", "test_used", "p_value", "significant", "group_a", "group_b", "z", "p_adjusted")


@query("WITH m AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer) SELECT c_custkey, ~((c_acctbal - m) / s)~ AS c_acctbal_z FROM customer, m")
def standardised(spark, sf_dir):
    """Population z-scores."""
    return cluster.standardise(table(spark, sf_dir, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal_z")


@query("SELECT 'p_partkey' AS name, ~(avg(p_partkey))~ AS mean FROM part UNION ALL SELECT 'p_size', ~(avg(p_size))~ FROM part UNION ALL SELECT 'p_retailprice', ~(avg(p_retailprice))~ FROM part", digits=4)
def numeric_means(spark, sf_dir):
    """means of the numeric columns."""
    df = table(spark, sf_dir, "part")
    row = df.agg(*[F.avg(c).alias(c) for c in scoring.numeric_columns(df)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("mean")) for c in row.columns])).alias("x")).select("x.*")


@query()
def kmeans_clusters(spark, sf_dir):
    """Clusters of standardised metrics with size, centre and variance."""
    found, _, _ = cluster.kmeans(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 4)
    return cluster.cluster_stats(found, "cluster", ["p_size", "p_retailprice"])


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 50 AS b FROM part), c AS (SELECT row_number() OVER (ORDER BY p_partkey) AS k, a, b FROM p QUALIFY k <= 5),
    n AS (SELECT p.a, p.b, (min(struct_pack(d := (p.a - c.a) ** 2 + (p.b - c.b) ** 2, k := c.k))).k AS k FROM p, c GROUP BY p.p_partkey, p.a, p.b), m AS (SELECT k, count(*) AS n, sum(a) AS a, sum(b) AS b FROM n GROUP BY k)
    SELECT (c.k - 1)::INT AS cluster, ~((c.a * 10 + coalesce(m.a, 0)) / (10 + coalesce(m.n, 0)))~ AS a, ~((c.b * 10 + coalesce(m.b, 0)) / (10 + coalesce(m.n, 0)))~ AS b, ~(10e0 + coalesce(m.n, 0))~ AS weight FROM c LEFT JOIN m USING (k)""", digits=4)
def minibatch_step(spark, sf_dir):
    """One step of mini-batch k-means from the first five parts as centres of weight ten, the whole table being the batch."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 50).alias("b"))
    first = [[r["a"], r["b"]] for r in rows.orderBy("p_partkey").limit(5).collect()]
    centres, weights = cluster.minibatch_step(rows, ["a", "b"], first, [10.0] * len(first))
    return spark.createDataFrame([(k, *c, w) for k, (c, w) in enumerate(zip(centres, weights))], "cluster int, a double, b double, weight double")


@query()
def minibatch_clusters(spark, sf_dir):
    """Clusters of all parts by mini-batches, with size, centre and variance."""
    found, _, _ = cluster.minibatch_kmeans(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 4, "p_partkey")
    return cluster.cluster_stats(found, "cluster", ["p_size", "p_retailprice"])


@query()
def cluster_elbow(spark, sf_dir):
    """Inertias and the number of clusters at their knee."""
    best, found = cluster.elbow(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"], 2, 6)
    return spark.createDataFrame([(k, v, k == best) for k, v in found], "k int, inertia double, chosen boolean")


@query("SELECT region_id, count(*) AS size, ~(avg(snr))~ AS centre_snr, ~(var_samp(snr))~ AS var_snr FROM v_results GROUP BY region_id", digits=4)
def cluster_statistics(spark, sf_dir):
    """Statistics of given clusters."""
    return cluster.cluster_stats(view(spark, sf_dir, "v_results"), "region_id", ["snr"])


@query()
def hulls(spark, sf_dir):
    """Convex hulls of clusters."""
    return cluster.convex_hull(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice")


@query()
def centre_cells(spark, sf_dir):
    """Voronoi cells of cluster centres."""
    centres = cluster.cluster_stats(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"])
    return cluster.voronoi_cells(centres, "p_brand", "centre_p_size", "centre_p_retailprice", (0.0, 0.0, 60.0, 3000.0))


# --- geometry, tracking ----------------------------------------------------------------------------

_GRID = "g AS (SELECT (range % 16)::INT AS x, (range // 16)::INT AS y FROM range(0, 256)), t AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x0, n_nationkey % 7 AS y0 FROM nation)"


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    pixels = nations.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(255)))).select("k", (F.col("p") % 16).alias("x"), F.floor(F.col("p") / 16).cast("int").alias("y"))
    corner = lambda dx, dy: F.struct((F.col("k") % 5 + dx).alias("x"), (F.col("k") % 7 + dy).alias("y"))
    return pixels, nations.withColumn("corners", F.array(corner(0, 0), corner(8, 0), corner(0, 8)))


@query(f"WITH {_GRID} SELECT k, count(*) AS n_pixels, ~(avg(x * 10.0 + y))~ AS mean FROM t, g WHERE x >= x0 AND y >= y0 AND (x - x0) + (y - y0) <= 8 GROUP BY k")
def polygon_regions(spark, sf_dir):
    """Pixels of triangles and their mean."""
    pixels, polygons = _grid(spark, sf_dir)
    region = geometry.in_convex_polygon(pixels, polygons, ["k"])
    values = pixels.withColumn("v", F.col("x") * 10.0 + F.col("y"))
    return pulse.mean_colour(values, region, ["k", "x", "y"], ["k"], ["v"]).select("k", "n_pixels", F.col("v").alias("mean"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 300 - 20 AS x, o_custkey % 200 - 10 AS y, 20 + o_orderkey % 50 AS w, 20 + o_custkey % 40 AS h FROM orders), p AS (SELECT *, floor(0.3 * greatest(w, h))::INT AS d FROM b),
    q AS (SELECT k, x - d AS x0, y - d AS y0, w + 2 * d AS w0, h + 2 * d AS h0 FROM p) SELECT k, greatest(x0, 0)::INT AS x, greatest(y0, 0)::INT AS y, least(w0 + least(x0, 0), 320 - greatest(x0, 0))::INT AS w, least(h0 + least(y0, 0), 240 - greatest(y0, 0))::INT AS h FROM q""")
def face_boxes(spark, sf_dir):
    """Padded and clipped boxes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), ((k % 300 - 20) / 320.0).alias("x"), ((c % 200 - 10) / 240.0).alias("y"), ((20 + k % 50) / 320.0).alias("w"), ((20 + c % 40) / 240.0).alias("h"), F.lit(320).alias("pw"), F.lit(240).alias("ph"))
    exact = rows.withColumns({n: (F.round(F.col(n) * F.col(s)) + 0.25) / F.col(s) for n, s in (("x", "pw"), ("y", "ph"), ("w", "pw"), ("h", "ph"))})
    return exact.select("k", geometry.face_box("x", "y", "w", "h", "pw", "ph").alias("b")).select("k", "b.*")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 200 AS fx, o_custkey % 150 AS fy, 40 + o_orderkey % 90 AS fw, 40 + o_custkey % 90 AS fh FROM orders),
    s AS (SELECT k, min(struct_pack(y := y.range, x := x.range)) AS s FROM b, range(10, 240 - 10 - 64 + 1) y, range(10, 320 - 10 - 64 + 1) x WHERE (k % 37 = 0) AND NOT (x.range < fx + fw AND x.range + 64 > fx AND y.range < fy + fh AND y.range + 64 > fy) GROUP BY k)
    SELECT k, s.x::BIGINT AS bx, s.y::BIGINT AS by FROM b LEFT JOIN s USING (k) WHERE k % 37 = 0""")
def background_boxes(spark, sf_dir):
    """Where a background square fits beside a face, for the one order in 37 that the SQL's scan of all places compares."""
    return _background_boxes(table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 37 == 0))


@query()
def background_boxes_all(spark, sf_dir):
    """Where a background square fits beside a face, for every order."""
    return _background_boxes(table(spark, sf_dir, "orders"))


def _background_boxes(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders.select(k.alias("k"), F.lit(320).alias("width"), F.lit(240).alias("height"), (k % 200).alias("fx"), (c % 150).alias("fy"), (40 + k % 90).alias("fw"), (40 + c % 90).alias("fh"))
    return geometry.background_box(rows, 64).select("k", F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"))


@query("SELECT video_id, min(struct_pack(d := (value_r - 50) ** 2 + (value_g - 50) ** 2, e := event_id)).e AS event_id FROM (SELECT video_id, event_id, r AS value_r, g AS value_g FROM v_frames) x GROUP BY video_id")
def nearest_faces(spark, sf_dir):
    """The point nearest to a last known one."""
    rows = view(spark, sf_dir, "v_frames").withColumns({"lx": F.lit(50.0), "ly": F.lit(50.0)})
    return geometry.nearest_face(rows, ["video_id"], "r", "g", "lx", "ly", "event_id").select("video_id", "event_id")


@query()
def face_tracks(spark, sf_dir):
    """Tracks folded over each video's points."""
    rows = view(spark, sf_dir, "v_frames").select("video_id", "frame_idx", "event_id", "r", "g")
    return geometry.track_faces(rows, ["video_id"], "frame_idx", "event_id", "r", "g", limit=400.0)


@query("WITH m AS (SELECT video_id, frame_idx // 10 AS f, max(r) AS p FROM v_frames GROUP BY video_id, frame_idx // 10) SELECT video_id, f::BIGINT AS f, p > 60 AS valid FROM m")
def valid_masks(spark, sf_dir):
    """frames whose regions all have pixels."""
    rows = view(spark, sf_dir, "v_frames").select("video_id", F.floor(F.col("frame_idx") / 10).alias("f"), F.lit("face").alias("region"), (F.col("frame_idx") % 10).alias("patch_idx"), F.when(F.col("r") > 60, 1).otherwise(0).alias("pixels"))
    return segments.mask_validity(rows, ["video_id", "f"])


# --- trials and files --------------------------------------------------------------------------------


@query("WITH t AS (SELECT o_orderkey AS trial_id, o_orderpriority AS study, o_totalprice AS loss FROM orders) SELECT study, trial_id, place FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY loss, trial_id) AS place FROM t) r WHERE place <= 5")
def ranked_trials(spark, sf_dir):
    """The best trials of each study."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_orderpriority").alias("study"), F.col("o_totalprice").alias("loss"))
    return trials.rank_trials(rows, "loss", key=["study"]).where("place <= 5").select("study", "trial_id", F.col("place").cast("long").alias("place"))


@query("""WITH p AS (SELECT l_orderkey AS t, concat('filter=', l_linestatus) AS a, concat('signal=', l_returnflag) AS b, concat('order=', l_linenumber) AS c FROM lineitem)
    SELECT a, b, count(*) AS count FROM (SELECT a, b FROM p UNION ALL SELECT a, c FROM p UNION ALL SELECT c, b FROM p) x GROUP BY a, b""")
def parameter_pairs(spark, sf_dir):
    """Parameter values that occur together."""
    rows = table(spark, sf_dir, "lineitem").select(F.create_map(F.lit("filter"), F.col("l_linestatus"), F.lit("signal"), F.col("l_returnflag"), F.lit("order"), F.col("l_linenumber").cast("string")).alias("params"))
    return trials.pair_counts(rows)


@query("SELECT step.range AS step, ~(1e-3 * (1 + cos(pi() * step.range / 100)) / 2)~ AS cosine, ~(1e-3 * 0.95 ** step.range)~ AS exponential FROM range(0, 101) step", digits=9)
def schedules(spark, sf_dir):
    """M3: learning-rate schedules."""
    return spark.range(101).select(F.col("id").alias("step"), trials.learning_rate("cosine", "id", 1e-3, 100).alias("cosine"), trials.learning_rate("exponential", "id", 1e-3, 100).alias("exponential"))


@query("""WITH e AS (SELECT l_linenumber AS epoch, l_orderkey AS run, min(l_extendedprice) AS loss FROM lineitem GROUP BY 1, 2), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
    l AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM b) SELECT run, min(CASE WHEN epoch - last >= 2 THEN epoch END) AS stop_epoch, max(last) AS best_epoch FROM l GROUP BY run""")
def early_stopping(spark, sf_dir):
    """M6: when runs stop improving."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch"), F.col("l_orderkey").alias("run")).agg(F.min("l_extendedprice").alias("loss"))
    return trials.early_stop(rows, ["run"], "epoch", "loss", patience=2)


@query()
def suggested_trials(spark, sf_dir):
    """M7: a conditional parameter table."""
    space = {"cell": ["lstm", "transformer"], "layers": (1, 4, "int"), "rate": (1e-5, 1e-2, "log"), "heads": [2, 4, 8]}
    return trials.suggest(spark, space, 100, conditions={"heads": ("cell", "transformer")})


@query("WITH p AS (SELECT string_split(url, '/') AS p FROM pages) SELECT CASE WHEN len(p) > 2 THEN p[-3] END AS subfolder, CASE WHEN len(p) > 1 THEN p[-2] END AS roi_type, regexp_replace(p[-1], '[.][^.]*$', '') AS video_name, count(*) AS n FROM p GROUP BY ALL")
def path_dimensions(spark, sf_dir):
    """Dimensions from paths."""
    return files.path_columns(table(spark, sf_dir, "pages"), ["subfolder", "roi_type"], "url").groupBy("subfolder", "roi_type", "video_name").agg(F.count("*").alias("n"))


@query("SELECT regexp_replace(url, '/[^/]*$', '') AS folder, count(*) AS n, min(url) AS first FROM pages GROUP BY 1")
def files_by_folder(spark, sf_dir):
    """Files of each folder."""
    return files.by_folder(table(spark, sf_dir, "pages"), "url")


@query("SELECT sample_id, concat('r', cast(kind % 3 AS VARCHAR)) AS region, label, len(signal) AS n FROM v_signals WHERE label = 1 AND kind % 3 IN (0, 2)")
def scanned_signals(spark, sf_dir):
    """Signals written by split and region, and scanned with both pushed down."""
    rows = view(spark, sf_dir, "v_signals").select("sample_id", F.concat(F.lit("r"), (F.col("kind") % 3).cast("string")).alias("region"), F.when(F.col("label") == 1, "train").otherwise("val").alias("split"), "label", "signal")
    folder = scratch(spark, "signals")
    files.save(rows, folder, ["split", "region"])
    return files.scan_signals(spark, folder, "train", ["r0", "r2"]).select("sample_id", "region", "label", F.size("signal").alias("n"))


@query("""SELECT 'results' AS roi_type, concat('region', cast(region_id AS VARCHAR)) AS subfolder, count(*) AS n, ~(max(snr))~ AS best FROM v_results WHERE snr > 20 GROUP BY region_id""", digits=4)
def scanned_results(spark, sf_dir):
    """Sorted results written as CSV by folder, and read back with their folders as columns."""
    rows = view(spark, sf_dir, "v_results").where("snr > 20").select("signal_type", "heart_rate", "snr", "wavelet", F.lit(1).alias("wavelet_level"), "filter", "filter_order", F.concat(F.lit("region"), F.col("region_id").cast("string")).alias("region"), F.lit(-1).alias("patch_idx"))
    folder = scratch(spark, "results")
    files.save_results(rows, folder)
    found = files.path_columns(files.scan_csv(spark, folder, files.RESULT_SCHEMA), ["subfolder", "roi_type"])
    return found.groupBy("roi_type", "subfolder").agg(F.count("*").alias("n"), F.max("snr").alias("best"))


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_jobs(spark, sf_dir):
    """K2 K3: jobs that aren't done yet."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"))
    return files.pending(jobs, done, ["item_id"])


@query("SELECT page_id, method, roi_type FROM pages, (SELECT unnest(['rgb', 'orgb']) AS method) m, (SELECT unnest(['mask', 'patch', 'background']) AS roi_type) r")
def job_grid(spark, sf_dir):
    """Files by method and region kind."""
    return files.job_grid(table(spark, sf_dir, "pages").select("page_id"), ["rgb", "orgb"], ["mask", "patch", "background"])


@query("""WITH s AS (SELECT sample_id, concat('r', cast(kind % 3 AS VARCHAR)) AS region, label, CASE WHEN sample_id % 2 = 0 THEN 'POS' ELSE 'R' END AS signal_type, signal FROM v_signals)
    SELECT sample_id, region, signal_type, len(signal) AS n, ~(list_sum(signal)::DOUBLE)~ AS total FROM s WHERE label = 0 AND sample_id % 128 < 64 AND region IN ('r0', 'r2')""", digits=4)
def feature_files(spark, sf_dir):
    """All signals written as nested feature files in one job, and scanned with class, split and region left to the source."""
    k = F.col("sample_id")
    folder = F.concat(F.when(F.col("label") == 1, "deepfake").otherwise("real"), F.when(k % 128 < 64, "/train").otherwise("/test"), F.lit("/rgb/mask/f"), F.floor(k / 64).cast("string"), F.lit(".npy"))
    rows = view(spark, sf_dir, "v_signals").select(folder.alias("file"), F.concat(F.lit("r"), (F.col("kind") % 3).cast("string")).alias("region"), (k % 64).cast("int").alias("entry"), F.when(k % 2 == 0, "POS").otherwise("R").alias("signal_type"), F.col("signal").cast("array<double>").alias("values"))
    at = scratch(spark, "features")
    features.save_features(rows, at)
    found = features.scan_features(spark, at, ["file", "class", "split", "region", "entry", "signal_type", "values"])
    found = found.where((F.col("class") == "real") & (F.col("split") == "train") & F.col("region").isin("r0", "r2"))
    number = F.regexp_extract("file", "f([0-9]+)[.]npy$", 1).cast("long") * 64 + F.col("entry")
    return found.select(number.alias("sample_id"), "region", "signal_type", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT concat('region', cast(region_id AS VARCHAR)) AS subfolder, 'results' AS roi_type, count(*) AS n, ~(sum(snr))~ AS total FROM v_results WHERE snr > 20 GROUP BY region_id", digits=4)
def ingested_results(spark, sf_dir):
    """Result files taken in two at a time by a stream with a manifest, stopped after its first batch and started again."""
    rows = view(spark, sf_dir, "v_results").where("snr > 20").select("signal_type", "heart_rate", "snr", "wavelet", F.lit(1).alias("wavelet_level"), "filter", "filter_order", F.concat(F.lit("region"), F.col("region_id").cast("string")).alias("region"), F.lit(-1).alias("patch_idx"))
    folder, target, checkpoint = (scratch(spark, n) for n in ("results", "ingested", "stream"))
    files.save_results(rows, folder)
    stops = [RuntimeError("stopped")]

    def stop(_: int) -> None:
        if stops:
            raise stops.pop()

    for _ in range(2):
        try:
            ingest.ingest(spark, folder, files.RESULT_SCHEMA, target, checkpoint, files_per_batch=2, after_write=stop)
        except StreamingQueryException:  # the stop above
            continue
    return ingest.ingested(spark, target).groupBy("subfolder", "roi_type").agg(F.count("*").alias("n"), F.sum("snr").alias("total"))


@query("SELECT video_id, region, segment_id, so_far, ~(mean_snr)~ AS mean_snr FROM (SELECT video_id, CASE WHEN frame_idx % 3 = 0 THEN 'nose' ELSE 'face' END AS region, frame_idx::INT AS segment_id, row_number() OVER w - 1 AS so_far, avg(r) OVER w AS mean_snr FROM v_frames WHERE valid WINDOW w AS (PARTITION BY video_id, CASE WHEN frame_idx % 3 = 0 THEN 'nose' ELSE 'face' END ORDER BY frame_idx)) q")
def running_lists(spark, sf_dir):
    """Outputs of every video's regions through a stream with list state, each with its place and the mean so far."""
    region = F.when(F.col("frame_idx") % 3 == 0, "nose").otherwise("face")
    rows = view(spark, sf_dir, "v_frames").where("valid").select("video_id", region.alias("region"), F.lit(0).cast("long").alias("run_id"), F.col("frame_idx").cast("int").alias("segment_id"), F.col("r").alias("snr"), F.col("ts").cast("timestamp").alias("ts"))
    folder, out, checkpoint = (scratch(spark, n) for n in ("outputs", "running", "stream"))
    rows.write.parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    after = written.groupBy().agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("video_id"), F.lit("end").alias("region"), F.lit(0).cast("long").alias("run_id"), F.lit(0).alias("segment_id"), F.lit(0.0).alias("snr"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), written.count() // 20_000)
    after.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    with running.rocksdb(spark):
        running.stream_running(stream, "1 hour", buckets=buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(out).where("region <> 'end'").select("video_id", "region", "segment_id", "so_far", "mean_snr")


@query()
def pruned_study(spark, sf_dir):
    """M8 M9: nine trials of a classifier of all signals, of which a third goes on from each rung to the next."""
    rows = view(spark, sf_dir, "v_signals").select("sample_id", "label", F.col("signal").cast("array<double>").alias("x"))
    split = balance.split(rows, ["label"], "sample_id")
    return pipelines.halving(spark, split, "x", {"regParam": (1e-4, 1.0, "log"), "elasticNetParam": [0.0, 0.5, 1.0]}).drop("params")


@query("SELECT item, o_orderkey, ~(o_totalprice)~ AS o_totalprice FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS item, o_orderkey, o_totalprice FROM orders) q WHERE item BETWEEN 700 AND 899 OR item % 101 = 0")
def numbered_items(spark, sf_dir):
    """Orders by their number in a folder of files: a slice, and every hundred-and-first."""
    folder = scratch(spark, "items")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("parquet.block.size", 1 << 16).parquet(folder)
    index = items.item_index(spark, folder)
    last = index.agg(F.max(F.col("first") + F.col("rows"))).first()[0] or 0
    numbers = spark.range(700, 900).union(spark.range(0, last, 101)).withColumnRenamed("id", "item")
    return items.items(spark, folder, index, numbers, ["o_orderkey", "o_totalprice"])


@query(f"""WITH s AS (SELECT sample_id, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY {_MIX('sample_id')}, sample_id) - 1 AS n, count(*) OVER (PARTITION BY label) AS t FROM v_signals),
    p AS (SELECT sample_id, label, CASE WHEN n < t - 2 * floor(0.2 * t) THEN 'train' WHEN n < t - floor(0.2 * t) THEN 'val' ELSE 'test' END AS split FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY sample_id) AS k FROM p), c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM p WHERE split = 'train' GROUP BY label) q)
    SELECT sample_id, label, split FROM k, c WHERE split <> 'train' OR k <= least""")
def training_samples(spark, sf_dir):
    """Both classes cleaned, labelled, split, and the training part balanced."""
    rows = view(spark, sf_dir, "v_signals").select("sample_id", "signal", F.col("label").alias("_class"))
    real, fake = (rows.where(F.col("_class") == k).drop("_class") for k in (0, 1))
    return pipelines.training_data(real, fake, "signal", "sample_id").select("sample_id", "label", "split")


@query("""WITH b AS (SELECT region_id, max(struct_pack(snr := snr, k := -l_orderkey, l := -l_linenumber, s := signal_type, f := filter, o := filter_order, w := wavelet, h := l_orderkey)) AS b FROM v_results GROUP BY region_id)
    SELECT region_id, concat('region', region_id, '_', b.s, '_', b.f, '_o', b.o, '_', b.w, '_l1_snr', printf('%.2f', b.snr), '_', strftime(TIMESTAMP '2024-01-01' + to_seconds(b.h % 86400), '%Y%m%d_%H%M%S')) AS name FROM b""")
def result_names(spark, sf_dir):
    """K5 O1: the name of each region's result file, from its best row, with a time."""
    best = F.max(F.struct("snr", (-F.col("l_orderkey")).alias("k"), (-F.col("l_linenumber")).alias("l"), "signal_type", "filter", "filter_order", "wavelet", "l_orderkey"))
    rows = view(spark, sf_dir, "v_results").groupBy("region_id").agg(best.alias("b")).select("region_id", "b.*")
    rows = rows.withColumns({"region": F.concat(F.lit("region"), F.col("region_id").cast("string")), "patch_idx": F.lit(-1), "wavelet_level": F.lit(1)})
    return rows.select("region_id", files.result_name(F.timestamp_seconds(F.lit(1704067200) + F.col("l_orderkey") % 86400)).alias("name"))


@query("SELECT p_brand AS folder FROM part GROUP BY p_brand HAVING count_if(p_size > 49) > 0")
def finished_folders(spark, sf_dir):
    """K3: folders that hold a file, of all that were begun."""
    parts = table(spark, sf_dir, "part")
    made = parts.where("p_size > 49").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"))
    return files.finished(parts.select(F.col("p_brand").alias("folder")).distinct(), made)


@query("SELECT item_id FROM v_items WHERE item_id % 4 > 0 AND item_id % 5 <> 0 AND item_id % 7 <> 0")
def valid_items(spark, sf_dir):
    """rows with a positive rate and results without empty keys or values."""
    k = F.col("item_id")
    results = F.create_map(F.when(k % 5 == 0, "").otherwise(F.col("class")), F.when(k % 7 == 0, F.array().cast("array<double>")).otherwise(F.array("weight")))
    return files.valid_results(view(spark, sf_dir, "v_items").select("item_id", (k % 4).alias("fps"), results.alias("results"))).select("item_id")


@query("SELECT item_id, item_id % 6 >= 4 AS complete FROM v_items")
def landmark_sets(spark, sf_dir):
    """F8: whether all of the required landmarks are among those found."""
    found = F.sequence(F.lit(0), (F.col("item_id") % 6).cast("int"))
    return view(spark, sf_dir, "v_items").select("item_id", found.alias("found")).select("item_id", geometry.complete_landmarks("found", [0, 2, 4]).alias("complete"))
