"""Views that map the driver's tables to the engine's schemas; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pulseloom.session import table

VIEWS = {
    "v_results": """SELECT l_returnflag AS signal_type, l_linestatus AS filter, l_linenumber AS filter_order,
        concat('w', cast(l_suppkey % 10 AS string)) AS wavelet, cast(l_partkey % 5 AS int) AS region_id,
        concat('split', cast(year(l_shipdate) % 3 AS string)) AS subfolder,
        10 * log10(l_extendedprice * (1 - l_discount)) - l_quantity AS snr,
        30 + 3 * l_quantity AS heart_rate, l_orderkey, l_linenumber FROM lineitem""",
    "v_frames": """SELECT user_id AS video_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
        event_type <> 'error' AS valid, value AS r, cast(regexp_extract(props, '([0-9]+)', 1) AS double) AS g,
        cast(10 + (event_id * 7) % 13 AS double) AS b FROM events""",
    "v_signals": "SELECT vec_id AS sample_id, embedding AS signal, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, label AS kind FROM embeddings",
    "v_predictions": """SELECT l.doc_id, l.quality AS y, 1 / (1 + exp(-(d.n_chars - 1000) / 1000e0)) AS score, d.lang AS stage
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_items": "SELECT o_orderkey AS item_id, o_orderstatus AS class, o_custkey AS parent, o_totalprice AS weight FROM orders",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a Spark frame."""
    sql, used = VIEWS[name], {}
    for t in TABLES:
        sql, n = re.subn(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        if n:
            used[t] = table(spark, sf_dir, t)
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it names put in front."""
    named = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    head = "WITH " + ", ".join(named)
    return f"{head}, {sql[4:].lstrip()}" if sql.lstrip().upper().startswith("WITH ") else f"{head} {sql}"
