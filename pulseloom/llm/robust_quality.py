"""Quality rules by robust multivariate outliers, in DataFrame and SQL operations only.

Five statistics of a text are transformed to a vector. For each language and source
the minimum-covariance-determinant estimate is sought: the centre and covariance of the
three quarters of the rows whose covariance has the least determinant.

1. Six starts, each a robust first estimate from sums: medians with spreads, bounded scores
   (tanh), spatial signs, rows weighted by nearness, and the lower and upper half by length.
2. Two concentration steps from each start: distances from the estimate, the closest three
   quarters, their estimate.
3. The start whose determinant is least goes on until no group's determinant changes.
4. Rows within the 97.5 % distance give the final, reweighted estimate. Rows beyond the
   chi-squared point ``REJECT`` are rejected.

A statistic's spread, given those before it, is never taken as less than its floor in
``FLOORS``: counts that are zero in nearly every text would otherwise have no variance.

Everything but the statistics is SQL that also runs elsewhere: see ``reference_sql``.
No step needs the rows of a group together. Medians and the cut at three quarters are
taken from histograms of fixed-width bins, means and covariances from sums, so a hot
source is pre-aggregated like any other and estimates are one small row a group.

Defined cases: a null text has no words and fails the base rule. Null languages and
sources are groups of their own. Groups with fewer than ``least`` passing rows are
pooled by language, then all together; if even that pool is smaller, its rows are
kept. Repeated rows count each. Rows tied at a cut (in one bin of log distance, 1.6 % wide) are
all inside. An empty table gives an empty result. Columns other than text, lang and source
are carried along.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.store import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
P = 5
#: Steps from every start, and at most from the best of them.
FIRST, MOST = 2, 10
STARTS = 6
#: Five rows for each statistic.
LEAST = 25
SHARE = 0.75
#: Chi-squared with five degrees of freedom: its 97.5 % point, and the factors that make the covariances
#: of the rows within the 75 % and the 97.5 % point consistent.
REWEIGHT = 12.83
CONSISTENCY = "1.412e0"
REWEIGHTED = "1.055e0"
#: Chi-squared point (five degrees, one in 10**9) beyond which a squared distance is rejected.
REJECT = 50.7
#: Least spread of each transformed statistic: below it, differences don't matter.
FLOORS = (0.25, 0.04, 0.5, 0.75, 0.5)

#: The transformed vector; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are columns.
VECTOR = (
    "ln(1e0 + n_words)",
    "ln((1e0 + word_chars) / (1e0 + n_words))",
    "ln(1e0 + 1000e0 * n_symbols / (1e0 + word_chars))",
    "ln(1e0 + 1000e0 * n_dup_lines / (1e0 + n_words))",
    "ln(1e0 + 100e0 * n_repeat_words / (1e0 + n_words))",
)
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    own = {x: f"{x}_{uuid.uuid4().hex[:8]}" for x in ("t", "w", "h", "g", "s", "d")}
    t, w, h, g, s, d = own.values()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = docs.drop(*names).withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn(w, F.filter(F.split(t, SPACE), lambda x: x != ""))
    rows = rows.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": F.expr(f"aggregate(array(filter(split({t}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), 0L, (a, x) -> a + size(x) - size(array_distinct(x)))"),
        h: F.transform(w, lambda x: F.xxhash64(x)),
    })
    rows = rows.withColumn(g, F.expr(f"transform(slice({h}, 1, greatest(size({h}) - 2, 0)), (x, i) -> xxhash64(x, get({h}, i + 1), get({h}, i + 2)))"))
    rows = rows.withColumn(s, F.expr(f"CASE WHEN size(array_distinct({g})) < size({g}) THEN array_sort(transform({g}, (x, i) -> struct(x AS h, i AS p))) END"))
    # places of windows that occur twice or more, in order
    rows = rows.withColumn(d, F.expr(f"array_sort(transform(filter({s}, (x, i) -> x.h = get({s}, i - 1).h OR x.h = get({s}, i + 1).h), x -> x.p))"))
    # a window adds the words that the one before it didn't cover
    rows = rows.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate({d}, struct(-3 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n), 0L)"))
    return rows.withColumn("base_failed", F.expr(BASE_FAILED)).drop(t, w, h, g, s, d)


#: Name of a row's language and source.
_PAIR = "concat('2|', coalesce(lang, '-'), '|', coalesce(source, '-'), CASE WHEN lang IS NULL THEN '|L' ELSE '' END, CASE WHEN source IS NULL THEN '|S' ELSE '' END)"


def _pooled(stats: str, least: int) -> list[tuple[str, str]]:
    """Relations that give each passing row its group and vector. A group's name shows its level."""
    vector = ", ".join(f"{x} AS x{i}" for i, x in enumerate(VECTOR, 1))
    one = "concat('1|', coalesce(lang, '-'), CASE WHEN lang IS NULL THEN '|L' ELSE '' END)"
    return [
        ("passing", f"SELECT rid, {_PAIR} AS k2, {one} AS k1, {vector} FROM {stats} WHERE NOT base_failed"),
        ("n2", "SELECT k2, k1, count(*) AS n FROM passing GROUP BY k2, k1"),
        ("m1", f"SELECT k1, sum(n) AS n FROM n2 WHERE n < {least} GROUP BY k1"),
        ("m0", f"SELECT sum(n) AS n FROM m1 WHERE n < {least}"),
        ("homes", f"SELECT a.k2, CASE WHEN a.n >= {least} THEN a.k2 WHEN b.n >= {least} THEN a.k1 WHEN c.n >= {least} THEN '0' END AS k FROM n2 a LEFT JOIN m1 b ON b.k1 = a.k1 CROSS JOIN m0 c"),
    ]


def _medians() -> list[tuple[str, str]]:
    """Relations for each group's medians and spreads, from histograms of 1/64 wide bins."""
    each = " UNION ALL ".join(f"SELECT k, {i} AS f, CAST(floor(x{i} * 64) AS BIGINT) AS b FROM rows0" for i in range(1, P + 1))
    med = ", ".join(f"max(CASE WHEN m.f = {i} THEN m.m END) AS med{i}, greatest(max(CASE WHEN m.f = {i} THEN a.s END), {FLOORS[i - 1]}) AS s{i}" for i in range(1, P + 1))
    return [
        ("bins", f"SELECT k, f, b, count(*) AS n FROM ({each}) e GROUP BY k, f, b"),
        ("cum", "SELECT k, f, b, sum(n) OVER (PARTITION BY k, f ORDER BY b) AS upto, sum(n) OVER (PARTITION BY k, f) AS total FROM bins"),
        ("med", "SELECT k, f, (min(b) + 0.5e0) / 64e0 AS m FROM cum WHERE 2 * upto >= total GROUP BY k, f"),
        ("dev", "SELECT c.k, c.f, abs((c.b + 0.5e0) / 64e0 - m.m) AS a, c.n FROM bins c JOIN med m ON m.k = c.k AND m.f = c.f"),
        ("devcum", "SELECT k, f, a, sum(n) OVER (PARTITION BY k, f ORDER BY a) AS upto, sum(n) OVER (PARTITION BY k, f) AS total FROM dev"),
        ("mads", "SELECT k, f, 1.4826e0 * min(a) AS s FROM devcum WHERE 2 * upto >= total GROUP BY k, f"),
        ("scale", f"SELECT m.k, {med} FROM med m JOIN mads a ON a.k = m.k AND a.f = m.f GROUP BY m.k"),
    ]


def _distance(centre: str) -> str:
    """Each row's squared distance from its group's centre and triangular factor, as d2, for every start that ``centre`` holds."""
    ys = []
    for i in range(1, P + 1):
        less = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        ys.append(f"(z{i} - m{i}{less}) / l{i}{i} AS y{i}")
    total = " + ".join(f"y{i} * y{i}" for i in range(1, P + 1))
    return f"SELECT rid, k, s, {ZS}, {total} AS d2 FROM (SELECT r.rid, r.k, c.s, {ZS}, {', '.join(ys)} FROM zs r JOIN {centre} c ON c.k = r.k) y"


ZS = ", ".join(f"z{i}" for i in range(1, P + 1))


def _estimate(source: str, factor: str) -> str:
    """Centre, triangular factor and log determinant of the rows (k, s, weight w, z1..) of a relation; covariances scaled by ``factor``, spreads kept at their floors."""
    sums = ", ".join([f"sum(w * z{i}) / sum(w) AS m{i}" for i in range(1, P + 1)] + [f"sum(w * z{i} * z{j}) / sum(w) AS q{i}{j}" for i in range(1, P + 1) for j in range(1, i + 1)])
    steps = []
    for j in range(1, P + 1):
        for i in range(j, P + 1):
            c = f"{factor} * (q{i}{j} - m{i} * m{j})"
            less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            steps.append(f"sqrt(greatest({c}{less}, f{i})) AS l{i}{i}" if i == j else f"({c}{less}) / l{j}{j} AS l{i}{j}")
    lines = ", ".join(f"l{i}{j}" for i in range(1, P + 1) for j in range(1, i + 1))
    means = ", ".join(f"m{i}" for i in range(1, P + 1))
    determinant = " + ".join(f"2e0 * ln(l{i}{i})" for i in range(1, P + 1))
    floors = ", ".join(f"{x}e0 * {x}e0 / (g.s{i} * g.s{i}) AS f{i}" for i, x in enumerate(FLOORS, 1))
    return f"SELECT k, s, {means}, {lines}, {determinant} AS ld FROM (SELECT k, s, {means}, {', '.join(steps)} FROM (SELECT q.*, {floors} FROM (SELECT k, s, {sums} FROM {source} GROUP BY k, s) q JOIN scale g ON g.k = q.k) f) e"


def _step(step: int, centre: str) -> list[tuple[str, str]]:
    """One concentration step: the closest three quarters of each group (whole bins of log distance), and their estimate."""
    return [
        (f"d{step}", f"SELECT *, CAST(floor(64 * ln(0.0001e0 + d2)) AS BIGINT) AS b FROM ({_distance(centre)}) d"),
        (f"b{step}", f"SELECT k, s, b, sum(n) OVER (PARTITION BY k, s ORDER BY b) AS upto, sum(n) OVER (PARTITION BY k, s) AS total FROM (SELECT k, s, b, count(*) AS n FROM d{step} GROUP BY k, s, b) h"),
        (f"t{step}", f"SELECT k, s, min(b) AS cut FROM b{step} WHERE upto >= {SHARE} * total GROUP BY k, s"),
        (f"c{step + 1}", _estimate(f"(SELECT d.*, 1e0 AS w FROM d{step} d JOIN t{step} t ON t.k = d.k AND t.s = d.s WHERE d.b <= t.cut) i", CONSISTENCY)),
    ]


def _starts() -> list[tuple[str, str]]:
    """Scaled rows, and the first estimates of all starts (c0)."""
    zs = ", ".join(f"(r.x{i} - s.med{i}) / s.s{i} AS z{i}" for i in range(1, P + 1))
    square = " + ".join(f"z{i} * z{i}" for i in range(1, P + 1))
    weighted = [
        (1, "1e0", "1e0 - 2e0 / (1e0 + exp(least(2e0 * z{i}, 60e0)))"),
        (2, "1e0", "z{i} / sqrt(1e-12 + r2)"),
        (3, "1e0 / (1e0 + r2)", "z{i}"),
        (4, "CASE WHEN z1 <= 0 THEN 1e0 ELSE 1e-3 END", "z{i}"),
        (5, "CASE WHEN z1 <= 0 THEN 1e-3 ELSE 1e0 END", "z{i}"),
    ]
    seeds = " UNION ALL ".join(f"SELECT k, {s} AS s, {w} AS w, {', '.join(z.replace('{i}', str(i)) + f' AS z{i}' for i in range(1, P + 1))} FROM sized" for s, w, z in weighted)
    plain = ", ".join([f"0e0 AS m{i}" for i in range(1, P + 1)] + [f"{'1e0' if i == j else '0e0'} AS l{i}{j}" for i in range(1, P + 1) for j in range(1, i + 1)])
    return [
        ("zs", f"SELECT r.rid, r.k, {zs} FROM rows0 r JOIN scale s ON s.k = r.k"),
        ("sized", f"SELECT k, {ZS}, {square} AS r2 FROM zs"),
        ("seeds", seeds),
        ("c0", f"SELECT k, 0 AS s, {plain}, 0e0 AS ld FROM scale UNION ALL {_estimate('seeds', '1e0')}"),
    ]


def _best() -> tuple[str, str]:
    """Of each group's starts the one whose determinant is least after the first steps."""
    return ("best", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(ld, 6), s) AS place FROM c{FIRST}) p WHERE place = 1")


def _last() -> list[tuple[str, str]]:
    """The reweighted estimate: of the rows within the 97.5 % distance."""
    return [
        ("near", f"SELECT *, 1e0 AS w FROM ({_distance(f'c{MOST}')}) d WHERE d2 <= {REWEIGHT}"),
        ("final", _estimate("near", REWEIGHTED)),
    ]


def estimates(stats: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """From statistics with base_failed, lang and source: for each language and source (k2) the medians, spreads, centre, factor and log determinant of its group.

    Each step reads the stored vectors again and leaves one stored row a group. Steps end when no determinant changes.
    """
    spark = stats.sparkSession
    at: dict[str, DataFrame] = {"stats": stats}

    def make(relations: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> None:
        for name, sql in relations:
            for old in sorted(at, key=len, reverse=True):
                sql = _named(sql, old)
            made = spark.sql(sql, **at)
            at[name] = stored(made, name) if name in keep else made

    make(_pooled("stats", least), ("homes",))
    make([("rows0", _ROWS), *_medians()], ("rows0", "bins", "scale"))
    make(_starts(), ("zs", "c0"))
    for step in range(FIRST):
        make(_step(step, f"c{step}"), (f"c{step + 1}",))
    make([_best()], ("best",))
    now = at["best"]
    for step in range(FIRST, most):
        at["now"] = now
        make(_step(step, "now"), (f"c{step + 1}",))
        then, now = now, at[f"c{step + 1}"]
        moved = then.select("k", F.col("ld").alias("was")).join(now.select("k", "ld"), "k").agg(F.max(F.abs(F.col("ld") - F.col("was"))).alias("by")).first()["by"]
        if moved is None or moved < 1e-9:
            break
    at[f"c{MOST}"] = now
    make(_last(), ("final",))
    # stored, so that its true size decides whether it is broadcast to the texts or joined by a shuffle
    return stored(at["homes"].join(at["scale"], "k").join(at["final"].drop("s"), "k").drop("k"), "estimates")


_ROWS = f"SELECT p.rid, h.k, {', '.join(f'p.x{i}' for i in range(1, P + 1))} FROM passing p JOIN homes h ON h.k2 = p.k2 WHERE h.k IS NOT NULL"


def _named(sql: str, name: str) -> str:
    """The SQL with a relation's name in FROM and JOIN made a placeholder."""
    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def judged(stats: DataFrame, found: DataFrame) -> DataFrame:
    """``stats`` with distance (null where no group is large enough, or the base rule failed) and kept."""
    own = stats.columns
    rows = stats.withColumn("k2", F.expr(_PAIR)).join(found, "k2", "left")
    for i, x in enumerate(VECTOR, 1):
        less = "".join(f" - l{i}{j} * _y{j}" for j in range(1, i))
        rows = rows.withColumn(f"_y{i}", F.expr(f"(({x} - med{i}) / s{i} - m{i}{less}) / l{i}{i}"))
    total = F.expr(" + ".join(f"_y{i} * _y{i}" for i in range(1, P + 1)))
    distance = F.when(~F.col("base_failed"), F.sqrt(total))
    return rows.select(*own, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(total <= REJECT, F.lit(True))).alias("kept"))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _texts(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])


def quality_verdicts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the five statistics, base_failed, distance and kept for every row of ``docs``."""
    stats = with_statistics(_texts(docs, F.col("doc_id")))
    stats = stored(stats.drop("text").withColumn("rid", F.lit(0)), "statistics")
    return judged(stats, estimates(stats, least)).select("doc_id", *STATS, "distance", "kept")


def keep_good(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. They are stored once with their statistics, which are costlier to take than texts are to write."""
    whole = with_statistics(_texts(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    rows = stored(whole.drop("text").withColumn("rid", F.lit(0)), "statistics")
    return judged(rows, estimates(rows.drop("doc"), least)).where("kept").select("doc.*")


def reference_sql(documents: str = "documents", least: int = LEAST, most: int = MOST) -> str:
    """DuckDB SQL for ``quality_verdicts`` over a table with unique doc_id, without the distance."""
    space = r"[\x20\x09-\x0D]+"
    ctes = [
        ("texts", f"SELECT doc_id, lang, source, coalesce(text, '') AS text FROM {documents}"),
        ("words", f"SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w FROM texts) s"),
        ("counts", "SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id"),
        ("windows", "SELECT doc_id, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)"),
        ("repeated", "SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL) r WHERE n > 1"),
        ("repeats", "SELECT doc_id, count(DISTINCT p + o) AS n FROM repeated, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id"),
        ("lines", "SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id"),
        ("base", f"""SELECT t.doc_id, t.lang, t.source, coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars,
            length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM texts t LEFT JOIN counts c USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)"""),
        ("stats", f"SELECT *, doc_id AS rid, {BASE_FAILED} AS base_failed FROM base"),
        *_pooled("stats", least), ("rows0", _ROWS), *_medians(), *_starts(),
        *[x for step in range(FIRST) for x in _step(step, f"c{step}")], _best(),
        *[x for step in range(FIRST, most) for x in _step(step, f"c{step}" if step > FIRST else "best")],
        *([] if most == MOST else [(f"c{MOST}", f"SELECT * FROM {f'c{most}' if most > FIRST else 'best'}")]), *_last(),
        ("judged", _distance("final")),
    ]
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return f"WITH {body}\nSELECT s.doc_id, {', '.join('s.' + x for x in STATS)}, NOT s.base_failed AND coalesce(j.d2 <= {REJECT}, true) AS kept FROM stats s LEFT JOIN judged j ON j.rid = s.doc_id"
