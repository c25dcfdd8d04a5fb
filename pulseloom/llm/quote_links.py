"""Quotation linking: conversations in reply order, without their quotes.

Lines that start with ``>`` marks are quotes of a level, the number of marks; the rest of
a message is its own text. Passages are sentences (so that a quote may be wrapped
anew), normalised to letters and digits and hashed. A quoted passage belongs to the
latest earlier message of its conversation whose own text holds it. The message with
the most passages of the outermost level is the one replied to; a message without
such a quote follows the one before it.

All of it is DataFrame work. "The latest earlier message" and counts within a
conversation are running aggregates over blocks of turns: totals of blocks first, of
which there are few, then the turns of one block. No task needs the whole of a
conversation, or all messages that share a passage. Chains of replies are followed by
pointer doubling over the messages that quote, in logarithmically many rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.llm.store import stored

BLOCK = 1024
MARKS = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)\b[^\n]{0,60}:\s*$"


def split_lines(text: str) -> Column:
    """Lines as ``array<struct<level:int, body:string>>``; an attribution line right before a deeper level has level -1."""
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\r?\n")
    made = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))
    return F.transform(F.array(made), lambda all_: F.transform(all_, lambda x, i: F.when((F.coalesce(F.get(all_, i + 1)["level"], F.lit(0)) > x["level"]) & x["body"].rlike(ATTRIBUTION), F.struct(F.lit(-1).alias("level"), x["body"].alias("body"))).otherwise(x)))[0]


def passages(lines: Column, level: Column, least_chars: int) -> Column:
    """Distinct hashes of the sentences of one level, in the lines' order."""
    text = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["body"]), " ")
    normal = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.transform(F.filter(normal, lambda s: F.length(s) >= least_chars), lambda s: F.xxhash64(s)))


def whole_lines(lines: Column, level: Column, least_chars: int) -> Column:
    """Distinct hashes of the lines of one level."""
    bodies = F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: F.trim(F.regexp_replace(F.lower(x["body"]), r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.transform(F.filter(bodies, lambda s: F.length(s) >= least_chars), lambda s: F.xxhash64(s)))


def running(rows: DataFrame, keys: list[str], total: Column, before: Column, name: str) -> DataFrame:
    """``rows`` (with turn and block) and a running aggregate over earlier blocks combined with one in the block.

    total: aggregate of a block. before: how totals of blocks combine, over a window. The column
    ``name`` holds the value for all earlier blocks, null for the first.
    """
    blocks = rows.groupBy(*keys, "block").agg(total.alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(blocks.select(*keys, "block", before.over(earlier).alias(name)), [*keys, "block"])


def _votes(messages: DataFrame, hashes: Callable[[Column, Column, int], Column], least_chars: int) -> DataFrame:
    """Quoted hashes of each level of a message by the latest earlier message that holds them: (conv_id, turn, level, source, n)."""
    own = messages.select("conv_id", "turn", F.explode(hashes(F.col("lines"), F.lit(0), least_chars)).alias("h"), F.lit(0).alias("level")).distinct()
    levels = F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda x: x > 0))
    quoted = messages.select("conv_id", "turn", "lines", F.explode(levels).alias("level"))
    quoted = quoted.select("conv_id", "turn", F.explode(hashes(F.col("lines"), F.col("level"), least_chars)).alias("h"), "level").distinct()
    wanted = quoted.select("conv_id", "h").distinct()
    both = own.join(wanted, ["conv_id", "h"], "left_semi").unionByName(quoted).withColumn("block", F.floor(F.col("turn") / BLOCK))
    held = F.when(F.col("level") == 0, F.col("turn"))
    both = running(both, ["conv_id", "h"], F.max(held), F.max("_t"), "_early")
    inside = Window.partitionBy("conv_id", "h", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.greatest(F.max(held).over(inside), F.col("_early"))).where("level > 0")
    return found.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))


def link_quotes(messages: DataFrame, least_chars: int = 1) -> DataFrame:
    """``(conv_id, turn, lines)`` to one row for each quoted level of a message: level, n_passages, n_linked, source_turn (null if none is found).

    Passages are sentences; a level none of whose sentences is found takes the source of its whole lines.
    """
    key = ["conv_id", "turn", "level"]
    best = F.max(F.when(F.col("source").isNotNull(), F.struct("n", "source")))["source"]
    lines = _votes(messages, whole_lines, least_chars).groupBy(*key).agg(best.alias("of_lines"))
    linked = F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0))
    sentences = _votes(messages, passages, least_chars).groupBy(*key).agg(F.sum("n").alias("n_passages"), linked.alias("n_linked"), best.alias("of_sentences"))
    return sentences.join(lines, key, "left").select(*key, "n_passages", "n_linked", F.coalesce("of_sentences", "of_lines").alias("source_turn"))


def reply_order(conversations: DataFrame, least_chars: int = 1) -> DataFrame:
    """One row for each message, with its own text and its place in the replies.

    conv_id, turn, role; parent_turn (the message replied to; null for a conversation's
    first), depth (replies up to the first), place (messages of its conversation with an
    earlier turn: parents come before replies), links (level and source_turn of each quoted level), n_passages, n_linked, own_text.

    Messages with one conv_id and turn are one place: they share links. A null conv_id or
    turn gives a message of its own, without parent. A null text is empty. Other columns
    are ignored; an empty table gives no rows.
    """
    every = conversations.select("conv_id", "turn", "role", split_lines("text").alias("lines"))
    every = stored(every, "messages")
    keyed = every.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    levels = stored(link_quotes(keyed, least_chars), "quotes")
    parents = levels.where("level = 1").select("conv_id", "turn", F.col("source_turn").alias("quoted"))
    links = levels.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("level", "source_turn"))).alias("links"), F.sum("n_passages").alias("n_passages"), F.sum("n_linked").alias("n_linked"))  # a row for each level of a message
    places = keyed.select("conv_id", "turn").distinct().join(parents, ["conv_id", "turn"], "left").withColumn("block", F.floor(F.col("turn") / BLOCK))
    # a message that quotes, or a conversation's first, heads the run of those that follow
    head = F.when(F.col("quoted").isNotNull(), F.col("turn"))
    blocks = places.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.max(head).alias("h"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.max("h").over(earlier).alias("h0"), F.min("first").over(whole).alias("opening"), F.max("last").over(earlier).alias("last0"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    places = places.join(blocks, ["conv_id", "block"]).withColumns({
        "place": F.col("n0") + F.row_number().over(inside) - 1,
        "head": F.coalesce(F.greatest(F.max(head).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("h0")), F.col("opening")),
        "previous": F.coalesce(F.lag("turn").over(inside), F.col("last0")),
    })
    places = stored(places.select("conv_id", "turn", "place", "head", "quoted", F.coalesce("quoted", "previous").alias("parent_turn")), "places")
    # depth of heads: along their quotes, from head to head
    at = places.select("conv_id", F.col("turn").alias("quoted"), F.col("place").alias("q_place"), F.col("head").alias("up"))
    tops = places.select("conv_id", F.col("turn").alias("up"), F.col("place").alias("up_place"))
    heads = places.where("quoted IS NOT NULL").select("conv_id", F.col("turn").alias("head"), "quoted")
    steps = stored(heads.join(at, ["conv_id", "quoted"]).join(tops, ["conv_id", "up"]).select("conv_id", "head", "up", (F.col("q_place") - F.col("up_place") + 1).alias("far")), "steps")
    while True:
        nxt = steps.select("conv_id", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        joined = stored(steps.join(nxt, ["conv_id", "up"], "left").select("conv_id", "head", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("moved")), "steps")
        steps = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    start = places.select("conv_id", F.col("turn").alias("head"), F.col("place").alias("head_place"))
    used = places.select("conv_id", "head").distinct().join(start, ["conv_id", "head"]).join(steps.select("conv_id", "head", "far"), ["conv_id", "head"], "left")
    placed = places.join(used, ["conv_id", "head"]).select("conv_id", "turn", "place", "parent_turn", (F.col("place") - F.col("head_place") + F.coalesce("far", F.lit(0))).alias("depth"))
    facts = placed.join(links, ["conv_id", "turn"], "left")
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"))
    none = F.array().cast("array<struct<level:int,source_turn:bigint>>")
    shown = facts.select("conv_id", "turn", F.col("parent_turn").cast("long"), F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"), F.col("links").cast("array<struct<level:int,source_turn:bigint>>").alias("links"), "n_passages", "n_linked")
    return every.join(shown, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("links", none).alias("links"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), own.alias("own_text"))


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``reply_order`` with links and own texts as numbers and a checksum."""
    return rows.select("conv_id", "turn", "role", "parent_turn", "depth", "place", F.size("links").alias("n_levels"), "n_passages", "n_linked", F.length("own_text").cast("long").alias("own_chars"), F.md5(F.col("own_text").cast("binary")).alias("own_md5"))


def quoting(conversations: str = "conversations") -> str:
    """SQL, for Spark and DuckDB, of conversations whose turns quote: of three turns one quotes the turn before it, and within it the one before that; one quotes the turn before the last; one is left as it is."""
    quoted = lambda text, mark: f"concat('{mark} ', replace({text}, chr(10), concat(chr(10), '{mark} ')), chr(10))"
    return f"""SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 AND p1 IS NOT NULL THEN concat('On Monday someone wrote:', chr(10), CASE WHEN p2 IS NULL THEN '' ELSE concat('> On Sunday someone wrote:', chr(10), {quoted('p2', '>>')}) END, {quoted('p1', '>')}, text)
        WHEN turn % 3 = 2 AND p2 IS NOT NULL THEN concat({quoted('p2', '>')}, text) ELSE text END AS text
        FROM (SELECT conv_id, turn, role, text, lag(text, 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p1, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p2 FROM {conversations}) c"""


def reference_sql(conversations: str = "conversations", least_chars: int = 1) -> str:
    """DuckDB SQL for the rows of ``digest``."""
    marks = MARKS.replace("\\t", "\t")
    attribution = "(?i)^\\s*(on|am|le|el)\\b.{0,200}\\b(wrote|schrieb|écrit|escribió)\\b[^\n]{0,60}:\\s*$"
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    def votes(name: str, units: str) -> str:
        """Relations for the sources of hashed units (conv_id, turn, level, s)."""
        best = "max(CASE WHEN source IS NOT NULL THEN struct_pack(n := n, source := source) END).source"
        return f"""k{name} AS (SELECT * FROM {units} WHERE length(s) >= {least_chars} AND level >= 0),
    q{name} AS (SELECT a.conv_id, a.turn, a.level, a.s, max(b.turn) AS source FROM k{name} a LEFT JOIN k{name} b ON b.conv_id = a.conv_id AND b.s = a.s AND b.level = 0 AND b.turn < a.turn WHERE a.level > 0 GROUP BY a.conv_id, a.turn, a.level, a.s),
    v{name} AS (SELECT conv_id, turn, level, source, count(*) AS n FROM q{name} GROUP BY conv_id, turn, level, source),
    b{name} AS (SELECT conv_id, turn, level, sum(n) AS n_passages, sum(CASE WHEN source IS NOT NULL THEN n ELSE 0 END) AS n_linked, {best} AS source FROM v{name} GROUP BY conv_id, turn, level)"""

    return f"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM {conversations}),
    l0 AS (SELECT rid, unnest(w) AS line, generate_subscripts(w, 1) AS p FROM (SELECT rid, string_split_regex(text, '\r?\n') AS w FROM m) x),
    l1 AS (SELECT rid, p, length(regexp_replace(regexp_extract(line, '{marks}'), '[^>]', '', 'g')) AS level, regexp_replace(line, '{marks}', '') AS body FROM l0),
    l2 AS (SELECT rid, p, body, CASE WHEN coalesce(lead(level) OVER (PARTITION BY rid ORDER BY p), 0) > level AND regexp_matches(body, '{attribution}') THEN -1 ELSE level END AS level FROM l1),
    t AS (SELECT rid, level, string_agg(body, ' ' ORDER BY p) AS text FROM l2 GROUP BY rid, level),
    s AS (SELECT DISTINCT conv_id, turn, level, {normal('x')} AS s FROM (SELECT rid, level, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x FROM t) u JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    w0 AS (SELECT DISTINCT conv_id, turn, level, {normal('body')} AS s FROM l2 JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    {votes('s', 's')}, {votes('w', 'w0')},
    b AS (SELECT a.conv_id, a.turn, a.level, a.n_passages, a.n_linked, coalesce(a.source, l.source) AS source FROM bs a LEFT JOIN bw l ON l.conv_id = a.conv_id AND l.turn = a.turn AND l.level = a.level),
    f AS (SELECT conv_id, turn, count(*) AS n_levels, sum(n_passages) AS n_passages, sum(n_linked) AS n_linked, max(CASE WHEN level = 1 THEN source END) AS quoted FROM b GROUP BY conv_id, turn),
    o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) d),
    e AS (SELECT o.conv_id, o.turn, place, coalesce(quoted, previous) AS parent_turn, n_levels, n_passages, n_linked FROM o LEFT JOIN f ON f.conv_id = o.conv_id AND f.turn = o.turn),
    r AS (SELECT conv_id, turn, 0 AS depth FROM e WHERE parent_turn IS NULL UNION ALL SELECT e.conv_id, e.turn, r.depth + 1 FROM e JOIN r ON e.conv_id = r.conv_id AND e.parent_turn = r.turn),
    w AS (SELECT m.rid, trim(coalesce(string_agg(body, chr(10) ORDER BY p) FILTER (WHERE level = 0), '')) AS own FROM m LEFT JOIN l2 USING (rid) GROUP BY m.rid)
    SELECT m.conv_id, m.turn, m.role, e.parent_turn::BIGINT AS parent_turn, coalesce(r.depth, 0)::BIGINT AS depth, coalesce(e.place, 0)::BIGINT AS place, coalesce(e.n_levels, 0)::INT AS n_levels, coalesce(e.n_passages, 0)::BIGINT AS n_passages,
    coalesce(e.n_linked, 0)::BIGINT AS n_linked, length(own)::BIGINT AS own_chars, md5(own) AS own_md5 FROM m JOIN w USING (rid) LEFT JOIN e ON e.conv_id = m.conv_id AND e.turn = m.turn LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn"""
