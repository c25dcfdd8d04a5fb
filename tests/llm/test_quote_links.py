import re

import duckdb
import pytest

from pulseloom.llm import quote_links as ql

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows, least=8):
    def lines(text):
        out = []
        for x in re.split(r"\r?\n", text or ""):
            m = re.match(ql.MARKS, x)
            out.append([m.group(0).count(">") if m else 0, x[m.end() :] if m else x])
        for i in range(len(out) - 1):
            if out[i][0] == 0 and out[i + 1][0] > 0 and re.match(ql.ATTRIBUTION, out[i][1]):
                out[i][0] = -1
        return out

    def sentences(ls, level):
        text = " ".join(b for k, b in ls if k == level)
        norm = (re.sub(r"[\W_]+", " ", s.lower()).strip() for s in re.split(r"(?<=[.!?])\s+", text))
        return {s for s in norm if len(s) >= least}

    keyed = {}
    for c, t, _, text, _ in rows:
        if c is not None and t is not None:
            keyed.setdefault(c, {}).setdefault(t, []).append(lines(text))
    facts = {}
    for c, turns in keyed.items():
        order = sorted(turns)
        own = {t: set().union(*(sentences(x, 0) for x in turns[t])) for t in order}
        depth = {}
        for place, t in enumerate(order):
            links, n, hit = [], 0, 0
            for level in sorted({k for x in turns[t] for k, _ in x if k > 0}):
                quoted = set().union(*(sentences(x, level) for x in turns[t]))
                if not quoted:
                    continue
                votes = {}
                for q in quoted:
                    source = max((u for u in order if u < t and q in own[u]), default=None)
                    n += 1
                    if source is not None:
                        hit += 1
                        votes[source] = votes.get(source, 0) + 1
                links.append((level, max(votes, key=lambda u: (votes[u], u)) if votes else None))
            parent = dict(links).get(1)
            if parent is None:
                parent = order[place - 1] if place else None
            depth[t] = 0 if parent is None else depth[parent] + 1
            facts[c, t] = (parent, depth[t], place, links, n, hit)
    return facts


ROWS = [
    (1, 0, "user", "How does it work? I really want to know.", "x"),
    (1, 1, "assistant", "It works by magic. There is no other way.", "x"),
    (1, 2, "user", "On Monday someone wrote:\n> It works by MAGIC.\n> There is\n> no other way!\nAre you sure about that?", "x"),
    (1, 3, "assistant", ">> It works by magic.\n> Are you sure about that?\nYes, quite sure.", "x"),
    (1, 4, "user", "> How does it work?\n> I really want to know.\nBack to this first question.", "x"),
    (1, 5, "assistant", "Fine, as before.", "x"),
    (1, 6, "user", "> Never said by anybody here.\n> > Yes, quite sure.\nWhat about it?", "x"),
    (2, 0, "user", "> Are you sure about that?\nAnother conversation.", "x"),
    (2, 7, "user", None, "x"),
    (2, 7, "user", "> Another conversation.\nTwice the same turn.", "x"),
    (2, 9, "user", "", "x"),
    (None, 3, "user", "> Another conversation.\nLost one.", "x"),
    (3, None, "user", "No turn.", "x"),
]


def check(spark, rows, block=None, monkeypatch=None):
    want = brute(rows)
    got = ql.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        found = (r["parent_turn"], r["depth"], r["place"], [tuple(x) for x in r["links"]], r["n_passages"], r["n_linked"])
        assert found == want.get((r["conv_id"], r["turn"]), (None, 0, 0, [], 0, 0))
    return got


def test_links_order_and_own_text(spark):
    got = check(spark, ROWS)
    own = {(r["conv_id"], r["turn"], r["own_text"]) for r in got}
    assert (1, 2, "Are you sure about that?") in own and (1, 3, "Yes, quite sure.") in own and (2, 9, "") in own
    parents = {r["turn"]: r["parent_turn"] for r in got if r["conv_id"] == 1}
    assert parents == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 4, 6: 5}


@pytest.mark.parametrize("block", [3, 1024])
def test_long_conversation_with_common_passages(spark, monkeypatch, block):
    monkeypatch.setattr(ql, "BLOCK", block)
    rows = [(5, t, "user", f"Same words every time. Message number {t} here." + (f"\n> Message number {t * 7 % max(t, 1)} here.\n> Same words every time." if t % 3 == 1 else ""), "x") for t in range(60)]
    check(spark, rows + [(6, t, "user", "Same words every time.", "x") for t in range(4)])


def test_empty(spark):
    assert ql.reply_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_duckdb(spark):
    rows = ROWS + [(8, t, "user", f"Common words for all. Number {t} of many.\n" + (f"> Common words for all.\n>> Number {t - 2} of many.\n" if t % 2 else ""), "x") for t in range(12)]
    same_as_duckdb(spark, rows, ql.reference_sql(), spark.createDataFrame(rows, SCHEMA))


def same_as_duckdb(spark, rows, sql, frame):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, depth VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    key = lambda r: tuple((x is None, x) for x in r)
    got = ql.digest(ql.reply_order(frame)).collect()
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(result.fetchall(), key=key)
    return got


def test_made_quotes_link(spark):
    rows = [(c, t, "user", f"Talk {c} begins turn {t} here. It has\nsome lines, of {c * t}.\n- item {t}", "x") for c in range(6) for t in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.createOrReplaceTempView("quoting_test")
    made = spark.sql(ql.quoting("quoting_test"))
    got = same_as_duckdb(spark, rows, ql.reference_sql(f"({ql.quoting()}) q"), made)
    assert sum(r["n_linked"] for r in got) > 100 and max(r["n_levels"] for r in got) == 2
    parents = {r["turn"]: r["parent_turn"] for r in got if r["conv_id"] == 3}
    assert parents == {0: None, 1: 0, 2: 0, 3: 2, 4: 3, 5: 3, 6: 5, 7: 6, 8: 6}
    own = {r["turn"]: r["own_chars"] for r in got if r["conv_id"] == 3}
    assert own == {t: len(rows[27 + t][3]) for t in range(9)}


def test_very_long_message(spark):
    rows = [(1, 0, "user", " ".join(f"Sentence number {k} of many." for k in range(20_000)), "x"), (1, 1, "user", "Between.", "x"), (1, 2, "user", "> Sentence number 19999 of many.\nFound.", "x")]
    got = {r["turn"]: r for r in ql.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["parent_turn"] == 0 and got[0]["n_passages"] == 0


def test_nested_attributions_short_sentences_and_lines_link(spark):
    rows = [
        (1, 0, "user", "Shall we?", "x"),
        (1, 1, "user", "Yes.", "x"),
        (1, 2, "user", "Here is my list\n- first thing\n- second thing", "x"),
        (1, 3, "user", "> Yes.\nGood to know.", "x"),
        (1, 4, "user", "> - second thing\nNot that one.", "x"),
        (1, 5, "user", "On Monday A wrote:\n> On Monday B wrote:\n>> Yes.\n> Good to know.\nSo it is.", "x"),
    ]
    got = {r["turn"]: r for r in ql.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: r["parent_turn"] for t, r in got.items()} == {0: None, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert [tuple(x) for x in got[5]["links"]] == [(1, 3), (2, 1)] and got[5]["own_text"] == "So it is."
    assert (got[5]["n_passages"], got[5]["n_linked"]) == (2, 2)
