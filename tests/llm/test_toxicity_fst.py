import zlib
from dataclasses import replace

import numpy as np
import pytest

from pulseloom.llm import toxicity_fst as tf

MODEL = tf.Model(["idiot", "moron"], ["achkeit"], ["zzl"])


def names_of(text, model=MODEL):
    found = tf.Matcher(model).clauses(text)
    assert len(found) <= 1
    return tf.grammar().best(found[0], model.weights)[1] if found else None


@pytest.mark.parametrize("text, names", [
    ("you are an idiot", "insult bare direct"),
    ("what an idiot", "insult bare"),
    ("idiot, look at you", "insult bare direct"),
    ("what an idiot moron", "insult insult again bare"),
    ("you are not an idiot", "insult negated"),
    ("he said what an idiot", "insult reported"),
    ('the word "idiot" is old', "insult reported"),
    ("I will kill you", "threat"),
    ("you I will kill", "threat"),
    ("do not kill him", ""),
    ("kill the old process", ""),
    ("achkeitung hier", "insult bare"),
    ("what a zzla", "slur bare"),
    ("not a zzla", ""),
    ("not a single old one of them idiot", "insult bare direct"),
    ("not today. idiot", "insult bare"),
])
def test_clauses(text, names):
    assert sorted(names_of(text)) == sorted(names.split())


@pytest.mark.parametrize("text", ["", "nothing here", "idiotic", "xidiot", "\n\n...!"])
def test_nothing_found(text):
    assert names_of(text) is None


def brute_readings(machine, symbols, state=0):
    """Every (outputs, names) by which one machine reads the symbols."""
    if not symbols:
        return [((), ())] if state in machine.final else []
    found = []
    for target, output, names in machine.arcs.get((state, symbols[0]), []):
        for outs, more in brute_readings(machine, symbols[1:], target):
            found.append((((output,) if output else ()) + outs, names + more))
    return found


def brute_best(symbols, weights):
    """The heaviest of all readings by the cascade, machine after machine, without composition."""
    readings = {(tuple(symbols), ())}
    for part in tf.CASCADE:
        machine = part()
        readings = {(outs, tuple(sorted(names + more))) for inputs, names in readings for outs, more in brute_readings(machine, inputs)}
    return max(sum(weights[x] for x in names) for _, names in readings)


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(8)
    kinds = ["insult", "slur", "threat", "target", "negation", "report", "quote", "word", "word"]
    several = 0
    for k in range(150):
        symbols = list(rng.choice(kinds, rng.integers(1, 8)))
        weights = dict(zip(tf.NAMES, rng.normal(0, 2, len(tf.NAMES)))) if k % 2 else tf.PRIOR
        assert tf.grammar().best(symbols, weights)[0] == pytest.approx(brute_best(symbols, weights))
        several += len(brute_readings(tf.grammar(), symbols)) > 1
    assert several > 60  # many clauses have more than one path


def test_weights_of_arcs_decide():
    text = "she said he is a zzla. you zzla! what a moron idiot."
    matcher = tf.Matcher(MODEL)
    before = [matcher.path(c)[1].tolist() for c in matcher.clauses(text)]
    changed = tf.Matcher(replace(MODEL, weights=tf.PRIOR | {"reported": -0.1, "again": -1.0}))
    after = [changed.path(c)[1].tolist() for c in changed.clauses(text)]
    assert [a == b for a, b in zip(before, after)] == [False, True, True]  # another path is best
    assert changed.score(text) != matcher.score(text)
    for name in ("slur", "bare", "direct", "insult"):
        assert tf.Matcher(replace(MODEL, weights=tf.PRIOR | {name: tf.PRIOR[name] + 1})).score(text) > matcher.score(text)


def test_long_plain_runs_change_nothing():
    machine = tf.grammar()
    for start in (["target"], ["negation"], ["report"], ["threat"], ["insult"]):
        short, long = (machine.best(start + ["word"] * n + ["insult"], tf.PRIOR) for n in (tf.REACH, 40))
        assert short == long
    text = "you " + "word " * 200_000 + "idiot"
    assert tf.Matcher(MODEL).clauses(text) == [("target", *["word"] * tf.REACH, "insult")]


def test_composition_is_relational_composition():
    a, b = tf.Transducer(final={0}), tf.Transducer(final={1})
    a.add(0, "x", 0, "p", "one")
    a.add(0, "x", 0, "q")
    a.add(0, "y", 0)
    b.add(0, "p", 0)
    b.add(0, "q", 1, None, "three")
    b.add(1, "p", 1)
    c = a.compose(b)
    weights = {"one": 1.0, "three": 3.0}
    assert c.best(["x", "y", "x"], weights) == (4.0, ("one", "three")) or c.best(["x", "y", "x"], weights) == (4.0, ("three", "one"))
    assert c.best(["y"], weights) is None


def test_learns_words_and_stems_and_leaves_clean_alone(spark):
    rng = np.random.default_rng(3)
    common = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows, labels = [], []
    for k in range(1200):
        words = list(rng.choice(common, 60))
        toxic = int(k % 8 == 0)
        if toxic:
            words[int(rng.integers(60))] = str(rng.choice(["zlob", "grunk", "frobtion" + str(rng.choice(common))]))
        rows.append((k, " ".join(words) + ".", "en", 0.5))
        if k % 2 == 0:
            labels.append((k, toxic))
    rows += [(5001, None, "en", 1.0), (5002, "", "en", 1.0), (None, "zlob", "en", 1.0), (16, rows[16][1], "xx", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (5001, None), (0, 1)], "doc_id long, toxic int")
    got = tf.score_documents(docs, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["predicted"] == 1 and not r["held_out"]
        else:
            assert r["predicted"] == int(r["doc_id"] % 8 == 0 and r["doc_id"] < 5000)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you will kill you"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["doc_id"]: r["predicted"] for r in tf.score_documents(docs, none).collect()} == {1: 1, 2: 0}
    assert tf.score_documents(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []


def test_conflicting_labels_and_repeated_documents(spark):
    """An id with both labels counts as toxic, whatever order the rows come in; repeated ids give the fit one text each."""
    rng = np.random.default_rng(31)
    words = [f"plain{k}" for k in range(60)]
    text = lambda k: " ".join(rng.choice(words, 12)) + (" grunk zlobber." if k % 2 else ".")
    rows = [(k, text(k)) for k in range(120)]
    docs = spark.createDataFrame(rows + [rows[1]] * 50 + [(3, "another text")], "doc_id long, text string")
    both = [(k, k % 2) for k in range(120)] + [(k, 0) for k in range(1, 120, 4)]
    models = [tf.train(docs.repartition(n), spark.createDataFrame(order, "doc_id long, toxic int")) for n, order in ((1, both), (3, both[::-1]))]
    assert models[0] == models[1] and {"grunk", "zlobber"} <= set(models[0].words)


def clauses_that_decide(rng, n):
    """Texts whose slurs and threat verbs occur in toxic and clean ones alike: only how a clause is built tells them apart."""
    slurs, plain = ["zlobber", "grunkel", "frobnik"], [f"{a}{b}o" for a in "bdfgklmnprst" for b in ("an", "el", "ir", "um")]
    say = lambda k: " ".join(rng.choice(plain, k))
    kinds = [
        (0.30, 1, lambda s: f"you are a {s} {say(1)}"), (0.20, 1, lambda s: f"{say(1)} a {s} {rng.choice(slurs)} {s}"), (0.10, 1, lambda s: f"{say(1)} kill you"),
        (0.05, 0, lambda s: f"the {s} {say(3)}"), (0.15, 0, lambda s: f"the {s} {say(1)} the {rng.choice(slurs)} {say(1)} the {s}"), (0.10, 0, lambda s: f"you are not a {s}"), (0.10, 0, lambda s: f"{say(1)} said you are a {s}"),
        (0.10, 0, lambda s: f"{say(1)} kill the {say(4)}"), (0.10, 0, lambda s: say(6)),
    ]
    share = np.array([k[0] for k in kinds])
    out = []
    for k in rng.choice(len(kinds), n, p=share / share.sum()):
        _, y, make = kinds[k]
        out.append((f"{say(12)}. {make(str(rng.choice(slurs)))}. {say(9)}.", y))
    return out


def test_every_machine_changes_verdicts(spark, monkeypatch):
    rng = np.random.default_rng(41)
    rows = [(k, t, y) for k, (t, y) in enumerate(clauses_that_decide(rng, 3000))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = tf.train(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    assert {"zlob", "grun", "frob"} <= {s[:4] for s in model.slurs} and not {"zlobber", "grunkel", "frobnik"} & set(model.words)
    held = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    verdicts = lambda: [int(tf.Matcher(model).score(t) >= 0.5) for t, _ in held]
    whole = verdicts()
    assert np.mean([v == y for v, (_, y) in zip(whole, held)]) > 0.97
    for machine in tf.CASCADE[1:]:
        monkeypatch.setattr(tf, "CASCADE", tuple(m for m in tf.CASCADE if m is not machine))
        tf.grammar.cache_clear()
        changed = np.mean([a != b for a, b in zip(whole, verdicts())])
        monkeypatch.undo()
        tf.grammar.cache_clear()
        assert changed > 0.05, machine.__name__
