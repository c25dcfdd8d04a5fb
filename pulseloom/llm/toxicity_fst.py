"""Toxicity by a weighted finite-state grammar over clauses.

A cascade of transducers is composed into one machine:

* Lexicon: word classes to symbols. A slur (a stem that occurs in toxic texts at least as
  often as elsewhere) may be read as an insult or as a plain word, a threat verb likewise;
  insults (words and stems that hardly occur outside toxic texts) may not.
* Insults: insults in a row are one phrase, made stronger.
* Threats: a threat verb with a target up to three words before or after it.
* Targets: an insult with a target up to five words before or three after it is direct.
* Negation: what stands up to three words after a negation is negated.
* Reported speech: what follows a verb of report or stands in quotation marks is reported.

Arcs carry named weights, and several paths may read a clause. The best path (max-plus) of
every clause that holds an insult, slur or threat gives the clause's weight; a text's score is the
logistic function of the sum over its clauses, a bias and its length. The weights are
learned from labelled texts in turns: best paths under the present weights, then a logistic
fit on the arcs of these paths, close to ``PRIOR`` and with the grammar's order kept (being direct or
repeated never makes an insult weaker, being negated or reported never stronger).

Training uses a bounded sample of labelled rows: at most ``sample_per_class`` of each
label, those with the least hash of doc_id. Everything else covers all texts whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Closed word classes of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours yourself u he she they him her them his their these those people everyone du dich dir dein deine ihr euch sie er tu toi te vous votre ton il elle ils tú ti usted ustedes tu su ellos ella él".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca ni ningún".split()
REPORTS = "said says say saying called calls claimed claims wrote writes quoted quotes reported reports accused told sagte sagt schrieb behauptet nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill murder hurt destroy beat shoot stab burn töten umbringen tuer frapper matar golpear".split()

#: Arc weights, with the values that hold without labels; then what least and most they may become.
PRIOR = {"insult": 3.0, "slur": 0.5, "again": 0.5, "bare": 1.5, "direct": 1.0, "threat": 5.0, "negated": -2.0, "reported": -2.0}
BOUNDS = {"insult": (0, 20), "slur": (-20, 20), "again": (0, 20), "bare": (0, 20), "direct": (0, 20), "threat": (0, 20), "negated": (-20, 0), "reported": (-20, 0)}
NAMES = tuple(PRIOR)
BIAS, LENGTH = -3.0, 0.0
#: No context reaches further than this many plain words; longer runs are shortened to it.
REACH = 6
CLAUSE_END = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
QUOTES = set("\"“”«»„")

Arc = tuple[int, str | None, tuple[str, ...]]  # (to, output, names of weights)


@dataclass
class Transducer:
    """Arcs by (state, input symbol); state 0 starts, ``final`` states end."""

    arcs: dict[tuple[int, str], list[Arc]] = field(default_factory=dict)
    final: set[int] = field(default_factory=set)

    def add(self, source: int, symbol: str, target: int, output: str | None = None, *names: str) -> None:
        self.arcs.setdefault((source, symbol), []).append((target, output, names))

    def compose(self, other: "Transducer") -> "Transducer":
        """The machine that feeds this one's outputs to ``other``, of the states that can be reached; an arc without output leaves ``other`` where it is."""
        made, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
        by_state: dict[int, list[tuple[str, Arc]]] = {}
        for (source, symbol), arcs in self.arcs.items():
            by_state.setdefault(source, []).extend((symbol, arc) for arc in arcs)
        while todo:
            a, b = todo.pop()
            if a in self.final and b in other.final:
                made.final.add(number[a, b])
            for symbol, (target, output, names) in by_state.get(a, []):
                for there, out, more in [(b, None, ())] if output is None else other.arcs.get((b, output), []):
                    if (target, there) not in number:
                        number[target, there] = len(number)
                        todo.append((target, there))
                    made.add(number[a, b], symbol, number[target, there], out, *names, *more)
        return made

    def best(self, symbols: list[str] | tuple[str, ...], weights: dict[str, float]) -> tuple[float, tuple[str, ...]] | None:
        """The heaviest path's weight and the names on its arcs (ties: the first found), or None if no path accepts."""
        here: dict[int, tuple[float, tuple[str, ...]]] = {0: (0.0, ())}
        for symbol in symbols:
            there: dict[int, tuple[float, tuple[str, ...]]] = {}
            for state, (total, path) in here.items():
                for target, _, names in self.arcs.get((state, symbol), []):
                    now = total + sum(weights[x] for x in names)
                    if target not in there or now > there[target][0]:
                        there[target] = (now, path + names)
            here = there
        return max((x for s, x in here.items() if s in self.final), key=lambda x: x[0], default=None)


#: Between the machines: I insult, D direct insult, V threat verb, T threat, Z negated, G target, N negation, R report, Q quotation mark, w any other word.
SYMBOLS = "IDVTZGNRQw"


def lexicon_machine() -> Transducer:
    m = Transducer(final={0})
    m.add(0, "insult", 0, "I", "insult")
    m.add(0, "slur", 0, "w")
    m.add(0, "slur", 0, "I", "slur")
    for c, x in (("threat", "V"), ("target", "G"), ("negation", "N"), ("report", "R"), ("quote", "Q"), ("word", "w")):
        m.add(0, c, 0, x)
    return m


def insult_machine() -> Transducer:
    """1: right after an insult."""
    m = Transducer(final={0, 1})
    for s in (0, 1):
        for x in SYMBOLS:
            if s and x == "I":
                m.add(s, x, 1, "w", "again")
            else:
                m.add(s, x, int(x == "I"), x)
    return m


def threat_machine() -> Transducer:
    """1-3: a verb waits for its target; 4-6: a target was seen."""
    m = Transducer(final={0, 4, 5, 6})
    for s in range(7):
        on = {1: 2, 2: 3, 4: 5, 5: 6}.get(s)
        for x in SYMBOLS:
            if x == "V" and s in (0, 4, 5, 6):
                m.add(s, x, on or 0, "w")
                m.add(s, x, 1, "w")
                if s:
                    m.add(s, x, 0, "T")
            elif x == "G":
                m.add(s, x, 4, "T" if s in (1, 2, 3) else "G")
            elif s != 3:
                m.add(s, x, on or 0, "w" if x == "V" else x)
    return m


def target_machine() -> Transducer:
    """1-5: a target was seen; 6-8: an insult waits for its target."""
    m = Transducer(final=set(range(6)))
    for s in range(9):
        on = {1: 2, 2: 3, 3: 4, 4: 5, 6: 7, 7: 8}.get(s)
        for x in SYMBOLS:
            if x == "I" and s < 6:
                m.add(s, x, on or 0, "I")
                if s:
                    m.add(s, x, on or 0, "D")
                else:
                    m.add(s, x, 6, "w")
            elif x == "G":
                m.add(s, x, 1, "D" if s >= 6 else "w")
            elif s != 8:
                m.add(s, x, on or 0, x)
    return m


def negation_machine() -> Transducer:
    """1-3: so many words after a negation."""
    m = Transducer(final={0, 1, 2, 3})
    for s in range(4):
        for x in SYMBOLS:
            on = {1: 2, 2: 3}.get(s, 0)
            m.add(s, x, 1 if x == "N" else on, "Z" if s and x in "IDT" else "w" if x == "N" else x)
    return m


def report_machine() -> Transducer:
    """1: after a verb of report; 2: in quotation marks."""
    m = Transducer(final={0, 1, 2})
    for s in range(3):
        for x in SYMBOLS:
            to = max(1, s) if x == "R" else {0: 2, 1: 1, 2: 0}[s] if x == "Q" else s
            names = () if x not in "IDTZ" else ("negated",) if x == "Z" else ("reported",) if s else {"I": ("bare",), "D": ("bare", "direct"), "T": ("threat",)}[x]
            m.add(s, x, to, None, *names)
    return m


CASCADE = (lexicon_machine, insult_machine, threat_machine, target_machine, negation_machine, report_machine)


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """The composed cascade."""
    machine = CASCADE[0]()
    for part in CASCADE[1:]:
        machine = machine.compose(part())
    return machine


@dataclass
class Model:
    """What training leaves: insult words, insult stems, slurs (stems), arc weights, and the document's bias and length weight."""

    words: list[str]
    stems: list[str]
    slurs: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = BIAS
    length: float = LENGTH


class Matcher:
    """A model at work in a task."""

    def __init__(self, model: Model):
        self.model = model
        words, stems = set(model.words), sorted(set(model.stems), key=len, reverse=True)
        self.kind = {w: "report" for w in REPORTS} | {w: "negation" for w in NEGATIONS} | {w: "target" for w in TARGETS} | {w: "threat" for w in THREATS} | {w: "insult" for w in words}
        self.stem = re.compile("|".join(map(re.escape, stems))) if stems else None
        self.slur = re.compile("|".join(map(re.escape, model.slurs))) if model.slurs else None
        self.found = _automaton(sorted(words | set(THREATS) | set(stems) | set(model.slurs)))
        self.cache: dict[tuple[str, ...], tuple[float, np.ndarray]] = {}

    def symbol(self, word: str) -> str:
        if word in QUOTES:
            return "quote"
        kind = self.kind.get(word)
        if kind is None:
            kind = "insult" if self.stem and self.stem.match(word) else "slur" if self.slur and self.slur.match(word) else "word"
        return kind

    def clauses(self, text: str) -> list[tuple[str, ...]]:
        """The word classes of each clause that holds an insult, a slur or a threat."""
        out = []
        text = text.lower()
        done = -1
        for at in self.found(text):
            if at < done:
                continue
            low = max((m.end() for m in CLAUSE_END.finditer(text, max(0, done), at)), default=max(0, done))
            stop = CLAUSE_END.search(text, at)
            done = stop.end() if stop else len(text)
            symbols: list[str] = []
            plain = 0
            for word in WORD.findall(text, low, done):
                kind = self.symbol(word)
                plain = plain + 1 if kind == "word" else 0
                if plain <= REACH:
                    symbols.append(kind)
            if not {"insult", "slur", "threat"}.isdisjoint(symbols):
                out.append(tuple(symbols))
        return out

    def path(self, symbols: tuple[str, ...]) -> tuple[float, np.ndarray]:
        """A clause's weight, and how often each of NAMES is on its best path."""
        if symbols not in self.cache:
            if len(self.cache) > 20_000:
                self.cache.clear()
            weight, names = grammar().best(symbols, self.model.weights) or (0.0, ())
            self.cache[symbols] = weight, np.array([names.count(x) for x in NAMES], float)
        return self.cache[symbols]

    def score(self, text: str | None) -> float:
        text = text or ""
        total = self.model.bias + self.model.length * _length(text) + sum(self.path(c)[0] for c in self.clauses(text))
        return 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))


def _length(text: str) -> float:
    """Logarithm of a text's length in hundreds of words."""
    return math.log1p(text.count(" ") / 100)


def _automaton(heads: list[str]) -> Callable[[str], Iterator[int]]:
    """Positions (of last characters) where one of the heads occurs, in one pass over a text."""
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for head in heads:
        machine.add_word(head)
    if not heads:
        return lambda text: iter(())
    machine.make_automaton()
    return lambda text: (end for end, _ in machine.iter(text))


def _features(text: str) -> set[str]:
    """Words (with '=') and stems of three to eight letters."""
    found = set()
    for word in set(re.findall(r"[^\W\d_]+", text.lower())):
        found.add("=" + word[:40])
        found.update(word[:n] for n in range(3, min(8, len(word) - 1) + 1))
    return found


def choose_entries(documents: dict[str, int], toxic: int, least: int) -> list[str]:
    """Lexicon entries that cover toxic documents and hardly any others. Sets of documents are bits of integers.

    Greedy: the entry with the most uncovered toxic documents less ten for each clean
    one; among entries within 3 % of the best the most specific (longest) is taken.
    """
    good: dict[str, tuple[int, int]] = {}
    for entry, docs in documents.items():
        hits, total = (docs & toxic).bit_count(), docs.bit_count()
        if hits >= least and hits >= 0.95 * total:
            good[entry] = (docs & toxic, 10 * (total - hits))
    covered = 0
    chosen = []
    while good:
        gain = {e: (hits & ~covered).bit_count() - cost for e, (hits, cost) in good.items()}
        best = max(gain.values())
        if best < least:
            break
        entry = max((e for e, g in gain.items() if g >= 0.97 * best), key=lambda e: (e[0] == "=", len(e), gain[e], e))
        chosen.append(entry)
        covered |= good[entry][0]
        del good[entry]
        good = {e: good[e] for e, g in gain.items() if g >= least and e in good}
    # words that the cover didn't need but that are as sure
    chosen += [e for e, docs in documents.items() if e[0] == "=" and e not in chosen and docs.bit_count() >= 2 * least and docs & toxic == docs]
    return chosen


def choose_slurs(documents: dict[str, int], toxic: int, least: int) -> list[str]:
    """Stems of four letters or more that occur in toxic documents at least as often as in others, by greedy cover (half a document's cost for each clean one)."""
    good: dict[str, tuple[int, float]] = {}
    for entry, docs in documents.items():
        hits, total = (docs & toxic).bit_count(), docs.bit_count()
        if entry[0] != "=" and len(entry) > 3 and hits >= least and 2 * hits >= total:
            good[entry] = (docs & toxic, 0.5 * (total - hits))
    covered = 0
    chosen = []
    while good:
        gain = {e: (hits & ~covered).bit_count() - cost for e, (hits, cost) in good.items()}
        entry = max(good, key=lambda e: (gain[e], -len(e), e))
        if gain[entry] < least:
            break
        chosen.append(entry)
        covered |= good.pop(entry)[0]
        good = {e: x for e, x in good.items() if gain[e] >= least}
    return sorted(chosen)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, low: np.ndarray, high: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights by Newton steps, drawn to ``prior`` and kept within bounds; the design's columns include any bias."""
    w = prior.copy()
    free = np.ones(len(w), bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        out = (w < low) | (w > high)
        w = np.clip(w, low, high)
        free &= ~out
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_weights(model: Model, texts: list[str], y: np.ndarray, turns: int = 5) -> Model:
    """The model with weights for bias, length and arcs: best paths and a fit on them, in turns."""
    matcher = Matcher(model)
    clauses = [matcher.clauses(t) for t in texts]
    length = np.array([_length(t) for t in texts])
    prior = np.array([BIAS, LENGTH, *PRIOR.values()])
    low, high = (np.array([e, f, *(b[k] for b in BOUNDS.values())], float) for k, e, f in ((0, -20, -5), (1, 20, 0)))
    for _ in range(turns):
        matcher = Matcher(model)
        arcs = np.array([sum((matcher.path(c)[1] for c in found), np.zeros(len(NAMES))) for found in clauses]).reshape(-1, len(NAMES))
        w = fit_logistic(np.column_stack([np.ones(len(y)), length, arcs]), y, prior, low, high)
        last, model = model, replace(model, bias=float(w[0]), length=float(w[1]), weights=dict(zip(NAMES, w[2:].tolist())))
        if max(abs(model.weights[x] - last.weights[x]) for x in NAMES) < 1e-4:
            break
    return model


BUCKETS = 1 << 22


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = 2000) -> Model:
    """Lexicon and weights from labelled rows that aren't held out.

    Null labels, texts and ids are passed over; an id with several labels has the largest (toxic), and of several texts the one of least hash. At most
    ``sample_per_class`` ids of each label are used, by their least hash, each with one text; one worker fits them, and the driver gets the model.
    """
    labelled = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    named = labelled.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = F.xxhash64("doc_id")
    sample = None
    for y in (1, 0):
        part = named.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample_per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * sample_per_class ids of 12 bytes
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))
    # the bounded sample is one group, fitted by a worker
    fitted = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y").groupBy(F.lit(0).alias("g")).applyInPandas(_fit, "words array<string>, stems array<string>, slurs array<string>, weights array<double>").first()
    if not fitted:
        return Model([], [])
    bias, length, *arcs = fitted["weights"]
    return Model(list(fitted["words"]), list(fitted["stems"]), list(fitted["slurs"]), dict(zip(NAMES, arcs)), bias, length)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Entries, slurs and weights from the sample's doc_id, text and y, as one row."""
    rows = rows.sort_values(["doc_id", "text"], kind="stable")
    y = rows["y"].to_numpy(float)
    model = Model([], [])
    if y.any() and not y.all():
        first = np.argsort(-y, kind="stable").tolist()  # toxic texts come first
        n_toxic = int(y.sum())
        toxic = (1 << n_toxic) - 1
        least = max(3, math.ceil(0.01 * n_toxic))
        # numbers of toxic documents by hashed feature: a bound that keeps most features out of memory
        buckets = np.zeros(BUCKETS, np.uint16)
        for k in first[:n_toxic]:
            buckets[np.array(sorted({hash(f) % BUCKETS for f in _features(rows["text"].iloc[k])}), np.int64)] += 1
        documents: dict[str, int] = {}
        for place, k in enumerate(first):
            bit = 1 << place
            for f in _features(rows["text"].iloc[k]):
                if f in documents:
                    documents[f] |= bit
                elif place < n_toxic and buckets[hash(f) % BUCKETS] >= least:
                    documents[f] = bit
        documents = {f: found for f, found in documents.items() if (found & toxic).bit_count() >= least}
        entries = choose_entries(documents, toxic, least)
        model = Model(sorted(e[1:] for e in entries if e[0] == "="), sorted(e for e in entries if e[0] != "="), choose_slurs(documents, toxic, least))
        model = learn_weights(model, rows["text"].tolist(), y)
    return pd.DataFrame({"words": [model.words], "stems": [model.stems], "slurs": [model.slurs], "weights": [[model.bias, model.length, *model.weights.values()]]})


def score_column(model: Model, text: str = "text") -> Column:
    """Toxicity of a text column, 0 to 1; null and empty texts get the score of no clause."""
    matcher: list[Matcher] = []  # once in each task

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not matcher:
            matcher.append(Matcher(model))
        return pd.Series([matcher[0].score(t) for t in texts], dtype="float64")

    return score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, sample_per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Only text is an input of a score. Null ids are scored and aren't held out; repeated
    rows get the same score; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, sample_per_class)
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
