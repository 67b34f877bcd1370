"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, other, pause, end of
clause).  Transducers rewrite them in turn: one marks what stands in a negation's scope,
one what is reported speech, one what comes behind a target.  Their composition reads a
clause once; the machine of targets alone then reads it from its end, for insults with a
target behind them.  Each insult and threat so gets a class, e.g. aimed and not negated.
A colon is a pause: what is reported goes on behind it, while negations and targets end.
The score is logistic in the weights that a document's clauses gather by class.

Insults are learned from labelled rows: words, and openings of words for compounds and
inflections, that toxic documents hold far more often than chance allows.  How much
evidence an entry needs is chosen on a part of the same rows.  Each has the weight of
evidence it was learned with.  The class weights start from a prior belief
(negated and reported insults count little) and are fitted to the same rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import learn
from .spark_tools import forget, saved, ship

THRESHOLD = 0.7
#: Labelled rows for the lexicon and the weights: toxic ones and others, at most.
TOXIC_ROWS, OTHER_ROWS = 3_000, 9_000
#: Weight of a class at which more clauses of it begin to add less: w counts as SATURATION * (1 - exp(-w / SATURATION)).
SATURATION = 4.0
#: Strength of the prior belief in the class weights.
BELIEF = 0.1
#: Bytes of the openings that are tried besides whole words.
OPENINGS = (4, 5, 6, 7, 8)
#: Log-likelihood gains that may be asked of an entry, of which a third of the sample chooses; chance gives one in exp of it.
EVIDENCE = (16.0, 14.0, 12.0, 10.0, 8.0)
PURITY = 0.93
#: Hash functions whose least values tell copies in the samples.
KEYS = 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, END = range(8)

# Function words of the four languages, by their part in the grammar.
WORDS = {
    TARGET: "you your yours u he she they them him her people du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti usted ustedes vosotros él ella",
    NEGATION: "not no never without isn't aren't wasn't don't doesn't nicht kein keine niemals nie ohne pas jamais aucun sans nunca jamás sin ningún tampoco",
    REPORT: "said says say quoted wrote claims claimed reported according sagte sagt schrieb behauptet laut dit disait écrit selon prétend dijo dice escribió según afirma",
    THREAT: "kill murder destroy hurt burn shoot stab beat töten umbringen vernichten verletzen schlagen tuer frapper brûler détruire matar destruir golpear quemar",
}


@dataclass
class Transducer:
    """States, and arcs from a state and a symbol to a state and a symbol; other symbols pass unchanged in the state of `rest`."""

    arcs: dict[tuple[int, object], tuple[int, object]]
    rest: dict[int, int]

    def step(self, state: int, symbol):
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


class Composed:
    """Several transducers in a row, each reading what the one before writes; arcs are made when first needed."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts = parts
        self.made: dict[tuple[tuple[int, ...], object], tuple[tuple[int, ...], object]] = {}

    def step(self, state: tuple[int, ...], symbol):
        key = (state, symbol)
        if key not in self.made:
            to = []
            for part, s in zip(self.parts, state, strict=True):
                s, symbol = part.step(s, symbol)
                to.append(s)
            self.made[key] = tuple(to), symbol
        return self.made[key]

    def read(self, symbols: list) -> list:
        state: tuple[int, ...] = (0,) * len(self.parts)
        out = []
        for x in symbols:
            state, y = self.step(state, x)
            out.append(y)
        return out


def _marks(mark: str, of: list) -> dict:
    return {x: (x[0], *sorted({*x[1:], mark})) for x in of}


_HARM = [(k, *m) for k in (INSULT, THREAT) for m in ((), ("aimed",), ("negated",), ("reported",), ("aimed", "negated"), ("aimed", "reported"), ("negated", "reported"), ("aimed", "negated", "reported"))]
#: Words that a negation reaches.
SCOPE = 3


def _targets() -> Transducer:
    """Marks insults and threats behind a target."""
    return Transducer({(0, (TARGET,)): (1, (TARGET,))} | {(1, (x,)): (0, (x,)) for x in (PAUSE, END)} | {(1, x): (1, y) for x, y in _marks("aimed", _HARM).items()}, {})


def grammar() -> Composed:
    """Negation, then reported speech, then a target earlier in the clause."""
    negation = {(s, (NEGATION,)): (1, (NEGATION,)) for s in range(SCOPE + 1)} | {(s, (x,)): (0, (x,)) for s in range(SCOPE + 1) for x in (PAUSE, END)}
    for s in range(1, SCOPE + 1):
        negation |= {(s, x): ((s + 1) % (SCOPE + 1), y) for x, y in _marks("negated", _HARM).items()}
    rest = {s: (s + 1) % (SCOPE + 1) for s in range(1, SCOPE + 1)}
    report = {(0, (REPORT,)): (1, (REPORT,)), (1, (END,)): (0, (END,))} | {(1, x): (1, y) for x, y in _marks("reported", _HARM).items()}
    return Composed(Transducer(negation, rest), Transducer(report, {}), _targets())


def backward_grammar() -> Composed:
    """The machine that reads a clause from its end."""
    return Composed(_targets())


#: Classes of matched clauses and the weights believed in before any fit.
CLASSES = {"insult": 2.5, "insult aimed": 3.5, "insult negated": 0.4, "insult reported": 0.8, "threat aimed": 2.0, "threat": 0.0, "threat negated": 0.0, "threat reported": 0.0}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")
_SYMBOL = {w: k for k, words in WORDS.items() for w in words.split()}


def classes_of(symbols: list[tuple], weights: list[float], machine: Composed, backward: Composed) -> dict[str, float]:
    """What the clauses weigh, by class."""
    out: dict[str, float] = {}
    begin = 0
    for k, x in enumerate(symbols):
        if x != (END,):
            continue
        clause = symbols[begin : k + 1]
        if any(c[0] in (INSULT, THREAT) for c in clause):
            ahead, back = machine.read(clause), backward.read(clause[::-1])[::-1]
            for c, b, w in zip(ahead, back, weights[begin : k + 1], strict=True):
                if c[0] not in (INSULT, THREAT):
                    continue
                marks = {*c[1:], *b[1:]}
                kind = "insult" if c[0] == INSULT else "threat"
                kind += next((f" {m}" for m in ("reported", "negated", "aimed") if m in marks), "")
                out[kind] = out.get(kind, 0.0) + w
        begin = k + 1
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Documents of the words (runs of letters), their hashes by kind of entry, starts and ends in the buffer."""
    buf, off = K.texts_of(column)
    low = K.lower_table()[buf]
    s, e, doc = K.runs(K.letters(low), off)
    h = K.Hashes(low)
    kinds = [h.of(s, e) ^ np.uint64(1)]
    for n in OPENINGS:
        # an opening is shorter than its word; a whole word stands in where it isn't
        kinds.append(np.where(e - s > n, h.of(s, np.minimum(s + n, e)), kinds[0]))
    return doc, off, kinds, s, e


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, entry)."""
    doc, off, kinds, _, _ = _words(column)
    h, d = np.concatenate(kinds), np.tile(doc, len(kinds))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, each entry's number of texts by label."""
    for x in K.slices(batches):
        doc, h = _entries(x.column("text"))
        y = x.column("y").to_numpy()[doc]
        for label in (0, 1):
            u, n = np.unique(h[y == label], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(u)), pa.array(n * (label == 1)), pa.array(n * (label == 0))], ["entry", "toxic", "other"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with the least hashes of its three-word windows under KEYS hash functions."""
    for x in K.slices(batches):
        doc, off, kinds, _, _ = _words(x.column("text"))
        h, d = K.shingles(kinds[0], doc, off.size - 1, 3)
        first = np.flatnonzero(np.diff(d, prepend=-1))
        keys = []
        for k in range(KEYS):
            least = np.full(off.size - 1, np.iinfo(np.uint64).max - np.uint64(k))
            if h.size:
                least[d[first]] = np.minimum.reduceat(K.mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), first)
            keys.append(pa.array(K.signed(least)))
        yield pa.RecordBatch.from_arrays([x.column("text"), x.column("y"), *keys], ["text", "y", *(f"k{k}" for k in range(KEYS))])


def _one_of_each(rows: DataFrame) -> DataFrame:
    """About one row of each group of copies: words that one much copied text holds are no evidence."""
    names = [f"k{k}" for k in range(KEYS)]
    rows = rows.mapInArrow(_keys, "text string, y int, " + ", ".join(f"{k} long" for k in names))
    for k in names:
        rest = [c for c in ("text", *names) if c != k]
        rows = rows.groupBy("y", k).agg(F.min(F.struct(F.xxhash64("text").alias("h"), *rest)).alias("r")).select("y", k, *(f"r.{c}" for c in rest))
    return rows.select("text", "y")


@dataclass
class Model:
    entries: np.ndarray
    evidence: np.ndarray
    weights: dict[str, float] = field(default_factory=lambda: dict(CLASSES))
    bias: float = -4.0

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.entries >> np.uint64(44)).astype(np.int64)] = True
        self.machine, self.backward = grammar(), backward_grammar()

    def classes(self, column: pa.Array) -> list[dict[str, float]]:
        """Of each text; empty where nothing is matched."""
        doc, off, kinds, s, e = _words(column)
        weight = np.zeros(doc.size)
        for h in kinds:
            at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
            if at.size and self.entries.size:
                k = np.minimum(np.searchsorted(self.entries, h[at]), self.entries.size - 1)
                hit = self.entries[k] == h[at]
                weight[at[hit]] = np.maximum(weight[at[hit]], self.evidence[k[hit]])
        harm = weight > 0
        for w in WORDS[THREAT].split():
            harm |= kinds[0] == _hash_of(w)
        out: list[dict[str, float]] = [{} for _ in range(off.size - 1)]
        by_doc: dict[int, dict[int, float]] = {}
        for k in np.flatnonzero(harm).tolist():
            by_doc.setdefault(int(doc[k]), {})[int(s[k] - off[doc[k]])] = float(weight[k])
        for d, found in by_doc.items():
            out[d] = self._read(column[d].as_py(), found)
        return out

    def _read(self, text: str, found: dict[int, float]) -> dict[str, float]:
        symbols: list[tuple] = []
        weights: list[float] = []
        places = sorted(found)
        at = place = 0
        for m in _TOKEN.finditer(text):
            place += len(text[at : m.start()].encode())
            at = m.start()
            token = m[0]
            w = found.get(place, 0.0)
            if not w and len(token) > 1:  # the word may hold an apostrophe, or letters in it may not be ASCII
                end = place + len(token.encode())
                w = max((found[p] for p in places[bisect_left(places, place) : bisect_left(places, end)]), default=0.0)
            if w:
                symbols.append((INSULT,))
            elif token in ".!?;\n":
                symbols.append((END,))
            elif token == ":":
                symbols.append((PAUSE,))
            else:
                symbols.append((_SYMBOL.get(token.lower().replace("’", "'"), OTHER),))
                w = 1.0
            weights.append(w)
        return classes_of([*symbols, (END,)], [*weights, 0.0], self.machine, self.backward)

    def features(self, column: pa.Array) -> np.ndarray:
        found = np.array([[c.get(k, 0.0) for k in CLASSES] for c in self.classes(column)]).reshape(-1, len(CLASSES))
        return np.concatenate([SATURATION * -np.expm1(-found / SATURATION), np.ones((len(found), 1))], axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        w = np.array([*(self.weights[k] for k in CLASSES), self.bias])
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ w, -700, 700)))


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return K.Hashes(raw).of(np.array([0]), np.array([raw.size]))[0] ^ np.uint64(1)


def _lexicon(counted: DataFrame, n1: int, n0: int, evidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, how sure each is and its gain, in the order of the entries."""
    base = n1 / (n1 + n0)
    a, b = F.col("toxic"), F.col("other")
    gain = a * F.log(a / (a + b) / base) + F.when(b > 0, b * F.log(b / (a + b) / (1 - base))).otherwise(0.0)
    # the sample bounds them: each needs several of its toxic rows
    found = counted.where((gain >= evidence) & (a / (a + b) >= PURITY)).select("entry", "toxic", "other", gain.alias("gain")).toPandas()
    entries = found["entry"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(entries)
    sure = ((found["toxic"] + 0.5) / (found["toxic"] + found["other"] + 1)).to_numpy(float)
    return entries[order], sure[order], found["gain"].to_numpy(float)[order]


def _features(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What the model reads in labelled rows, as many as the samples have, and their labels."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(model.features(x.column("text"))), pa.list_(pa.float64())), x.column("y")], ["x", "y"])

    seen = rows.mapInArrow(go, "x array<double>, y int").toPandas()
    return np.stack(seen["x"].to_numpy()) if len(seen) else np.zeros((0, len(CLASSES) + 1)), seen["y"].to_numpy()


def _weigh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return learn.logistic(x, y, np.array([*CLASSES.values(), -4.0]), np.array([*(BELIEF,) * len(CLASSES), BELIEF / 10]))


def _chosen_evidence(rows: DataFrame) -> float:
    """The gain to ask for that does best on a third of the rows when the others are learned from; of equals the largest.

    A gain grows with the rows it is counted over, so two thirds of it are asked of two thirds of them.
    """
    part = F.pmod(F.xxhash64("text"), F.lit(3))
    ours, others = saved(rows.where(part > 0), "learn"), saved(rows.where(part == 0), "check")
    n = {r["y"]: r["count"] for r in ours.groupBy("y").count().collect()}
    if min(n.get(1, 0), n.get(0, 0)) < 20:
        return EVIDENCE[0]
    counted = ours.mapInArrow(_count_entries, "entry long, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic > 0")
    entries, sure, gain = _lexicon(counted, n[1], n[0], min(EVIDENCE) * 2 / 3)
    best, chosen = -1.0, EVIDENCE[0]
    for evidence in EVIDENCE:
        keep = gain >= evidence * 2 / 3
        model = Model(entries[keep], sure[keep])
        w = _weigh(*_features(ours, model))
        x, y = _features(others, model)
        marked = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700))) >= THRESHOLD
        # a toxic row that is missed counts as four others that are marked
        found = 5 * (marked & (y == 1)).sum() / max(marked.sum() + 4 * (y == 1).sum(), 1)
        if found > best:
            best, chosen = found, evidence
    forget(ours, others)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    """Lexicon and weights from bounded samples of labelled rows outside of the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    keep = learn.fold(folds=folds) != held_out
    toxic = learn.sample(labels.where("toxic = 1"), "toxic", TOXIC_ROWS, keep)
    other = learn.sample(labels.where("toxic = 0"), "toxic", OTHER_ROWS, keep)
    both = toxic.unionByName(other).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("last")).where("y = last").drop("last")  # contradictory rows say nothing
    rows = saved(_one_of_each(learn.with_labels(docs, both).where("text <> ''")), "toxic_rows")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias=math.log((n1 + 0.5) / (n0 + 0.5)))
    counted = rows.mapInArrow(_count_entries, "entry long, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic > 0")
    entries, sure, _ = _lexicon(counted, n1, n0, _chosen_evidence(rows))
    model = Model(entries, sure)
    w = _weigh(*_features(rows, model))
    forget(rows)
    model.weights, model.bias = dict(zip(CLASSES, w[:-1].tolist(), strict=True)), float(w[-1])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Whole texts are read.  Rows of `labels` that contradict each other count for nothing
    in the fit.  A text without a matched clause, an empty or null one too, has
    the score of no evidence.  Repeated rows each get their score; other columns are
    ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(model.score(x.column("text")))], ["doc_id", "score"])

    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(go, "doc_id long, score double")
    return out.select("doc_id", (learn.fold(folds=folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
