"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, copula, negation, reporting verb, quotation mark, clause end, other). Six
transducers read them one after another: reported speech marks what stands in quotation or after a reporting verb, negation
marks the few words after a negation, target marks what is aimed at someone, predicate marks what is said of someone after a
copula, heaping marks an insult that follows another within a few clauses, and the scorer turns what is marked into weighted
patterns. They are composed once into one machine. A word by itself, in whatever clause, matches no pattern: an insult counts
when it is targeted, predicated or heaped on another, a threat when it is targeted. A text that holds one lexicon word, or
some that stand far apart, scores like a text without any.

All that is learned comes from labelled texts: the insult lexicon (words, and stems with many endings) by how often a word
stands in different contexts of toxic and of other texts, so that copies of one text teach nothing by their number; the arc
weights by how often a pattern matches in toxic and in other texts; and a calibration of the strongest clause and of the sum
over clauses. Threats, targets, copulas, negations and reporting verbs are given word lists. Whole texts are learned from
and scored.

Training uses at most ``PER_CLASS`` labelled texts of each class, which stay on the executors; an entry needs ``MIN_CONTEXTS``
contexts and ``MIN_LOG_ODDS``, so the lexicon is much smaller than the sample's vocabulary. Defined cases: null and empty
texts have no clause and score like any text without matches; equal texts score equally; with one class (or none) labelled
the given lists and weights alone score; empty tables give no rows; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spindrift.llm.dart_minhash import U, mix
from spindrift.llm.storage import discard, materialize
from spindrift.llm.training import Logistic, class_weights, labelled_rows, rows_of
from spindrift.llm.worker import turn

PER_CLASS = 4000
#: Words whose symbols a worker remembers; rows of a result batch.
KEPT_WORDS, BATCH_ROWS = 100_000, 16_384
#: A learned entry stands in so many toxic texts, and contexts there, at least, and has these log odds at least.
MIN_CONTEXTS, MIN_LOG_ODDS, FULL_LOG_ODDS = 4, 3.0, 5.0
STEM_CHARS, MIN_ENDINGS = (4, 5, 6, 7, 8), 4
#: How many words a negation, a target and a copula reach, and over how many ends of clauses an insult is heaped on another.
NEGATION_REACH, TARGET_REACH, COPULA_REACH, HEAP_REACH = 3, 4, 3, 4

INSULT, THREAT, TARGET, COPULA, NEGATION, REPORT, QUOTE, END, OTHER = range(9)
SEEDS = {
    THREAT: "kill kills killing murder hurt stab shoot strangle destroy töten umbringen schlagen verprügeln tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself du dich dir dein deine euch tu te toi vous ton tú ti usted ustedes vosotros",
    COPULA: "is are was were am be being bin bist ist sind seid war suis es est sommes êtes sont était soy eres son somos",
    NEGATION: "not no never neither nor nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says say wrote writes claimed claims quoted reported allegedly sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma",
    INSULT: "idiot moron scum",
}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»]")


class Arc(NamedTuple):
    state: int
    output: tuple
    weight: float


class Transducer:
    """A deterministic weighted transducer. Symbols are tuples (class, *marks); ``step`` gives the arc from a state."""

    def __init__(self, step: Callable[[int, tuple], Arc], states: int) -> None:
        self.step, self.states = step, states


def _reporting() -> Transducer:
    """States: 0 own words, 1 after a reporting verb, 2 in quotation."""

    def step(state: int, symbol: tuple) -> Arc:
        kind = symbol[0]
        if kind == QUOTE:
            return Arc(0 if state == 2 else 2, symbol, 0)
        if kind == REPORT and state != 2:
            return Arc(1, symbol, 0)
        if kind == END:
            return Arc(2 if state == 2 else 0, symbol, 0)
        return Arc(state, (*symbol, "reported") if state and kind in (INSULT, THREAT) else symbol, 0)

    return Transducer(step, 3)


def _within(opener: int, mark: str, reach: int) -> Transducer:
    """States count down the words that an opener still reaches."""

    def step(state: int, symbol: tuple) -> Arc:
        kind = symbol[0]
        if kind == opener:
            return Arc(reach, symbol, 0)
        if kind == END:
            return Arc(0, symbol, 0)
        return Arc(max(state - 1, 0), (*symbol, mark) if state and kind in (INSULT, THREAT) else symbol, 0)

    return Transducer(step, reach + 1)


def _heaping() -> Transducer:
    """States count down the ends of clauses over which the last insult still reaches."""

    def step(state: int, symbol: tuple) -> Arc:
        if symbol[0] == INSULT:
            return Arc(HEAP_REACH, (*symbol, "heaped") if state else symbol, 0)
        return Arc(max(state - (symbol[0] == END), 0), symbol, 0)

    return Transducer(step, HEAP_REACH + 1)


#: Weights of patterns that no labelled text shows: insults by mark, threats, and a target shortly after a match.
GIVEN = {"targeted insult": 1.0, "predicated insult": 0.7, "heaped insult": 0.7, "targeted threat": 1.0, "aimed": 0.5}
#: What a negation or reported speech leaves of a weight.
SOFTENED = {"negated": 0.6, "reported": 0.7}


def _scorer() -> Transducer:
    """States: 0 nothing yet, 1 a pattern shortly before (what a target after it turns on). The output is the pattern and what
    softens it; bare words have none."""

    def step(state: int, symbol: tuple) -> Arc:
        kind, *marks = symbol
        if kind == END:
            return Arc(0, (), 0)
        if kind == TARGET:
            return Arc(0, ("aimed",) if state else (), 0)
        if kind not in (INSULT, THREAT):
            return Arc(state, (), 0)
        name = "insult" if kind == INSULT else "threat"
        pattern = next((f"{m} {name}" for m in ("targeted", "predicated", "heaped") if m in marks and f"{m} {name}" in GIVEN), None)
        if pattern is None:
            return Arc(state, (), 0)
        return Arc(1, (pattern, *(m for m in SOFTENED if m in marks)), 1)

    return Transducer(step, 2)


def compose(parts: list[Transducer]) -> list[list[tuple[int, float, tuple]]]:
    """One machine that reads a class and does what the parts do one after another: a row of (state, weight, output) by
    class for each reachable joint state; state 0 is the start."""
    numbers, table, waiting = {(0,) * len(parts): 0}, [], [(0,) * len(parts)]
    while waiting:
        joint = waiting.pop(0)
        row = []
        for kind in range(OTHER + 1):
            symbol: tuple = (kind,)
            after, weight = [], 0.0
            for part, state in zip(parts, joint, strict=True):
                arc = part.step(state, symbol) if symbol else Arc(state, (), 0)
                after.append(arc.state)
                symbol, weight = arc.output, weight + arc.weight
            to = tuple(after)
            if to not in numbers:
                numbers[to] = len(numbers)
                waiting.append(to)
            row.append((numbers[to], weight, symbol))
        table.append(row)
    return table


GRAMMAR = compose([_reporting(), _within(NEGATION, "negated", NEGATION_REACH), _within(TARGET, "targeted", TARGET_REACH), _within(COPULA, "predicated", COPULA_REACH), _heaping(), _scorer()])
_MARKS = {m: (END, 0.0) for m in ".!?;\n"} | {m: (QUOTE, 0.0) for m in '"“”«»'}


class _Symbols(dict):
    """Class and weight by word, looked up once for each word kept."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float]) -> None:
        super().__init__(words)
        self.stems = stems

    def __missing__(self, word: str) -> tuple[int, float]:
        found = next(((INSULT, self.stems[word[:n]]) for n in STEM_CHARS if n < len(word) and word[:n] in self.stems), (OTHER, 0.0))
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=lambda: dict(GIVEN))
    calibrate: Logistic | None = None

    def __post_init__(self) -> None:
        self._symbols: _Symbols | None = None
        self._machine: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_symbols": None, "_machine": None}

    def symbols(self) -> _Symbols:
        if self._symbols is None:
            known = {w: (kind, 1.0) for kind, listed in SEEDS.items() for w in listed.split()} | _MARKS
            self._symbols = _Symbols(known | {w: (INSULT, x) for w, x in self.words.items()}, self.stems)
        return self._symbols

    def machine(self) -> list[list[tuple[int, float, tuple]]]:
        """The grammar with this model's arc weights."""
        if self._machine is None:
            weight = lambda out: self.patterns[out[0]] * math.prod(SOFTENED[m] for m in out[1:]) if out else 0.0
            self._machine = [[(to, weight(out), out) for to, _, out in row] for row in GRAMMAR]
        return self._machine

    def clauses(self, text: str | None) -> Iterator[tuple[float, list[tuple[str, tuple]]]]:
        """Score and matches (word and pattern) of each clause that has any."""
        tokens = _TOKEN.findall((text or "").lower())
        symbols = [*map(self.symbols().__getitem__, tokens)]
        if not any(kind <= THREAT for kind, _ in symbols):
            return
        machine, state, score, matches, last = self.machine(), 0, 0.0, [], 1.0
        for token, (kind, own) in zip(tokens, symbols, strict=True):
            state, weight, output = machine[state][kind]
            if output:
                last = own if kind <= THREAT else last
                score += weight * last
                matches.append((token, output))
            if kind == END and matches:
                yield score, matches
                score, matches = 0.0, []
        if matches:
            yield score, matches

    def features(self, text: str | None) -> list[float]:
        scores = [s for s, _ in self.clauses(text)]
        return [min(max(scores, default=0.0), 2.0), math.log1p(sum(scores))]

    def shown(self, text: str | None) -> list[str]:
        """The patterns that match anywhere in a text."""
        return sorted({output[0] for _, matches in self.clauses(text) for _, output in matches})

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.features(t) for t in texts])
        return self.calibrate(x) if self.calibrate is not None else 1 - np.exp(-1.5 * x[:, 0])


_WORD = re.compile(r"[^\W\d_]+")


def _contexts(rows: DataFrame) -> DataFrame:
    """Word, y, context (a number of the words before and after; null in texts that aren't toxic) and, of each text, 1 in one
    of the word's rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = _WORD.findall(text.as_py().lower())
                words, which = [*dict.fromkeys(found)], None
                context = pa.nulls(len(words), pa.int64())
                if y and words:
                    numbers = np.array([xxh3_64_intdigest(w) for w in words], dtype=U)
                    place = {w: i for i, w in enumerate(words)}
                    which = np.fromiter((place[w] for w in found), np.int64, len(found))
                    around = np.concatenate([[U(0)], numbers[which], [U(0)]])
                    pairs = np.unique(np.rec.fromarrays([which, mix(mix(around[:-2]) * U(31) + around[2:])], names="w,c"))
                    which, context = pairs.w, pa.array(pairs.c.view(np.int64))
                at = np.arange(len(words)) if which is None else which
                first = np.diff(at, prepend=-1) != 0
                for begun in range(0, len(at), BATCH_ROWS):
                    part = slice(begun, begun + BATCH_ROWS)
                    yield pa.RecordBatch.from_pydict({"word": [words[i] for i in at[part]], "y": pa.array(np.full(len(at[part]), y, np.int32)), "context": context[part], "texts": pa.array(first[part].astype(np.int64))})

    return rows.select("t", "y").mapInArrow(made, "word string, y int, context long, texts long")


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of insults with weights up to 1, from labelled rows (columns t and y)."""
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}  # two rows
    toxic, other = (max(sizes.get(y, 0), 1) for y in (1, 0))
    by = _contexts(rows).groupBy("word", "y", "context").agg(F.sum("texts").alias("texts")).groupBy("word", "y").agg(F.sum("texts").alias("texts"), F.count("context").alias("contexts"))
    one = lambda y, c: F.coalesce(F.sum(F.when(F.col("y") == y, F.col(c))), F.lit(0))
    words = by.groupBy("word").agg(F.least(one(1, "texts"), one(1, "contexts")).alias("n"), one(0, "texts").alias("m"))
    words = materialize(words, "words")

    def weighed(table: DataFrame) -> DataFrame:
        odds = F.log((F.col("n") + 0.5) / (toxic + 1)) - F.log((F.col("m") + 0.5) / (other + 1))
        return table.withColumn("odds", odds).where((F.col("n") >= MIN_CONTEXTS) & (F.col("odds") >= MIN_LOG_ODDS))

    own = {r.word: min(1.0, r.odds / FULL_LOG_ODDS) for r in weighed(words.where(F.length("word") > 1)).collect()}
    begins = F.array(*(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_CHARS))
    stems = words.select(F.explode(F.array_compact(begins)).alias("stem"), "n", "m").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum((F.col("n") > 0).cast("int")).alias("endings"))
    found = {r.stem: (r.n, min(1.0, r.odds / FULL_LOG_ODDS)) for r in weighed(stems.where(F.col("endings") >= MIN_ENDINGS)).collect()}
    discard(words)
    # a stem that is nearly always continued in one way is left to the longer one
    longer: dict[str, int] = {}
    for stem, (n, _) in found.items():
        longer[stem[:-1]] = max(longer.get(stem[:-1], 0), n)
    return own, {s: x for s, (n, x) in found.items() if longer.get(s, 0) < 0.97 * n}


def train(documents: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", per_class: int = PER_CLASS, **names) -> ToxicityModel:
    rows, counts = labelled_rows(documents, labels, label, learn, per_class, **names)
    spark, present = documents.sparkSession, {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if {*present} != {0, 1}:
        discard(rows)
        return ToxicityModel()
    model = ToxicityModel(*learn_lexicon(rows))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def shown(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.shown(t) for t in texts])

    for r in rows.select("y", F.explode(shown("t")).alias("pattern")).groupBy("pattern").agg(F.sum("y").alias("n"), F.sum(1 - F.col("y")).alias("m")).collect():
        if r.n + r.m >= MIN_CONTEXTS:
            odds = math.log((r.n + 0.5) / (present[1] + 1)) - math.log((r.m + 0.5) / (present[0] + 1))
            model.patterns[r.pattern] = min(max(odds / FULL_LOG_ODDS, 0.0), 1.0)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.features(t) for t in texts])

    found = rows_of(rows.select("k", "y", features("t").alias("x")), "y x")
    discard(rows)
    y = np.array([r.y for r in found])
    model.calibrate = Logistic(np.array([r.x for r in found]), y, class_weights(y, counts), products=False, ridge=0.1)
    return model


def toxicity_score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        turn("toxicity")
        return pd.Series(sent.value.scores(texts.tolist()))

    return score(text)
