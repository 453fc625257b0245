"""Toxicity by a weighted finite-state pattern grammar over clauses.

Two transducers are composed. The lexicon reads the letters of a word and gives its part:
insult (with a weight), threat, target, negation, reported speech or none. The grammar reads
the parts of a clause and gives its weight: an insult counts more next to a target, less
after a negation or inside reported speech; a threat counts only when it has a target. A
document's score is a logistic function of the sum over its clauses.

Insult words and stems, their weights and the logistic function are learned from a bounded
sample of labelled rows (``SAMPLE`` rows in hash order); the closed word classes below are
fixed. Learning uses neither held-out rows nor any column but text and label.

Defined cases: null or empty texts match nothing and get the score of no match; labels
without value or without document are ignored, and an id labelled twice counts as toxic if
any of its labels says so; without learnable labels nothing is an insult and only threats
score; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import held_out, pieces

SAMPLE = 10_000
#: Stems of these lengths compete with whole words as insult patterns.
STEMS = (3, 4, 5, 6, 7, 8)
#: Words that explain a document.
ENOUGH = 3
#: At least this share of a pattern's documents is toxic.
PRECISION = 0.5
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Closed word classes of English, German, French and Spanish.
TARGETS = frozenset("you your yours he him she her they them u du dich dir ihr euch dein deine er ihn sie tu te toi vous ton ta il elle ils elles tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never isn't nobody nicht kein keine nie niemals pas jamais non nunca jamás ni".split())
REPORTS = frozenset("said says claimed reported quoted sagte sagt behauptet laut dit disait affirme selon dijo dice afirmó según".split())
THREATS = frozenset("kill murder töten umbringen ermorden tuer assassiner matar asesinar".split())

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass
class Lexicon:
    """Transducer from the letters of a word to its part and weight; stems accept any ending."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def read(self, word: str) -> tuple[int, float]:
        if weight := self.insult(word):
            return INSULT, weight
        part = THREAT if word in THREATS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else NONE
        return part, 0.0


#: The grammar's states: how many words a negation or a target still reaches, and whether speech is reported.
REACH = 3
NEAR_TARGET, NEGATED, REPORTED, THREATENED = 1.25, 0.6, 0.6, 4.0


def clause_weights(words: list[str], lexicon: Lexicon) -> Iterator[tuple[str, float]]:
    """The words of one clause that the grammar gives a weight."""
    negated, target, reported, threat = 0, 0, 1.0, ""
    threat_left = 0
    for word in words:
        part, weight = lexicon.read(word)
        if part == INSULT:
            yield word, weight * (NEAR_TARGET if target else 1.0) * (NEGATED if negated else 1.0) * reported
        elif part == THREAT and not negated:
            threat, threat_left = word, REACH + 1
        elif part == TARGET:
            if threat_left:
                yield threat, THREATENED * reported
            target = REACH + 1
        elif part == NEGATION:
            negated = REACH + 1
        elif part == REPORT:
            reported = REPORTED
        negated, target, threat_left = max(0, negated - 1), max(0, target - 1), max(0, threat_left - 1)


def text_weight(text: str | None, lexicon: Lexicon) -> float:
    """Sum over the different words at their strongest clauses, so that repetition adds nothing.

    Clauses without insult or threat weigh nothing and are passed over.
    """
    low = (text or "").lower()
    heads = {w for w in set(WORD.findall(low)) if w in THREATS or lexicon.insult(w)}
    if not heads:
        return 0.0
    best: dict[str, float] = {}
    for clause in CLAUSE.split(low):
        words = WORD.findall(clause)
        if not heads.isdisjoint(words):
            for word, weight in clause_weights(words, lexicon):
                best[word] = max(best.get(word, 0.0), weight)
    return sum(best.values())


@dataclass
class Model:
    lexicon: Lexicon
    slope: float
    base: float

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * text_weight(text, self.lexicon)))))


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """text and label of up to ``size`` labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.where("text is not null").groupBy(F.xxhash64("text").alias("key")).agg(F.max("label").alias("label"), F.any_value("text").alias("text"))


def spellings(word: str) -> list[str]:
    """The patterns that a word fits: itself and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def patterns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 18):
            found, toxic = [], []
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                own = {p for w in set(WORD.findall(text.lower())) for p in spellings(w)}
                found.extend(own)
                toxic.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], ["pattern", "label"])


def surprise_of(t: Column, n: Column, prior: float) -> Column:
    """``surprise`` as a column."""
    rest = F.when(t < n, (n - t) * F.log((1 - t / n) / (1 - prior))).otherwise(0.0)
    return F.when(t > 0, t * F.log(t / n / prior)).otherwise(0.0) + rest


def surprise(t: float, n: float, prior: float) -> float:
    """Log-likelihood gained by a share of t in n over the prior share."""
    p = t / n
    return t * math.log(p / prior) + ((n - t) * math.log((1 - p) / (1 - prior)) if t < n else 0.0)


def learn_lexicon(rows: DataFrame, n: int, toxic: int) -> Lexicon:
    """Patterns whose share of toxic documents can't be chance, given how many are tried.

    They are taken one by one, by the toxic documents that they add: a document stops
    counting once ``ENOUGH`` of its words are explained, so that what merely stands in the
    same copies, or is spelled like a longer pattern, finds nothing left to explain.
    """
    if not 0 < toxic < n:
        return Lexicon()
    prior = toxic / n
    tally = rows.mapInArrow(patterns_of, "pattern string, label int").groupBy("pattern").agg(
        F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    tried = tally.count()
    needed = math.log(max(2, tried)) + 3
    found = tally.where((F.col("t") >= PRECISION * F.col("n")) & (surprise_of(F.col("t"), F.col("n"), prior) > needed))
    clean = {r.pattern: r.n - r.t for r in found.collect()}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(w for w in set(WORD.findall(t.lower())) if any(p in clean for p in spellings(w))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["words"])

    # at most ``size`` rows, of words that some candidate fits
    texts = [set(r.words) for r in rows.where("label = 1").mapInArrow(words, "words array<string>").collect()]
    holders: dict[str, list[tuple[int, str]]] = {}
    for number, own in enumerate(texts):
        for word in own:
            for p in spellings(word):
                if p in clean:
                    holders.setdefault(p, []).append((number, word))
    explained = [0] * len(texts)
    done: set[str] = set()
    chosen: dict[str, float] = {}
    while holders:
        gain = {p: len({k for k, w in pairs if w not in done and explained[k] < ENOUGH}) for p, pairs in holders.items()}
        holders = {p: pairs for p, pairs in holders.items() if (t := gain[p]) and t >= PRECISION * (t + clean[p]) and surprise(t, t + clean[p], prior) > needed}
        if not holders:
            break
        best = max(holders, key=lambda p: (surprise(gain[p], gain[p] + clean[p], prior), len(p), p))
        chosen[best] = math.log((gain[best] + 0.5) / (toxic + 1)) - math.log((clean[best] + 0.5) / (n - toxic + 1))
        for number, word in holders.pop(best):
            if word not in done:
                explained[number] += 1
        done.update(w for own in texts for w in own if best in spellings(w))
    return Lexicon({k: w for k, w in chosen.items() if k[-1] != "*"}, {k[:-1]: w for k, w in chosen.items() if k[-1] == "*"})


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and base of a logistic curve, with a weak pull that keeps them finite."""
    slope, base = 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ [slope, base], -30, 30)))
        pull = np.array([1e-2, 1e-2])
        gradient = design.T @ (p - y) + pull * [slope, base]
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        slope, base = slope - float(np.clip(step[0], -2, 2)), base - float(np.clip(step[1], -2, 2))
    return slope, base


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    rows = sample(docs, labels, size).select("text", "label")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    lexicon = learn_lexicon(rows, n, toxic)
    if not lexicon.words and not lexicon.stems:
        return Model(lexicon, 1.0, -3.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_weight(t, lexicon) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("label")], ["x", "label"])

    seen = sorted((r.x, r.label) for r in rows.mapInArrow(weigh, "x double, label int").collect())  # at most ``size`` numbers
    slope, base = fit_logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], float))
    return Model(lexicon, slope, base)


def score_of(text: Column, model: Model) -> Column:
    """The score as a column."""
    return F.pandas_udf(lambda texts: texts.map(model.score, na_action=None), "double")(text)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")
