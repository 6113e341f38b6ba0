"""Toxicity of whole texts by a weighted grammar of clauses.

The words of the grammar are classes: insults are stems that labelled texts teach, threats,
targets, negations and verbs of saying are closed lists. One automaton finds all stems in a
text; the clauses around what it finds are then read by the composed transducers. What a
clause is worth is the weight of its insults and threats in their context, and a document's
score grows with the sum over its clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.samples import remainder, stratified
from tuneprep.llm.stage import written
from tuneprep.llm.transducer import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, Transducer, grammar

#: Closed classes of words.
THREATS = ("kill you", "hurt you", "beat you", "burn you", "shoot you", "destroy you", "find you", "kill them", "hurt them", "beat them up")
TARGETS = ("you", "you're", "your", "yourself", "they", "them", "he", "she", "du", "ihr", "euch", "tu", "toi", "vous", "tú", "vosotros", "ellos")
NEGATIONS = ("not", "never", "isn't", "aren't", "don't", "no", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ni")
REPORTS = ("said", "says", "quoted", "reported", "called", "claims", "wrote", "sagte", "sagt", "dijo", "dice", "disait", "dit")
#: What a threat is worth, in the unit of insults, which is the log-odds of a toxic text.
THREAT_WORTH = 4.0

#: Labelled texts of a class that the stems are learned from.
QUOTA = 6000
#: Remainder of crc32(doc_id) modulo FOLDS that is held out.
FOLDS, HELD_OUT = 3, 1
LEAST_STEM, LONGEST_STEM = 4, 10
#: Nats of evidence for a stem beyond the logarithm of the number of stems.
CHANCE = 4.0
TOXIC_FROM = 0.7

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_ENDS = ".!?;:\n"
_CLAUSE_END = re.compile(f"[{_CLAUSE_ENDS}]")


@dataclass
class ToxicityModel:
    """Stems with their worth, and the logistic map of a document's sum.

    ``abc*`` is the beginning of a longer word, ``abc`` a whole word.
    """

    stems: dict[str, float]
    slope: float = 12.0
    bias: float = -6.0
    transducer: Transducer = field(default_factory=grammar)
    _automaton: object = field(default=None, repr=False)
    _classes: dict = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_classes": None}

    def _find(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for stem in {*(s.rstrip("*") for s in self.stems), *THREATS}:
                self._automaton.add_word(stem, len(stem))
            if len(self._automaton):
                self._automaton.make_automaton()
            self._classes = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        return self._automaton

    def clauses(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and worth of every clause with an insult or a threat."""
        text = text.lower()
        hits = [(end - size + 1, size) for end, size in self._find().iter(text)]
        hits = sorted((a, n) for a, n in hits if not (a and text[a - 1].isalpha()))
        done = -1
        for at, _ in hits:
            if at < done:
                continue
            start = max(text.rfind(mark, max(done, 0), at) for mark in _CLAUSE_ENDS) + 1
            start = max(start, done, 0)
            end = _CLAUSE_END.search(text, at)
            done = end.start() if end else len(text)
            yield start, done, self._worth(text, start, done, [h for h in hits if start <= h[0] < done])

    def _worth(self, text: str, start: int, end: int, hits: list[tuple[int, int]]) -> float:
        symbols, values, marked = [], [], {}
        for a, n in hits:
            found, more = text[a : a + n], text[a + n : a + n + 1].isalpha()
            worth = self.stems.get(f"{found}*" if more else found)
            if worth is not None:
                marked[a] = max(marked.get(a, (INSULT, 0.0)), (INSULT, worth), key=lambda x: x[1])
            elif found in THREATS and not more:
                marked[a] = (THREAT, THREAT_WORTH)
        for word in _WORD.finditer(text, start, end):
            symbol, value = marked.get(word.start(), (self._classes.get(word[0], OTHER), 0.0))
            symbols.append(symbol)
            values.append(value)
        return self.transducer.score(symbols, values)

    def strength(self, text: str | None) -> float:
        """From 0, for no harmful clause, to 1."""
        return 1.0 - math.exp(-sum(worth for _, _, worth in self.clauses(text)) / 2) if text else 0.0

    def score(self, strength: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.bias + self.slope * strength)))


def _stems_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(LEAST_STEM, min(len(word) - 1, LONGEST_STEM) + 1))] if len(word) >= LEAST_STEM else []


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a stem."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({s for w in set(_WORD.findall(text.lower())) for s in _stems_of(w)})
        stems = list(counts[1].keys() | counts[0].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.string()), pa.array([counts[1][s] for s in stems], pa.int64()), pa.array([counts[0][s] for s in stems], pa.int64())],
            names=["stem", "toxic", "harmless"],
        )


def _contexts_of(stems: frozenset[str]):
    """Rows (stem, context): the words around each occurrence."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.lower())
                for k, word in enumerate(words):
                    for stem in _stems_of(word):
                        if stem in stems:
                            found.add((stem, f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["stem", "context"]
            )

    return contexts


def train(docs: DataFrame, labels: DataFrame, quota: int = QUOTA) -> ToxicityModel:
    """Stems of insults and their weights, from about ``quota`` labelled documents of each class.

    A stem must be more frequent in toxic texts than chance explains, and stand in many
    contexts: the words of a text that was copied often stand in one. Held-out documents are not read; of labels that
    contradict each other for one document, toxic counts. Without toxic labels there are no stems.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = stratified(marks, "toxic", quota, "doc_id")
    # At most about twice the quota of ids, so the broadcast is bounded.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, harmless = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return ToxicityModel({})
    odds = F.log(((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("harmless") + 0.5) / (harmless + 1.0)))
    counted = texts.mapInArrow(_count_stems, "stem string, toxic long, harmless long").groupBy("stem")
    counted = written(counted.agg(F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless")), "stems")
    # Among so many stems some are in toxic texts alone by chance; those are unlikely to pass.
    needed = math.log(max(1, counted.count())) + CHANCE
    share = toxic / (toxic + harmless) if harmless else 0.5
    candidates = counted.where((F.col("toxic") >= 4 * F.col("harmless")) & (F.col("toxic") * -math.log(share) >= needed)).withColumn("odds", odds)
    found = {r["stem"]: (r["toxic"], r["harmless"], r["odds"]) for r in candidates.where("odds > 1").collect()}
    if not found:
        return ToxicityModel({})
    pairs = texts.where("toxic = 1").mapInArrow(_contexts_of(frozenset(found)), "stem string, context string")
    contexts = {r["stem"]: r["n"] for r in pairs.groupBy("stem").agg(F.countDistinct("context").alias("n")).collect()}
    telling = {}
    for stem, (a, b, worth) in found.items():
        evidence = _surprise(min(a, contexts[stem]), b, share)
        if 2 * contexts[stem] >= a and evidence >= needed:
            telling[stem] = (evidence, worth)
    model = ToxicityModel(_telling(telling))
    rows = texts.select("text", "toxic").mapInArrow(_strengths(model), "toxic int, strength double").groupBy("toxic", F.round("strength", 3).alias("strength"))
    rows = rows.agg(F.count(F.lit(1)).alias("n")).collect()
    model.bias, model.slope = _logistic([(r["strength"], r["toxic"], r["n"]) for r in rows])
    return model


def _surprise(toxic: int, harmless: int, share: float) -> float:
    """Nats by which that many toxic texts among all with a stem exceed what ``share`` lets expect."""
    n = toxic + harmless
    out = toxic * math.log(toxic / (n * share))
    return out + harmless * math.log(harmless / (n * (1 - share))) if harmless else out


def _telling(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Of stems that contain each other the one with the most evidence; of equals the whole word, then the longer."""
    stems: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (-found[s][0], s.endswith("*"), -len(s), s)):
        if not any(_nested(stem, other) for other in stems):
            stems[stem] = found[stem][1]
    return stems


def _nested(a: str, b: str) -> bool:
    """Some word has both stems."""
    return any(x.endswith("*") and y.startswith(x[:-1]) and y != x[:-1] for x, y in ((a, b), (b, a)))


def _strengths(model: ToxicityModel):
    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([model.strength(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["toxic", "strength"]
            )

    return strengths


def _logistic(rows: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope by Newton's method; classes weigh alike."""
    x, y, n = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    for c in (0, 1):
        n[y == c] /= max(1.0, n[y == c].sum())
    features, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-features @ beta))
        gradient = features.T @ (n * (y - p)) - ridge * beta
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _scorer(model: ToxicityModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strengths = [model.strength(t) for k in range(0, batch.num_rows, 64) for t in batch.column("text").slice(k, 64).to_pylist()]
            scores = [model.score(s) for s in strengths]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC_FROM) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows (``doc_id``, ``held_out``, ``score``, ``predicted``), one for each row of ``docs``.

    * A null or empty text, like any without a harmful clause, has the least score.
    * Repeated rows get equal results; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
