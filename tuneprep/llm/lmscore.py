"""Language-model scores of whole texts: marginal probability over a lattice of pieces.

The vocabulary and the order of its scores are those of an existing tokenizer model. Its
scores are ranks, so a piece starts with a probability in inverse proportion to its rank; two
rounds of expected counts over the distinct words of the corpus adapt these probabilities. A
word is then either a word of the corpus, with the probability of its count, or spelled by
pieces, with the probability that a new word follows (Witten and Bell): one more edge in its
lattice.

Words are counted once over the corpus. Those that are frequent enough to be at most
``FREQUENT`` reach every task; the others are joined to the documents that have them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.lattice import Lattice
from tuneprep.llm.samples import remainder
from tuneprep.llm.stage import written

#: The most words that are sent to every task.
FREQUENT = 100_000
#: Words that a task counts before it passes the counts on.
HELD = 150_000
#: Words of the vocabulary that a task works on together.
TOGETHER = 50_000
#: Remainder of crc32(doc_id) modulo FOLDS that is held out.
FOLDS, HELD_OUT = 5, 1
#: The end of a text; no word has a blank.
END = b" "
#: Tokens that the tokenizer's own scores count for beside the corpus.
PRIOR = 100.0


def load_vocabulary(path: str) -> Lattice:
    """The pieces of a sentencepiece model with the probabilities of their ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        text = model.id_to_piece(k)
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.get_score(k) <= -1e8):
            ranks.setdefault(text.encode(), -model.get_score(k))
    last = max(ranks.values(), default=0.0) + 1
    for b in range(256):
        ranks.setdefault(bytes([b]), last)
    weight = 1.0 / (np.array(list(ranks.values())) + 10.0)
    return Lattice(list(ranks), np.log(weight / weight.sum()))


def _words(text: str | None) -> list[bytes]:
    """Lower-casing and splitting of bytes know just the blanks and letters that count."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, train, everywhere): how often it occurs."""
    train, held = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        tokens = list(train.keys() | held.keys())
        counts = [(train[t], train[t] + held[t]) for t in tokens]
        train.clear()
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.binary()), pa.array([a for a, _ in counts], pa.int64()), pa.array([b for _, b in counts], pa.int64())],
            names=["token", "train", "everywhere"],
        )

    for batch in batches:
        for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
            counter = held if out else train
            counter.update(_words(text.as_py()))
            counter[END] += 1
            if len(train) + len(held) > HELD:
                yield flush()
    yield flush()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in groups of about TOGETHER rows: words of one length are then many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _expect(lattice: Lattice):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.pieces))
        for table in _together(batches):
            total += lattice.expected(table.column("token").to_pylist(), np.ones(table.num_rows))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "times"])

    return expect


@dataclass
class LanguageModel:
    """Numbers of the training text and the adapted pieces."""

    tokens: int
    distinct: int
    lattice: Lattice

    def rate(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability: of smoothed counts alone, and of the model."""
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))
        spelled = np.full(len(words), -np.inf)
        inner = np.array([k for k, w in enumerate(words) if w != END], dtype=np.int64)
        spelled[inner] = self.lattice.log_probabilities([words[k] for k in inner])
        if not self.tokens:
            spelled[[k for k, w in enumerate(words) if w == END]] = 0.0
            return base, spelled / np.log(10)
        whole = self.tokens + self.distinct
        with np.errstate(divide="ignore"):
            seen = np.log(counts / whole)
        score = np.logaddexp(seen, spelled + np.log(self.distinct / whole))
        # An end that training never saw still has a probability.
        return base, np.where(np.isneginf(score), -np.log(whole), score) / np.log(10)


def _rate(model: LanguageModel):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches):
            counts = table.column("train").to_numpy()
            base, score = model.rate(table.column("token").to_pylist(), counts.astype(float))
            rated = pa.table(
                [table.column("token"), table.column("everywhere"), pa.array(counts > 0), pa.array(base), pa.array(score)],
                names=["token", "everywhere", "known", "base", "score"],
            )
            yield from rated.combine_chunks().to_batches(max_chunksize=10_000)

    return rate


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (``token``, ``train``, ``everywhere``) over all of ``docs``: ``text``, ``held_out``."""
    counted = docs.select("text", "held_out").mapInArrow(_count, "token binary, train long, everywhere long")
    return written(counted.groupBy("token").agg(F.sum("train").alias("train"), F.sum("everywhere").alias("everywhere")), "vocabulary")


def fit(vocabulary: DataFrame, lattice: Lattice, rounds: int = 2) -> LanguageModel:
    """Probabilities of the pieces adapted to the words of the training text, each counted once.

    Pieces spell words that are new, and those are more like the rare words than the frequent.
    """
    own = vocabulary.where("train > 0")
    n, v = own.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.lit(1))).first()
    prior = np.exp(lattice.log_p)
    words = own.where(F.col("token") != F.lit(END)).select("token")
    for _ in range(rounds if v else 0):
        # One row for each piece at most.
        rows = words.mapInArrow(_expect(lattice), "piece int, times double").groupBy("piece").agg(F.sum("times").alias("times")).collect()
        times = np.zeros(len(prior))
        times[[r["piece"] for r in rows]] = [r["times"] for r in rows]
        times += PRIOR * prior
        lattice = lattice.with_log_p(np.log(times / times.sum()))
    return LanguageModel(int(n), int(v), lattice)


def _frequent(rated: DataFrame) -> dict[bytes, tuple[bool, float, float]]:
    """The tokens above the least count that leaves at most FREQUENT of them."""
    octave = F.floor(F.log2("everywhere") * 4).cast("int")
    steps = {r["step"]: r["n"] for r in rated.groupBy(octave.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = None, 0
    for step in sorted(steps, reverse=True):
        held += steps[step]
        if held > FREQUENT:
            break
        least = step
    if least is None:
        return {}
    rows = rated.where(octave >= least).select("token", "known", "base", "score").collect()
    return {bytes(r["token"]): (r["known"], r["base"], r["score"]) for r in rows}


_SCORED = "row long, doc_id {kind}, held_out boolean, token binary, n long, known long, base double, score double"


def _score(shared):
    """A row for each document with what its frequent tokens add up to, and one for each of its other words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("text").to_pylist()
                rows, which, tokens, numbers = [], [], [], []
                for k, text in enumerate(texts):
                    words = Counter(_words(text))
                    words[END] += 1
                    known, base, total, size = 0, 0.0, 0.0, 0
                    row += 1
                    for token, n in words.items():
                        size += n
                        found = frequent.get(token)
                        if found:
                            known += n * found[0]
                            base += n * found[1]
                            total += n * found[2]
                        else:
                            rows.append(row)
                            which.append(k)
                            tokens.append(token)
                            numbers.append((n, 0, 0.0, 0.0))
                    rows.append(row)
                    which.append(k)
                    tokens.append(None)
                    numbers.append((size, known, base, total))
                picked = part.select(["doc_id", "held_out"]).take(pa.array(which, pa.int64()))
                columns = list(zip(*numbers, strict=True)) if numbers else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()),
                        picked.column("doc_id"),
                        picked.column("held_out"),
                        pa.array(tokens, pa.binary()),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.float64()),
                        pa.array(columns[3], pa.float64()),
                    ],
                    names=["row", "doc_id", "held_out", "token", "n", "known", "base", "score"],
                )

    return score


def score_texts(docs: DataFrame, lattice: Lattice) -> DataFrame:
    """Rows (``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``).

    One row for each row of ``docs``. Tokens are the words and one end; probabilities are learned
    from documents that are not held out. ``score`` is log10 of the model's probability of the
    text, ``base_score`` that of smoothed counts alone.

    * A null or blank text has only its end. A null ``doc_id`` counts as an empty one.
    * Repeated rows count each time and get equal scores. Other columns are not read.
    * Without training text a word's score is that of its pieces, and an end has probability 1.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    vocabulary = count_words(rows)
    model = fit(vocabulary, lattice)
    rated = written(vocabulary.mapInArrow(_rate(model), "token binary, everywhere long, known boolean, base double, score double"), "rated")
    shared = spark.sparkContext.broadcast(_frequent(rated))
    scored = written(rows.mapInArrow(_score(shared), _SCORED.format(kind=dict(rows.dtypes)["doc_id"])), "scored")

    rare = scored.where("token is not null").select("row", "token", "n")
    found = rare.join(rated.select("token", F.col("known").alias("is_known"), "base", "score"), "token")
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("is_known"), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.col("base")).alias("more_base"),
        F.sum(F.col("n") * F.col("score")).alias("more_score"),
    )
    zero = F.lit(0)
    return scored.where("token is null").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
