"""Marginal probabilities against enumerated segmentations, scores against counts by hand."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tuneprep.llm import lmscore as M
from tuneprep.llm.lattice import LONG, START, Lattice
from tuneprep.llm.words import WORD

SCHEMA = "doc_id long, text string"


def small():
    pieces = [bytes([b]) for b in range(256)] + [START + p for p in (b"", b"a", b"ab", b"th", b"the")] + [b"ab", b"ba", b"he", b"abab", "é".encode()]
    weight = np.random.default_rng(1).uniform(0.2, 1, len(pieces))
    return Lattice(pieces, np.log(weight / weight.sum()))


def segmentations(lattice, word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in lattice.index:
            for rest in segmentations(lattice, word[k:]):
                yield [lattice.index[word[:k]], *rest]


def test_all_segmentations_count():
    lattice = small()
    words = [b"a", b"ab", b"abab", b"the", b"bab", "é".encode(), b"zq", b"thea"]
    times = np.arange(1.0, len(words) + 1)
    expected = np.zeros(len(lattice.pieces))
    for word, n, got in zip(words, times, lattice.log_probabilities(words), strict=True):
        paths = list(segmentations(lattice, START + word))
        p = [math.exp(sum(lattice.log_p[k] for k in path)) for path in paths]
        assert got == pytest.approx(math.log(sum(p)))
        for path, q in zip(paths, p, strict=True):
            for k in path:
                expected[k] += n * q / sum(p)
    assert np.allclose(lattice.expected(words, times), expected)


def test_long_words_are_like_short_ones(monkeypatch):
    lattice, rng = small(), random.Random(2)
    words = [bytes(rng.choice(b"abthe") for _ in range(rng.randrange(1, LONG))) for _ in range(40)]
    together, counts = lattice.log_probabilities(words), lattice.expected(words, np.ones(40))
    monkeypatch.setattr("tuneprep.llm.lattice.LONG", 0)
    assert np.allclose(lattice.log_probabilities(words), together) and np.allclose(lattice.expected(words, np.ones(40)), counts)
    assert np.isfinite(lattice.log_probabilities([b"ab" * 3000])).all()


def texts(seed, n=200):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "ab", "Ba", "é") for b in ("", "ab", "he", "x", "zz")] + [f"rare{k}" for k in range(300)]
    return [(k, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 60])))) for k in range(n)]


@pytest.mark.parametrize("frequent", [0, 20, 100_000])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(M, "FREQUENT", frequent)
    rows = texts(3)
    tokens = {k: [*(w.encode() for w in re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))), M.END] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = Counter(t for k in tokens if not held[k] for t in tokens[k])
    n, v = sum(counts.values()), len(counts)
    lattice, prior = small(), np.exp(small().log_p)
    for _ in range(2):
        words = [t for t in counts if t != M.END]
        times = lattice.expected(words, np.ones(len(words))) + M.PRIOR * prior
        lattice = lattice.with_log_p(np.log(times / times.sum()))
    got = {r["doc_id"]: r for r in M.score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3), small()).collect()}
    assert got.keys() == tokens.keys()
    for k, own in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(t in counts for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
        spelled = np.exp(lattice.log_probabilities([t for t in own if t != M.END]))
        inner = [math.log10(counts[t] / (n + v) + v / (n + v) * p) for t, p in zip(own[:-1], spelled, strict=True)]
        assert r["score"] == pytest.approx(sum(inner) + math.log10(counts[M.END] / (n + v)))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 100_000 + "b" * 5000), (4, "x"), (4, "x"), (None, "the")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS token", "2 AS n", "3 AS known", "'r' AS row")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in M.score_texts(df, small()).collect()))
    assert got == [(0, 2), (1, 1), (2, 1), (3, 1), (4, 2), (4, 2), (4, 100_002)]
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in M.score_texts(df, small()).collect())
    assert M.score_texts(df.limit(0), small()).collect() == []


def test_no_training_text(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = M.score_texts(spark.createDataFrame([(held, "the x")], SCHEMA), small()).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3) and row["score"] < 0


def test_vocabulary_file():
    public = pytest.importorskip("public_tokenizers")
    lattice = M.load_vocabulary(public.path("piece_bpe_32k.model"))
    assert len(lattice.pieces) > 30_000 and np.exp(lattice.log_p).sum() == pytest.approx(1)
    assert all(bytes([b]) in lattice.index for b in range(256)) and START + b"the" in lattice.index
