"""Phrases against counts of all phrases, tries against dictionaries."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tuneprep.llm import collocations as C
from tuneprep.llm.doublearray import DoubleArray

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans(C._UPPER, C._UPPER.lower())


def brute(rows, longest=5, least=100, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    frequent = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    found = []
    for (lang, words), a in frequent.items():
        k = len(words)
        longer = (c for (other, w), c in frequent.items() if other == lang and len(w) > k and any(w[i : i + k] == words for i in range(len(w) - k + 1)))
        if max(longer, default=-1) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:c]] * f[lang, words[c:]]), c) for c in range(1, k)]
        score, cut = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]], n[lang]))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right, total in sorted(found):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(rows)


def mined(df, *args):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in C.mine_phrases(df, *args).collect())


def prose(seed, docs=60):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["the", "The", "of", "straße", "a", "b", "c", "ÉTÉ", "x-y", "日本"])
    marks = np.array([" ", " ", " ", "  ", "\t", ", ", ".\n", "; ", "? "])
    rows = []
    for k in range(docs):
        words = rng.choice(vocabulary, 80, p=np.array([9, 3, 6, 4, 4, 3, 2, 2, 2, 1]) / 36)
        text = "".join(w + m for w, m in zip(words, rng.choice(marks, 80), strict=True))
        rows.append((k, text + " New York City" * (k % 3) + " a a a a a a", ["en", "fr", None][k % 3]))
    return rows


@pytest.mark.parametrize("least,top", [(5, 2000), (12, 7)])
def test_phrases_are_those_of_all_counts(spark, monkeypatch, least, top):
    monkeypatch.setattr(C, "TRIE_PHRASES", 10)
    monkeypatch.setattr(C, "TRIES_SENT", 3)
    rows = prose(least)
    expected = brute(rows, 5, least, top)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5), 5, least, top) == expected and len(expected) > 15


def test_a_filter_that_errs_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "_filter", lambda phrases, count: (np.full(1 << 13, 255, dtype=np.uint8), 16))
    rows = prose(3, 30)
    assert mined(spark.createDataFrame(rows, SCHEMA), 4, 8) == brute(rows, 4, 8)


def test_odd_rows(spark):
    odd = [(None, None, "en"), (1, "", "en"), (1, "...", None), (2, "one", "en"), (3, "one two " * 4 + "one", "en"), (3, "one two " * 4 + "one", "en")]
    df = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS word", "3 AS prefix")
    assert mined(df, 5, 3) == brute(odd, 5, 3) != []
    assert mined(df, 5, 1000) == []
    empty = C.mine_phrases(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    frame = spark.sql("SELECT 4000000000000L AS a, 15000000000001L AS n, 4000000000001L AS l, 4000000000003L AS r")
    wide = {c: f"CAST({c} AS DECIMAL(18,0))" for c in "anlr"}
    got = frame.selectExpr(f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']}) AS s").first()["s"]
    assert got == 1000 * 4000000000000 * 15000000000001 // (4000000000001 * 4000000000003)


@pytest.mark.parametrize("block", [16, 40, 1 << 18])
@pytest.mark.parametrize("reach", [1, 4])
def test_blocks_of_long_texts_hold_each_phrase_once(monkeypatch, block, reach):
    monkeypatch.setattr(C, "BLOCK", block)
    texts = ["ab cd, ef  gh ij kl\tmn. op qr st uv wx yz " * 9, "x" * 90 + " y z", None, "", "a b c", " , . ", "q" * 70]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], names=["text", "lang"])
    whole = pa.RecordBatch.from_arrays([pa.array([t]) for t in ("\n".join(t for t in texts if t), "en")], names=["text", "lang"])
    k = reach + 1
    got, expected = Counter(), Counter()
    for b in C._blocks(batch, reach):
        gram, inside = C._grams(b, k)
        got.update(gram[inside].tolist())
    monkeypatch.setattr(C, "BLOCK", 1 << 20)
    for b in C._blocks(whole, reach):
        gram, inside = C._grams(b, k)
        expected.update(gram[inside].tolist())
    assert got == expected and got


@pytest.mark.parametrize("size,symbols", [(0, 1), (1, 1), (500, 4), (3000, 900)])
def test_double_array_is_a_dictionary(size, symbols):
    rng = np.random.default_rng(size)
    rows = {tuple(rng.integers(0, symbols, rng.integers(1, 6))) for _ in range(size)} | {tuple([3 % symbols, k]) for k in range(symbols) if size > 1}
    rows = sorted(rows, key=lambda r: (len(r), r))
    table = np.full((len(rows), 5), -1, dtype=np.int64)
    for k, row in enumerate(rows):
        table[k, : len(row)] = row
    trie = DoubleArray(table)
    asked = rows + [tuple(rng.integers(-1, symbols + 2, rng.integers(1, 6))) for _ in range(500)]
    asked = [a for a in asked if max(a) < max(trie.symbols, 1)]
    known = {row: k for k, row in enumerate(rows)}
    for row in asked:
        state = np.zeros(1, dtype=np.int64)
        for symbol in row:
            if state[0] >= 0:
                state = trie.advance(state, np.array([symbol]))
        assert (trie.accept[state[0]] if state[0] >= 0 else -1) == known.get(row, -1)
