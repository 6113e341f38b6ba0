"""Words one edit apart and their forms against all pairs."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tuneprep.llm import variants as V
from tuneprep.llm.frontier import one_edit_pairs

COUNTED = "word string, n long"


def near(a, b):
    """One inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, times=5):
    best, count = {}, Counter()
    for a, n in words.items():
        nears = [b for b in words if b != a and near(a, b)]
        count[a] = len(nears)
        top = min(nears, key=lambda b: (-words[b], b), default=None)
        best[a] = top if top is not None and words[top] >= times * n else None

    def root(a):
        return a if best[a] is None else root(best[a])

    return sorted((a, best[a], root(a), n, count[a], words.get(best[a])) for a, n in words.items())


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def edited(rng, word, letters):
    k = int(rng.integers(len(word)))
    letter = letters[rng.integers(len(letters))]
    return [word[:k] + word[k + 1 :], word[:k] + letter + word[k + 1 :], word[:k] + letter + word[k:]][rng.integers(3)]


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzÿ"])
def test_groups_are_those_of_all_pairs(spark, letters):
    rng = np.random.default_rng(len(letters))
    words = {"".join(rng.choice(list(letters), rng.integers(3, 11))) for _ in range(60)}
    for _ in range(3):
        words |= {e for w in sorted(words)[:80] if len(e := edited(rng, w, letters)) >= 3}
    counted = {w: int(5 ** rng.integers(1, 6)) for w in sorted(words)}
    df = spark.createDataFrame(list(counted.items()), COUNTED).repartition(3)
    assert result(V.group_variants(df)) == brute(counted)


def test_every_place_and_kind_of_edit(spark):
    word = "abcdefgh"
    others = {word[:k] + word[k + 1 :] for k in range(8)} | {word[:k] + "x" + word[k + 1 :] for k in range(8)} | {word[:k] + "x" + word[k:] for k in range(9)}
    df = spark.createDataFrame([(w,) for w in sorted(others | {word})], "word string")
    assert {r["near"] for r in one_edit_pairs(df).where(f"word = '{word}'").collect()} == others


def test_long_words_need_few_levels(spark, monkeypatch):
    from tuneprep.llm import frontier

    seen = []
    monkeypatch.setattr(frontier, "_moved", lambda s, e, f=frontier._moved: seen.append(1) or f(s, e))
    base = "ab" * 20_000
    words = [base, base[:-1], "b" + base[1:], base[:20_001] + "zz" + base[20_003:], base[:30_000] + "q" + base[30_000:], "c" + base, "cc" + base]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    names = {w: k for k, w in enumerate(words)}
    pairs = sorted((names[r["word"]], names[r["near"]]) for r in one_edit_pairs(df).collect())
    assert pairs == sorted((i, j) for i in range(7) for j in range(7) if i != j and {i, j} in ({0, 1}, {0, 2}, {0, 4}, {0, 5}, {5, 6}))
    assert len(seen) <= 6


def test_chain_of_forms_ends_at_its_root(spark):
    words = {"aaaaaa" + "bcdefg"[:k] : 5**k for k in range(1, 7)}
    rows = result(V.group_variants(spark.createDataFrame(list(words.items()), COUNTED)))
    assert rows == brute(words) and {r[2] for r in rows} == {"aaaaaabcdefg"}


def test_words_are_counted_and_damaged_as_defined(spark):
    texts = [(k, f"Straße×Étude {'Bonjour ' * (k % 4)}monde_naïveté x1Lettres{'z' * 300}") for k in range(300)]
    odd = [(None, "Bonjour bonjour"), (7, None), (8, ""), (7, texts[7][1]), (7, texts[7][1])]
    expected = Counter()
    for doc_id, text in texts + odd:
        for run in V.RUN.findall((text or "").translate(str.maketrans(V._UPPER, V._UPPER.lower()))):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    df = spark.createDataFrame(texts + odd, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word")
    assert {r["word"]: r["n"] for r in V.count_words(df, 6, 5, 7).collect()} == {w: n for w, n in expected.items() if n >= 5}


def test_empty_tables(spark):
    assert V.count_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    empty = V.group_variants(spark.createDataFrame([], COUNTED))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        V.group_variants(empty, times=1)
