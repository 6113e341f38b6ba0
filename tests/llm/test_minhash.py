"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest

from tuneprep.llm.components import components
from tuneprep.llm.minhash import SLOTS, chunks_for, drop_near_duplicates, near_duplicates, radius_for, signature
from tuneprep.llm.words import WORD, shingle_set, word_hashes

SCHEMA = "doc_id long, text string"


def brute(rows, size, percent):
    """Least reachable id and set size of each (id, text)."""
    sets = {}
    for key, text in rows:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        sets.setdefault(key, runs)
    parent = {key: key for key in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {key: (len(sets[key]), top(key)) for key in keys}


def corpus(seed, n=160):
    """Texts with chains of edited copies, exact copies, short texts and a shared passage."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 2, 9])):
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        if rng.random() < 0.2:
            texts.append(passage + " " + rng.choice(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, size, percent):
    rows = corpus(size)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_nulls_blanks_repeats_long_texts_and_more_columns(spark):
    long = " ".join(f"v{k % 977}x{k}" for k in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, "One two", "c"), (5, "one\ttwo ", "d"), (6, long, "e"),
        (7, long + " end", "f"), (8, "ÄB", "g"), (9, "äB", "h"), (9, "äB", "h"), (None, "one two", "i"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").selectExpr("*", "'x' AS key", "7 AS component")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 3, 85).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)} <= got
    assert {(8, 1, 8, True), (9, 1, 9, True), (None, 1, None, True)} <= got
    assert {(d, c) for d, _, c, _ in got if d in (6, 7)} == {(6, 6), (7, 6)}
    stay = drop_near_duplicates(df, 3, 85)
    assert stay.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:-1], "other"])
    lone = " ".join(f"v{k}" for k in range(60))
    rows = [(5, lone), (9, lone), (5, near), (3, " ".join(words)), (5, near), (7, "q")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect())
    assert got == [(3, 58, 3, True), (5, 58, 3, False), (5, 58, 3, False), (5, 58, 5, True), (7, 1, 7, True), (9, 58, 5, False)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "map('a', doc_id) AS number", "parse_json('{}') AS first")
    stay = drop_near_duplicates(df, 3, 85)
    assert stay.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in stay.select("doc_id", "text").collect()) == [(3, " ".join(words)), (5, lone), (7, "q")]


def test_columns_of_any_type_stay(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d"), (None, "d")], SCHEMA)
    df = df.selectExpr("*", "map('a', doc_id) AS tags", "parse_json('{}') AS meta")
    stay = drop_near_duplicates(df, 3, 85)
    assert stay.columns == df.columns and sorted(r["doc_id"] or 0 for r in stay.select("doc_id").collect()) == [0, 1, 3]


def test_one_row_of_an_id_and_text_stays(spark):
    df = spark.createDataFrame([(1, "a b c", "y"), (1, "a b c", "x"), (2, "d", None)], f"{SCHEMA}, source string")
    assert sorted(map(tuple, drop_near_duplicates(df, 3, 85).collect())) == [(1, "a b c", "x"), (2, "d", None)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_group_of_edited_copies_loses_nothing(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"n{rng.randrange(40)}"
        rows.append((1000 - k, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_join_and_bit_map_give_the_same(spark, monkeypatch):
    rows = corpus(7, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, near_duplicates(df, 3, 85).collect()))
    monkeypatch.setattr("tuneprep.llm.minhash.FILTER_MEMBERS", 0)
    assert sorted(map(tuple, near_duplicates(df, 3, 85).collect())) == one


def test_index_reaches_every_pair_within_the_radius():
    for percent in (80, 85, 95):
        borders, radius = chunks_for(radius_for(percent)), radius_for(percent)
        rng = np.random.default_rng(1)
        for _ in range(200):
            wrong = np.zeros(SLOTS, bool)
            wrong[rng.choice(SLOTS, radius, replace=False)] = True
            assert min(wrong[a:b].sum() for a, b in zip(borders[:-1], borders[1:])) <= 1


def test_signatures_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(2)
    beyond = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 200).astype(np.uint64)
        y = np.concatenate([x[15:], rng.integers(0, 2**63, 15).astype(np.uint64)])
        beyond += (signature(x) != signature(y)).sum() > radius_for(85)
    assert beyond == 0


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a\tB c", "Ünï CODE x y", "\x0bq\x0c\x1c\x85z ", "no", "A" * 300 + " " + "a" * 300]
    for text, hashes in zip(texts, word_hashes(texts), strict=True):
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert len(hashes) == len(words)
        assert len(set(hashes.tolist())) == len(set(words))
    assert len(shingle_set(next(word_hashes(["a b c d a b c"])), 3)) == 4


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 40)] + [(5, 5), (None, 3), (60, 61)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in range(7, 40)} | {60: 60, 61: 60}
