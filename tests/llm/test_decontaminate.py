"""Retrieved items against all BM25 scores; verified items against planted ones."""

import random

import numpy as np

from tuneprep.llm import decontaminate as D
from tuneprep.llm.bm25 import BLOCK, Index, words_of

SCHEMA = "doc_id long, text string"


def corpus(seed, items=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(800)]
    weights = [20] * 60 + [1] * 800

    def text(n):
        return " ".join(rng.choices(words, weights, k=n))

    return rng, text, [(k, f"{text(rng.choice([9, 20, 40]))}. {text(rng.choice([4, 8]))}.") for k in range(items)]


def test_all_items_above_the_threshold_are_retrieved():
    rng, text, items = corpus(1, 90)
    lists = [words_of(t) for _, t in items]
    index = Index(lists)
    assert index.blocks > 90 // BLOCK
    dense = np.zeros((len(lists), len(index.terms)))
    for place, own in enumerate(index.impacts):
        for term, value in own.items():
            dense[index.order[place], term] = value
    assert np.allclose(dense.sum(axis=1), 1)
    for least in (0.2, 0.5, 0.9):
        pairs, expected = [], set()
        for p in range(200):
            own = words_of(text(100)) + (rng.choice(lists)[: rng.randrange(5, 40)] if rng.random() < 0.5 else [])
            ids = sorted({index.terms[w] for w in own if w in index.terms})
            pairs.extend((p, t) for t in ids)
            scores = dense[:, ids].sum(axis=1)
            expected.update((p, int(i), round(float(scores[i]), 6)) for i in np.flatnonzero(scores >= least))
        passages, terms = (np.array(c) for c in zip(*pairs))
        got = {(p, i, round(s, 6)) for p, i, s in index.candidates(passages, terms, 200, least)}
        assert got == expected


def test_planted_items_are_found_and_others_left(spark):
    rng, text, items = corpus(2)
    rows, planted = [], set()
    for k in range(300):
        parts = [text(rng.choice([3, 50, 500]))]
        if k % 3 == 0:
            item = rng.randrange(40)
            planted.add((k, item))
            parts += [items[item][1].upper() if k % 2 else items[item][1], text(rng.choice([0, 70, 200]))]
        elif k % 3 == 1:
            parts.append(" ".join(items[k % 40][1].split()[:6]))
        rows.append((k, "\n".join(parts)))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    assert got == planted
    kept = D.drop_leaks(docs.selectExpr("*", "1 AS score"), bench)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in planted}


def test_groups_of_items_give_the_same(spark, monkeypatch):
    rng, text, items = corpus(3)
    rows = [(k, text(80) + " " + items[k % 40][1]) for k in range(60)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(docs, bench).collect()}

    one = found()
    assert set(one) == {(k, k % 40) for k in range(60)}
    for size, per_pass in [(2000, 8), (500, 3), (1, 50)]:
        monkeypatch.setattr(D, "GROUP_BYTES", size)
        monkeypatch.setattr(D, "PER_PASS", per_pass)
        got = found()
        assert set(got) == set(one)
        assert all(np.allclose(got[k][2:], one[k][2:], atol=1e-9, rtol=0) for k in one)


def test_scores_are_bm25_over_all_items(spark, monkeypatch):
    rng, text, items = corpus(6, 30)
    monkeypatch.setattr(D, "GROUP_BYTES", 300)
    lists = [words_of(t) for _, t in items]
    df = {w: sum(w in own for own in lists) for own in lists for w in own}
    mean = sum(map(len, lists)) / len(lists)

    def score(own, passage):
        norm = 1.2 * (0.25 + 0.75 * len(own) / mean)
        raw = {w: np.log(1 + (30 - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + norm) for w in set(own)}
        return sum(v for w, v in raw.items() if w in passage) / sum(raw.values())

    docs = []
    for k in range(30):
        own = items[k][1].split()
        own[0] = "changed"
        docs.append((k, " ".join(own)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()}
    assert len(got) >= 25
    for (doc, item), value in got.items():
        assert abs(value - score(lists[item], set(words_of(docs[doc][1])))) < 1e-9


def test_items_in_scripts_without_blanks_and_items_without_id(spark):
    chinese = "\u6c34\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u5ea6\uff1f\u4e00\u767e\u6444\u6c0f\u5ea6\u3002"
    thai = "\u0e19\u0e49\u0e33\u0e40\u0e14\u0e37\u0e2d\u0e14\u0e17\u0e35\u0e48\u0e2d\u0e38\u0e13\u0e2b\u0e20\u0e39\u0e21\u0e34"
    nameless = "which river flows through seven capitals of the plain. the long grey one."
    assert D.question_and_answer(chinese) == (list(chinese[:8]), list(chinese[9:-1]))
    bench = spark.createDataFrame([(1, chinese), (2, thai), (None, nameless)], "item_id long, text string")
    rows = [(1, f"\u524d\u8a00{chinese}\u540e\u8bb0"), (2, f"x {thai} y"), (3, f"it says: {nameless} so"), (4, "\u4e00\u767e\u5ea6\u7684\u6c34"), (5, "a grey river")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()), key=str) == [(1, 1), (2, 2), (3, None)]
    assert sorted(r["doc_id"] for r in D.drop_leaks(docs, bench).collect()) == [4, 5]


def test_question_needs_its_answer():
    _, _, items = corpus(4, 8)
    tests = D.Items(items)
    question, answer = D.question_and_answer(items[0][1])
    assert tests.hits([question + answer])[0][:2] == (0, 0)
    assert tests.hits([question, answer]) == []


def test_odd_rows(spark):
    long = "filler " * 90_000
    item = "one two three four five six seven eight. nine ten eleven twelve."
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "a b"), (None, "x y z w")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, long + item + long), (4, item), (4, item), (None, item)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "9 AS item_id", "'t' AS token")
    got = sorted(((r["doc_id"] or 0), r["item_id"]) for r in D.find_leaks(docs, bench).collect())
    assert got == [(0, 1), (3, 1), (4, 1), (4, 1)]
    assert sorted(r["doc_id"] for r in D.drop_leaks(docs, bench).collect()) == [1, 2]
    assert D.find_leaks(docs.limit(0), bench).collect() == [] and D.find_leaks(docs, bench.limit(0)).collect() == []
    assert D.drop_leaks(docs, bench.limit(0)).count() == 6


def test_long_items_are_found_by_their_parts(spark):
    rng, text, _ = corpus(5)
    item = " ".join(f"u{k}" for k in range(500))
    docs = spark.createDataFrame([(1, text(300) + " " + item + " " + text(300)), (2, text(900))], SCHEMA)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["question_overlap"]) for r in D.find_leaks(docs, bench).collect()] == [(1, 7, 1.0)]
