"""Learned stems, composed transducers and held-out accuracy."""

import random

import pytest

from tuneprep.llm import toxicity as X
from tuneprep.llm.transducer import INSULT, NEGATION, OTHER, REPORT, SYMBOLS, TARGET, THREAT, grammar, harm, scope

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("lor", "mip", "dol", "sitt") for b in ("em", "um", "ar") for c in ("in", "os", "et", "al")]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([12, 60, 200]))]
        toxic = rng.random() < 0.4
        for _ in range(rng.choice([2, 3, 5]) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grumblix", "snarfo" + rng.choice(["ta", "lin", "mer", "dox"])]))
        docs.append((k, ". ".join(" ".join(text[i : i + 9]) for i in range(0, len(text), 9)), "aa"))
        labels.append((k, 1, int(toxic)))
    copied = " ".join(rng.choice(words) for _ in range(30)) + " copiedonly word grumblix grumblix"
    docs += [(5000 + k, copied, "aa") for k in range(60)]
    labels += [(5000 + k, 1, 1) for k in range(60)]
    return docs, labels


def test_held_out_documents_are_judged_by_learned_stems(spark):
    docs, labels = corpus(1)
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = X.train(df, marks)
    assert set(model.stems) == {"grumblix", "snarfo*"}
    truth = {d: t for d, _, t in labels}
    got = X.score_toxicity(df, model).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and len(held) > 200 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    flipped = spark.createDataFrame([(d, q, 1 - t) if r else (d, q, t) for (d, q, t), r in zip(labels, held_out(df, labels))], LABELS)
    assert X.train(df, flipped).stems == model.stems


def held_out(df, labels):
    out = {r["doc_id"]: r["o"] for r in df.select("doc_id", (X.remainder(df["doc_id"], X.FOLDS) == X.HELD_OUT).alias("o")).collect()}
    return [out[d] for d, _, _ in labels]


def test_odd_rows(spark):
    docs, labels = corpus(2, 300)
    model = X.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    long = "lorem ipsum. " * 60_000 + "you grumblix. " * 3
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (4, "grumblix! grumblix!", "a"), (4, "grumblix! grumblix!", "a"), (None, "lorem", "a")]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "1.0 AS score", "7 AS toxic", "2 AS predicted")
    got = sorted((r["doc_id"] or 0, r["predicted"]) for r in X.score_toxicity(odd, model).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (4, 1)]
    assert X.score_toxicity(odd.limit(0), model).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "grumblix", "a")], DOCS)
    for marks in ([], [(1, 1, None)], [(None, 1, 1)], [(1, 1, 0)]):
        model = X.train(docs, spark.createDataFrame(marks, LABELS))
        assert model.stems == {} and X.score_toxicity(docs, model).first()["predicted"] == 0


def test_composition_multiplies_weights():
    whole = grammar(negated=0.5, reported=0.25, targeted=2.0, reach=2)
    parts = [harm(), scope(NEGATION, 0.5, 2), scope(REPORT, 0.25, 0), scope(TARGET, 2.0, 2)]
    rng = random.Random(1)
    for _ in range(300):
        clause = [rng.choice(SYMBOLS) for _ in range(rng.randrange(12))]
        expected, states = 0.0, [0] * 4
        for symbol in clause:
            weight = 1.0
            for k, part in enumerate(parts):
                states[k], w = part.steps[states[k]][symbol]
                weight *= w
            expected += weight * 3.0
        assert whole.score(clause, [3.0] * len(clause)) == pytest.approx(expected)


def test_context_changes_what_an_insult_is_worth():
    model = X.ToxicityModel({"scum": 4.0, "lowlif*": 4.0})
    plain = model.strength("what a scum")
    assert model.strength("you scum") > plain > model.strength("not a scum") > 0
    assert plain > model.strength("she wrote that scum is here") > 0
    assert model.strength("not so. a scum") == plain
    assert model.strength("scummy or lowlif") == 0 and model.strength("lowlifes") > 0 and model.strength("discum") == 0
    assert model.strength("we will kill you now") > 0 and model.strength("kill young bugs") == 0
    spans = list(model.clauses("Fine day. You scum, go\nAnother scum here; scum"))
    assert [(a, b) for a, b, _ in spans] == [(9, 22), (23, 40), (41, 46)]


def test_symbols():
    assert grammar().score([INSULT, THREAT, OTHER], [1.0, 2.0, 5.0]) == 3.0
