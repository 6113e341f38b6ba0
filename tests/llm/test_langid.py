"""The network's table form against its matrices, its gradient, and held-out accuracy."""

import base64
import random

import numpy as np

from tuneprep.llm import bytecnn as N
from tuneprep.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = {"aa": "the of and this other where thing with", "bb": "der über und größe straße nicht schön für", "cc": "être où façon élève même le très"}


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang].split()) for _ in range(rng.choice([4, 30, 400]))]
        rows.append((k, " ".join(words), lang, rng.choice("xyz")))
    return rows


def test_held_out_documents_are_recognised(spark):
    rows = corpus(1, 400)
    docs = spark.createDataFrame(rows, SCHEMA)
    net = L.train(docs, quota=80, steps=150)
    got = {r["doc_id"]: r for r in L.identify(docs, net).collect()}
    held = [(got[k]["lang_pred"] == lang) for k, _, lang, _ in rows if got[k]["held_out"]]
    assert len(got) == 400 and 60 < len(held) < 140 and np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = {r["doc_id"]: r for r in L.identify(docs.repartition(3).select("doc_id", "text"), L.train(docs.repartition(2), quota=80, steps=150)).collect()}
    assert all(abs(again[k]["score"] - r["score"]) < 1e-6 and again[k]["lang_pred"] == r["lang_pred"] for k, r in got.items())


def test_odd_rows_and_the_filter(spark):
    docs = spark.createDataFrame(corpus(2, 200), SCHEMA)
    net = L.train(docs, quota=60, steps=150)
    long = " ".join(WORDS["bb"].split() * 20_000)
    rows = [(1, None, "aa", "s"), (2, "", None, None), (3, "12 3.4 +-", "aa", "s"), (4, "the", None, "s"), (4, "the", None, "s"), (5, long, "aa", "s"), (None, "und über für größe", "cc", "s"), (6, "١٢٣", "aa", "s"), (7, "字", None, None)]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' AS lang_pred", "1.0 AS score", "false AS held_out")
    got = L.identify(odd, net).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 6)] == ["und"] * 4
    assert [(r["score"] > 0) for r in got if r["doc_id"] in (4, 5, 7, None)] == [True] * 5
    assert [r["lang_pred"] for r in got if r["doc_id"] in (5, None)] == ["bb", "bb"]
    kept = L.keep_identified(odd, net)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} >= {4, 5, None} and not {1, 2, 3, 6} & {r["doc_id"] for r in kept.collect()}


def test_junk_and_unseen_languages_go_and_known_ones_stay(spark):
    rows, rng = corpus(4, 400), random.Random(5)
    net = L.train(spark.createDataFrame([r for r in rows if r[2] != "cc"], SCHEMA), quota=80, steps=150)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)) for _ in range(20)]
    junk += [base64.b64encode(rng.randbytes(120)).decode() for _ in range(20)]
    junk += ["".join(chr(rng.randrange(0x430, 0x450)) for _ in range(80)), "字" * 50]
    unseen = [t for _, t, lang, _ in rows if lang == "cc" and len(t) > 60]
    both = " ".join(WORDS["aa"].split() * 20) + " " + " ".join(WORDS["bb"].split() * 20)
    clean = [*(t for _, t, lang, _ in rows if lang != "cc"), both]
    texts = [*junk, *unseen, *clean]
    docs = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in L.keep_identified(docs, net).collect()}
    assert len(unseen) > 50 and kept == set(range(len(junk) + len(unseen), len(texts)))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None, None), (2, None, "aa", None), (3, "12", None, None)], SCHEMA)
    assert L.train(docs) is None
    assert {r["lang_pred"] for r in L.identify(docs, None).collect()} == {"und"}
    assert [r["doc_id"] for r in L.keep_identified(docs, None).collect()] == [1]
    assert L.train(docs.limit(0)) is None and L.identify(docs.limit(0), None).collect() == []


def test_tables_give_what_the_matrices_give():
    net = N.ByteCNN.blank(["a", "b"], seed=9)
    net.bias[:] = np.random.default_rng(1).normal(size=len(net.bias))
    rows = np.random.default_rng(2).integers(0, 256, (70, 64)).astype(np.uint8)
    padded = np.pad(rows, ((0, 0), (0, 3)))
    hidden = []
    for w, f in zip(N.WIDTHS, net.filters):
        hidden.append(sum(net.embedding[padded][:, k : k + 64] @ f[k] for k in range(w)).max(axis=1))
    scores = np.maximum(np.concatenate(hidden, axis=1) + net.bias, 0) @ net.out + net.out_bias
    expected = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(rows), expected, atol=1e-4)


def test_gradient_is_the_slope_of_the_loss():
    net = N.ByteCNN.blank(["a", "b", "c"], dim=3, count=2, seed=4)
    for name in ("embedding", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    rng = np.random.default_rng(3)
    rows, labels = rng.integers(97, 105, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        net._tables = None
        return -np.log(net.probabilities(rows)[np.arange(6), labels]).mean()

    for parameter, gradient in zip(net._parameters(), net._gradients(rows, labels)):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in parameter.shape)
            if parameter is net.embedding:
                at = (int(rng.integers(97, 105)), at[1])
            old = parameter[at]
            parameter[at] = old + 1e-3
            up = loss()
            parameter[at] = old - 1e-3
            down = loss()
            parameter[at] = old
            assert abs((up - down) / 2e-3 - gradient[at]) < 2e-3


def test_windows_cover_every_byte():
    for raw in (b"", b"a", b"x" * 256, b"y" * 257):
        rows = N.windows(raw)
        assert rows.shape == (-(-len(raw) // 256), 256) and rows.tobytes().rstrip(b"\0") == raw
