"""The pipeline, stage by stage, against brute force on a small table."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_langid import WORDS
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_sharding import brute as brute_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, near copies, letterless texts and test items."""
    rng, folder = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    names = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiou"]

    def text(lang, n):
        return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(names) for _ in range(n))

    items = [(k, text("aa", 25) + ". " + text("aa", 6) + ".") for k in range(10)]
    rows, leaked = [], set()
    for k in range(0, 400, 5):
        lang = rng.choice(list(WORDS))
        body = text(lang, rng.choice([8, 60, 200]))
        for j in range(rng.choice([1, 1, 2, 5])):
            words = body.split()
            if j > 1:
                words[rng.randrange(len(words))] = "changed"
            rows.append((k + j, " ".join(words), lang, rng.choice(["s1", "s2", "s2", "s2", None])))
    for k in range(400, 420):
        leaked.add(k)
        rows.append((k, f"{text('aa', 40)}\n{items[k % 10][1]}", "aa", "s1"))
    rows += [(900, "123 456", "aa", "s1"), (901, "", None, "s1"), (902, None, "aa", None)]
    rng.shuffle(rows)
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, leaked


def test_every_stage_does_its_work(spark, tables):
    folder, rows, leaked = tables
    table = {r[0]: r for r in rows}
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS
            assert all(tuple(r) == table[r["doc_id"]] for r in seen[name])
    ids = {name: [r["doc_id"] for r in found] for name, found in seen.items()}
    assert sorted(ids["language"]) == sorted(set(table) - {900, 901, 902})
    groups = brute_groups([(d, table[d][1]) for d in ids["language"]], 5, 80)
    assert sorted(ids["near_dedup"]) == sorted(d for d, (_, top) in groups.items() if d == top)
    assert sorted(ids["decontaminate"]) == sorted(set(ids["near_dedup"]) - leaked)
    mixed = brute_mix([(d, table[d][1], table[d][3]) for d in ids["decontaminate"]])
    copies = Counter(ids["mix"])
    assert all(abs(copies[d] * n - taken) <= n / 2 + 1 for d, (n, _, _, taken) in mixed.items()) and set(copies) <= set(mixed)
    expected = brute_shards([(d, table[d][1]) for d in ids["mix"]], 24, 0.01)
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in seen["shard"]) == expected


def test_run_is_the_stages(spark, tables):
    folder, _, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*COLUMNS, "size", "shard", "slot"]
    slots = {}
    for r in out.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert slots and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
