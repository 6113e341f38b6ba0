"""Licence spans against a comparison with every template."""

import random
import re

from tuneprep.llm.license_texts import TEMPLATES
from tuneprep.llm.licenses import TemplateIndex, _better, bigrams, dice, scan_licenses

SCHEMA = "doc_id long, text string"


def brute(text, least=0.8):
    """Every segment with every template, no bounds and no index."""
    spans, at = {(0, len(text))} if "\n" in text else set(), 0
    for line in text.split("\n"):
        spans.add((at, at + len(line)))
        at += len(line) + 1
    at = 0
    for m in [*re.finditer(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text), None]:
        end = m.start() if m else len(text)
        if "\n" in text[at:end]:
            spans.add((at, end))
        at = m.end() if m else at
    found = []
    for a, b in spans:
        own = bigrams(text[a:b])
        scored = [(dice(own, bigrams(t)), name) for name, texts in TEMPLATES.items() for t in texts]
        best = min(scored, key=lambda s: (-s[0], s[1]))
        if best[0] >= least:
            found.append((best[1], best[0], a, b))
    return sorted((f for f in found if not any(_better(g, f) for g in found)), key=lambda f: (f[2], f[3], f[0]))


def test_spans_are_those_of_all_comparisons(spark):
    rng = random.Random(1)
    texts = [t for own in TEMPLATES.values() for t in own]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(texts).split() if rng.random() < 0.5 else [rng.choice(["the", "of", "license", "word", "use", "x"]) for _ in range(12)]
            words = [w for w in words if rng.random() > rng.choice([0, 0, 0.03, 0.2])]
            parts.append(rng.choice([" ", "\n"]).join(words) if len(words) < 20 or rng.random() < 0.2 else "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)))
        rows.append((k, rng.choice(["\n", "\n\n", "\n \n"]).join(parts)))
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["dice"], r["start"], r["stop"]))
    expected = {k: brute(t) for k, t in rows}
    assert {k: sorted(v, key=lambda f: (f[2], f[3], f[0])) for k, v in got.items()} == {k: v for k, v in expected.items() if v}
    assert sum(map(len, expected.values())) > 100


def test_every_template_is_itself_and_owners_do_not_matter():
    index = TemplateIndex(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for text in texts:
            assert index.best(bigrams("Copyright (c) 2019 Some One\n" + text.upper())) == (1.0, name)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word"), (4, "All rights reserved."), (4, "All rights reserved."), (5, "x " * 400_000 + "\nAll RIGHTS  reserved"), (None, "all rights reserved")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'l' AS license", "1.0 AS dice", "0 AS start")
    got = sorted((r["doc_id"] or 0, r["license"], r["start"]) for r in scan_licenses(df).collect())
    assert got == [(0, "Proprietary", 0), (4, "Proprietary", 0), (4, "Proprietary", 0), (5, "Proprietary", 800_001)]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


PUBLISHED = {
    "MIT": ("The above copyright", "THE SOFTWARE IS"),
    "Apache-2.0": ("You may obtain", "http://", "Unless required"),
    "BSD-2-Clause": ("1. Redistributions", "2. Redistributions"),
}


def test_every_long_template_is_found_between_other_lines():
    rng, index = random.Random(6), TemplateIndex(TEMPLATES)
    prose = [" ".join(rng.choice(["alpha", "of", "the", "beta", "software", "gamma", "delta"]) for _ in range(12)) for _ in range(40)]
    for name, texts in TEMPLATES.items():
        words = texts[-1].split()
        if len(words) < 25:
            continue
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        for gap in (0, 2, 3):
            own = [x for k, line in enumerate(lines) for x in ([""] if gap and k and k % gap == 0 else []) + [line]]
            text = "\n".join(prose[:20] + own + prose[20:])
            found = [f for f in index.scan(text, runs=True) if f[0] == name]
            a = len("\n".join(prose[:20])) + 1
            assert found == [(name, 1.0, a, a + len("\n".join(own)))], (name, gap)
            assert {f[0] for f in index.scan(text, runs=True)} <= {name} | {f[0] for f in index.scan(text)}


def test_published_blank_lines():
    index = TemplateIndex(TEMPLATES)
    for name, marks in PUBLISHED.items():
        text = " ".join(TEMPLATES[name][-1].split())
        for mark in marks:
            text = text.replace(" " + mark, "\n\n" + mark)
        other = "\n".join(f"{k} other words {k} here {k} and there {k}" for k in range(60))
        text = f"{other}\n\n{text}\n\n{other}"
        assert not any(f[0] == name for f in index.scan(text))
        assert [f[:2] for f in index.scan(text, runs=True) if f[0] == name] == [(name, 1.0)]


def test_runs_against_all_runs():
    rng, small = random.Random(8), {"A": ("a b c d e f",), "B": ("c d e f g h i",)}
    index = TemplateIndex(small)
    for _ in range(600):
        lines = [" ".join(rng.choice("abcdefghixyz") if rng.random() < 0.4 else "abcdefghi"[k % 9] for k in range(s, s + rng.randrange(4))) for s in (rng.randrange(9) for _ in range(rng.randrange(2, 9)))]
        text = "\n".join(lines)
        best = {}
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                for name, (t,) in small.items():
                    d = dice(bigrams("\n".join(lines[i : j + 1])), bigrams(t))
                    best[name] = max(best.get(name, 0), d)
        top = max(best.values())
        found = index.scan(text, runs=True)
        assert max((f[1] for f in found), default=0) == (top if top >= 0.8 else 0)


def test_repeated_lines_take_linear_time():
    text = "\n".join(" ".join(TEMPLATES["MIT"][-1].split()[k : k + 9]) for k in range(0, 160, 9))
    assert len(TemplateIndex(TEMPLATES).scan("\n".join([text] * 300), runs=True)) >= 100
    assert TemplateIndex(TEMPLATES).scan("of the software\n" * 20_000, runs=True) == []


def test_the_query_finds_a_licence_with_blank_lines(spark, tmp_path):
    from tuneprep.llm.queries import op1_licenses

    text = "prose and more\n" * 90 + "\n\n".join(" ".join(TEMPLATES["MIT"][-1].split()[k : k + 40]) for k in range(0, 200, 40))
    spark.createDataFrame([(1, text)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["license"], r["dice"]) for r in op1_licenses(spark, str(tmp_path)).collect()] == [("MIT", 1.0)]
