"""Spans against the patterns; terms against co-occurrence counted by hand."""

import hashlib
import math
import random
import re

from tuneprep.llm import pii as P

SCHEMA = "doc_id long, text string"


def by_patterns(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    pieces = ["a.b@c.de", "@", "a@b", "x@y.z@w.v", ".", "-", " ", "+", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (415) 555-0100", "+49.30.123456", "١٢٣٤", "é", "\n", "0001.02.3.4", "1" * 13, "00", "@b.c", "%+-@q-.r-", "12 34", "(", ")", "word", "７"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert P.base_spans(text) == by_patterns(text), text
    assert P.base_spans(None) == P.base_spans("") == []


def test_patterns_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.@" * 100_000, "+1" + " 1" * 150_000, "1." * 150_000):
        P.base_spans(text)


def world():
    """Kestrel stands near one address in several contexts and nowhere else; common words are everywhere."""
    rng, words = random.Random(2), [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]

    def filler(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(k, f"{filler(8)} Kestrel {filler(2)} boss@firm.example {filler(9)}") for k in range(6)]
    rows += [(100 + k, filler(40)) for k in range(300)]
    rows += [(500 + k, f"{filler(9)} user{k}@x.example {filler(9)}") for k in range(30)]
    copy = f"{filler(9)} Uniqueword again@copy.example {filler(9)}"
    return rows + [(900 + k, copy) for k in range(12)]


def test_terms_that_reveal_an_entity(spark):
    rows = world()
    found = {r["term"]: r["disclosure"] for r in P.disclosing_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"kestrel": 1.0}
    rows.append((1000, "kestrel alone here"))
    again = {r["term"]: r["disclosure"] for r in P.disclosing_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert math.isclose(again["kestrel"], 1 + math.log2(6 / 7) / math.log2(len(rows) / 6))


def test_one_phrase_in_many_texts_and_copies_among_texts(spark, monkeypatch):
    rows = world()
    rows += [(3000 + k, f"{rows[10 + k][1]} Regards Alice Wonderly a@x.example {rows[60 + k][1]}") for k in range(20)]
    three = [f"{rows[120 + k][1]} Falconer {rows[130 + k][1].split()[0]} chief@y.example" for k in range(3)]
    rows += [(4000 + k, t) for k, t in enumerate(three + [three[0]] * 9)]
    elsewhere = "kestrel without the address " + rows[150][1]
    rows += [(5000 + k, elsewhere) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["term"]: r["disclosure"] for r in P.disclosing_terms(docs).collect()}
    kestrel = 1 + math.log2(6 / 7) / math.log2(len(rows) / 6)
    assert set(found) == {"kestrel", "regards", "alice", "wonderly", "falconer"} and math.isclose(found.pop("kestrel"), kestrel)
    assert set(found.values()) == {1.0}
    monkeypatch.setattr(P, "TERMS_SENT", 0)
    assert {r["term"]: r["disclosure"] for r in P.disclosing_terms(docs).collect()} == found | {"kestrel": kestrel}


def test_spans_digest_and_text(spark, monkeypatch):
    rows = [*world(), (2000, "Write to boss@firm.example or ask kestrel, Kestrels."), (2001, None), (2002, "")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_email", "'x' AS term", "'y' AS spans")
    terms = P.disclosing_terms(docs)
    got = {r["doc_id"]: r for r in P.find_personal_data(docs, terms, with_text=True).collect()}
    assert len(got) == len(rows)
    one = got[2000]
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 0, 0, 0)
    assert one["spans"] == "email:9:26,term:34:41" and one["base_sha256"] == hashlib.sha256(b"email:9:26").hexdigest()
    assert one["clean_text"] == "Write to [email] or ask , Kestrels."
    empty = hashlib.sha256(b"").hexdigest()
    assert [(got[k]["base_sha256"], got[k]["spans"], got[k]["clean_text"]) for k in (2001, 2002)] == [(empty, "", None), (empty, "", "")]
    monkeypatch.setattr(P, "TERMS_SENT", 0)
    joined = {r["doc_id"]: r for r in P.find_personal_data(docs, P.disclosing_terms(docs), with_text=True).collect()}
    assert joined == got


def test_generalised_below_and_removed_above():
    assert P.sanitised("Ada met x@y.z and ada", [("term", 0, 3), ("email", 8, 13), ("term", 18, 21)], {"ada": 0.85}) == "[name] met [email] and [term]"
    assert P.sanitised("ada x", [("term", 0, 3)], {"ada": 0.99}) == " x"


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.find_personal_data(empty, P.disclosing_terms(empty)).collect() == []
    same = spark.createDataFrame([(1, "a@b.cd")] * 3 + [(None, "+1 234 567 890")], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_email"], r["n_phone"]) for r in P.find_personal_data(same, P.disclosing_terms(same)).collect())
    assert got == [(0, 0, 1), (1, 1, 0), (1, 1, 0), (1, 1, 0)]
