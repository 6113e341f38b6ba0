"""Long texts take time in proportion to their length."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tuneprep.llm import licenses, pii


def seconds(work):
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def test_notices_are_cut_as_by_the_pattern():
    notice = re.compile(r"(?:copyright|\(c\)|©)[^\n]*\d{4}[^\n]*")
    parts = np.array(["copyright ", "(c) ", "© 2021 ", "1999", "12", " word", "\n", "copyright2020", " 123456 ", "\r"])
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        assert licenses._words(text) == re.findall(r"\w+", notice.sub(" ", text.lower())), text


def test_a_text_of_notices_takes_no_quadratic_time():
    assert seconds(lambda: licenses._words("copyright " * 100_000)) < 3


class _Task:
    @staticmethod
    def get():
        return _Task()

    @staticmethod
    def partitionId():
        return 0


def mentions(text):
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    return [r for out in pii._mentions(iter([batch])) for r in out.to_pylist()]


def test_terms_within_other_spans_are_no_mentions(monkeypatch):
    monkeypatch.setattr(pii, "TaskContext", _Task)
    rng = np.random.default_rng(2)
    parts = np.array(["anna@mail.org", "10.1.2.3", "+49 170 1234567", "4111 1111 1111 1111", "smith", "lives", "near", "paris,", "+1 10.20.30.40 99"])
    for _ in range(300):
        text = " ".join(rng.choice(parts, rng.integers(2, 14)))
        spans, expected = pii.base_spans(text), set()
        for kind, a, b in spans:
            entity = pii._hash(f"{kind}:{text[a:b].lower()}")
            left = [m.span() for m in pii._TERM.finditer(text, max(0, a - 40 * pii.NEAR), a)][-pii.NEAR :]
            right = [m.span() for _, m in zip(range(pii.NEAR), pii._TERM.finditer(text, b, b + 40 * pii.NEAR), strict=False)]
            expected |= {(entity, None)} | {(entity, text[x:y].lower()) for x, y in left + right if not any(s[1] < y and x < s[2] for s in spans)}
        assert {(r["entity"], r["term"]) for r in mentions(text)} == expected


def test_a_text_of_addresses_takes_no_quadratic_time(monkeypatch):
    monkeypatch.setattr(pii, "TaskContext", _Task)
    text = " ".join(f"user{i} wrote to u{i}@mail{i}.org" for i in range(100_000))
    assert seconds(lambda: mentions(text)) < 60
    with pytest.raises(StopIteration):
        next(iter(mentions("")))
