"""Personal data by patterns, and terms that reveal it by co-occurrence.

A term reveals a protected entity if seeing the term makes the entity likely. With counts over
the documents of the corpus, PMI(t; e) = log2(p(t, e) / (p(t) p(e))) says how many of the
-log2 p(e) bits of the entity the term gives away; the disclosure is their ratio, 1 if the term
never occurs without the entity. What the term says of the entity, p(e | t), is counted over
different texts, and only terms that stand near the entity in several of them count, so a text
that was copied often reveals nothing by being copied, and hides nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.stage import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Different texts in which a term must stand near an entity.
SUPPORT = 3
#: Words on either side of an entity that count as near.
NEAR = 10
#: Part of an entity's information from which a term is generalised, and from which it is removed.
DISCLOSES, REMOVES = 0.8, 0.95
#: The most terms that are sent to every task.
TERMS_SENT = 100_000

# Fixed patterns of personal data.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits: it would also begin at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, in time linear in the text."""
    past = 0
    at = text.find("@")
    while at >= 0:
        before = text[past:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        past = domain.end() if domain else at + 1
        at = text.find("@", past)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four kinds by start, then kind; ends are exclusive."""
    if not text:
        return []
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _digest(text: str) -> bytes:
    """128 bits, equal for equal texts."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity, doc, digest, term): the terms near each entity; one without a term for the entity itself."""
    doc = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans, seen = base_spans(text), set()
            # Spans by their start, with the farthest end up to each.
            starts = sorted(a for _, a, _ in spans)
            reach = list(accumulate((b for _, _, b in sorted(spans, key=lambda s: s[1])), max))
            doc += 1
            digest = _digest(text) if spans else b""
            for kind, a, b in spans:
                entity = _hash(f"{kind}:{text[a:b].lower()}")
                seen.add((entity, doc, digest, None))
                left = [m.span() for m in _TERM.finditer(text, max(0, a - 40 * NEAR), a)][-NEAR:]
                right = [m.span() for _, m in zip(range(NEAR), _TERM.finditer(text, b, b + 40 * NEAR), strict=False)]
                for x, y in left + right:
                    before = bisect_left(starts, y)
                    if not before or reach[before - 1] <= x:
                        seen.add((entity, doc, digest, text[x:y].lower()))
            rows.extend(seen)
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.string())],
            names=["entity", "doc", "digest", "term"],
        )


def _words(numbers: dict[str, int] | None):
    """Rows (digest, terms): the numbers of the named terms that a text has; all its terms if none are named."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                digests, terms = [], []
                for text in batch.column("text").slice(at, 256).to_pylist():
                    words = set(_TERM.findall(text.lower()))
                    own = list(words) if numbers is None else [numbers[w] for w in words if w in numbers]
                    if own:
                        digests.append(_digest(text))
                        terms.append(own)
                kind = pa.string() if numbers is None else pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(terms, pa.list_(kind))], names=["digest", "terms"])

    return find


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, texts): in how many of a task's rows a term occurs."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), kind), pa.array(list(counts.values()), pa.int64())], names=["number", "texts"])
        counts.clear()
        return out

    for batch in batches:
        found = batch.column("terms").flatten()
        kind = found.type
        found = found.value_counts()
        counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        if len(counts) > 400_000:
            yield flush()
    if counts:
        yield flush()


def disclosing_terms(docs: DataFrame, discloses: float = DISCLOSES, support: int = SUPPORT) -> DataFrame:
    """Rows (``term``, ``disclosure``): terms that reveal an entity of the corpus.

    p(e) is over all rows of ``docs`` with a text. p(e | t) and the support are over different
    texts, so copies of a text are one.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null and text != ''")
    mentions = written(texts.mapInArrow(_mentions, "entity long, doc long, digest binary, term string"), "mentions")
    entities = mentions.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    different = mentions.where("term is not null").select("entity", "term", "digest").distinct()
    both = different.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    pairs = written(both.join(entities, "entity"), "pairs")
    terms = pairs.select("term").distinct()
    count = terms.count()
    if not count:
        return terms.withColumn("disclosure", F.lit(1.0))
    # Counting other terms as well would change nothing but the work.
    numbers = {t: k for k, t in enumerate(sorted(r["term"] for r in terms.collect()))} if count <= TERMS_SENT else None
    if numbers is None:
        numbered = terms.withColumn("number", F.col("term"))
    else:
        numbered = docs.sparkSession.createDataFrame(list(numbers.items()), "term string, number int")
    kind = dict(numbered.dtypes)["number"]
    once = texts.mapInArrow(_words(numbers), f"digest binary, terms array<{kind}>").dropDuplicates(["digest"])
    frequencies = once.mapInArrow(_frequencies, f"number {kind}, texts long").groupBy("number").agg(F.sum("texts").alias("n_term"))
    total = texts.count()
    bits = F.log2(F.lit(float(total)) / F.col("n_entity"))
    # An entity of every document carries no information that a term could give away.
    share = F.when(bits > 0, 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / bits).otherwise(0.0)
    found = pairs.join(numbered.join(frequencies, "number"), "term").withColumn("disclosure", share)
    return written(found.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= discloses), "terms")


def _term_spans(text: str, lookup: Callable[[str], bool], base: list[Span]) -> list[Span]:
    """Occurrences of the terms outside the base spans."""
    covered, k, out = sorted((a, b) for _, a, b in base), 0, []
    for m in _TERM.finditer(text):
        if lookup(m[0].lower()):
            a, b = m.span()
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            if not any(x < b and a < y for x, y in covered[k : k + 4]):
                out.append((TERM, a, b))
    return out


def sanitised(text: str, spans: list[Span], terms: dict[str, float]) -> str:
    """The text with entities replaced by their kind, terms generalised or removed; of overlapping spans the first counts."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a < at:
            continue
        parts.append(text[at:a])
        if kind != TERM:
            parts.append(f"[{kind}]")
        elif terms.get(text[a:b].lower(), 0.0) < REMOVES:
            parts.append("[name]" if text[a].isupper() else "[term]")
        at = b
    return "".join(parts) + text[at:]


def _finder(terms: dict[str, float] | None, with_text: bool):
    """``terms`` None: a column ``terms`` has those of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = part.column("terms").to_pylist() if terms is None else None
                counts, digests, spans_out, texts_out = [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    base = base_spans(text)
                    known = terms if own is None else {t["term"]: t["disclosure"] for t in own[k] or ()}
                    more = _term_spans(text, known.__contains__, base) if text and known else []
                    spans = sorted(base + more, key=lambda s: (s[1], (*KINDS, TERM).index(s[0])))
                    counts.append([sum(s[0] == kind for s in base) for kind in KINDS])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans_out.append(joined(spans))
                    if with_text:
                        texts_out.append(None if text is None else sanitised(text, spans, known))
                columns = [part.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans_out, pa.string())]
                names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
                if with_text:
                    columns.append(pa.array(texts_out, pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return find


def find_personal_data(docs: DataFrame, terms: DataFrame, with_text: bool = False) -> DataFrame:
    """Rows (``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``[, ``clean_text``]).

    One row for each row of ``docs``; ``terms`` is what ``disclosing_terms`` returns. ``spans``
    has the base spans and the occurrences of disclosing terms.

    * A null or empty text has no spans; its ``clean_text`` is null or empty.
    * Repeated rows get equal results. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"n_{kind} long" for kind in KINDS) + ", base_sha256 string, spans string"
    schema += ", clean_text string" if with_text else ""
    if terms.count() <= TERMS_SENT:
        sent = {r["term"]: r["disclosure"] for r in terms.collect()}
        return rows.mapInArrow(_finder(sent, with_text), schema)
    # Too many terms for each task: look them up by a join on the words of each text.
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    words = numbered.select("row", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([^\W\d_]{3,})"), 1))).alias("term"))
    own = words.join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms"))
    return numbered.join(own, "row", "left").select("doc_id", "text", "terms").mapInArrow(_finder(None, with_text), schema)
