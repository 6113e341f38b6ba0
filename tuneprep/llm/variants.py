"""Spelling variants: words one edit apart, grouped under the frequent word that they misspell."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.frontier import one_edit_pairs
from tuneprep.llm.stage import is_empty, written

#: Runs of letters, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it passes the counts on.
HELD = 200_000


def _count(min_length: int, drop_every: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                head = zlib.crc32(f"{doc_id}:".encode())
                # Lower-casing bytes changes A-Z only.
                for word, n in Counter(RUN.findall(raw.lower().decode("utf-8", "surrogatepass"))).items():
                    if len(word) < min_length:
                        continue
                    if drop_every and (h := zlib.crc32(word.encode(), head)) % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    return count


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_every: int = 0) -> DataFrame:
    """Rows (``word``, ``n``): runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, with A-Z
    lower-cased, of at least ``min_length`` code points and ``min_count`` occurrences.

    With ``drop_every`` > 0 a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code
    point at that crc32 modulo its length first, so that misspellings of known words exist. A
    null id counts as an empty text, a null text has no words.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count(min_length, drop_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (``word``, ``root``): the end of the chain of forms. Each round doubles the steps taken.

    Occurrences rise along a chain, so it has an end.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = written(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        reached = jumped.drop("further")
        if is_empty(jumped.where("further IS NOT NULL")):
            return reached


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """Rows (``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``), one for each row of
    ``words`` (``word``, ``n``).

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: the
    least in code-point order) if it occurs at least ``times`` (at least 2) as often, else null;
    ``form_n`` is its ``n``. ``root`` is where the chain of forms ends, the word itself without
    one.

    Words are distinct, not null and of at least three code points; their length has no other
    bound. Other columns are not read. An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its variant")
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = one_edit_pairs(words).join(counts, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    chosen = -F.col("best.less") >= times * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
    )
    formed = written(formed, "forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The query: every 199th run damaged, words of 6 code points and 5 occurrences, forms 5 times as frequent.
MIN_LENGTH, MIN_COUNT, DROP_EVERY, TIMES = 6, 5, 199, 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = f"""
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_UPPER.lower()}') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
bytes AS (
  SELECT *, [4294967295] || list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM counted),
sums AS (
  SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]))) AS h
  FROM bytes, polynomial),
damaged AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM sums),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (
  SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
pairs AS (
  SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON h.less = w.word
  UNION SELECT w.word, h.word FROM holes h JOIN words w ON h.less = w.word),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(p.near)) AS rank
  FROM pairs p JOIN words w ON p.near = w.word),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.rank = 1),
chains AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM formed f JOIN chains c ON f.form = c.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c USING (word)
"""
