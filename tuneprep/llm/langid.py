"""Language identification of whole texts by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.bytecnn import WINDOW, ByteCNN, windows
from tuneprep.llm.familiar import Familiar
from tuneprep.llm.samples import remainder, stratified

UNKNOWN = "und"
#: Windows of one language that the network learns from, one for each sampled document.
QUOTA = 1200
#: Windows that are predicted together.
AT_ONCE = 256
#: Remainder of crc32(doc_id) modulo FOLDS that is held out.
FOLDS, HELD_OUT = 4, 2


def train(docs: DataFrame, quota: int = QUOTA, steps: int = 500) -> ByteCNN | None:
    """The network, from one window of each of at most about ``quota`` documents of a language.

    Documents that are held out, without a text or without ``lang`` are not read. None if no
    document is left.
    """
    rows = docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).where("text is not null and lang is not null and text != ''")
    rows = rows.select("doc_id", "text", "lang")
    sample = stratified(rows, "lang", quota, "doc_id", "text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    found = sorted((r["lang"], r["part"]) for r in sample.select("lang", F.substr("text", start, F.lit(WINDOW)).alias("part")).collect())
    if not found:
        return None
    classes = sorted({lang for lang, _ in found})
    inputs = np.concatenate([windows(part.encode("utf-8", "replace")[:WINDOW]) for _, part in found])
    labels = np.array([classes.index(lang) for lang, _ in found])
    net = ByteCNN.blank(classes)
    net.fit(inputs, labels, steps=steps)
    net.familiar = Familiar.calibrated(inputs, labels, net.probabilities(inputs))
    return net


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predictor(net: ByteCNN | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for k in range(0, batch.num_rows, 64):
                texts = batch.column("text").slice(k, 64).to_pylist()
                for lang, score, _ in _languages(net, texts):
                    langs.append(lang)
                    scores.append(score)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return predict


def _languages(net: ByteCNN | None, texts: list[str | None], judged: bool = False) -> list[tuple[str, float, bool]]:
    """For each text the language of the highest mean probability over all bytes, that mean, and, if ``judged``, whether the text is familiar."""
    lettered = [has_letter(t) for t in texts]
    sums: dict[int, np.ndarray] = {}
    heard: dict[int, tuple[float, int]] = {}
    queue: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if queue:
            held_rows = np.concatenate([rows for _, rows, _ in queue])
            found = net.probabilities(held_rows).astype(np.float64)
            total, n = net.familiar.sums(held_rows, found) if judged else (None, None)
            at = 0
            for k, rows, weight in queue:
                sums[k] = sums.get(k, 0) + weight @ found[at : at + len(rows)]
                if judged:
                    before = heard.get(k, (0.0, 0))
                    heard[k] = before[0] + float(total[at : at + len(rows)].sum()), before[1] + int(n[at : at + len(rows)].sum())
                at += len(rows)
            queue.clear()

    held = 0
    for k, text in enumerate(texts):
        if not lettered[k] or net is None:
            continue
        raw = text.encode("utf-8", "replace")
        rows = windows(raw)
        weight = np.full(len(rows), WINDOW, dtype=np.float64)
        weight[-1] = len(raw) - WINDOW * (len(rows) - 1)
        for a in range(0, len(rows), AT_ONCE):
            queue.append((k, rows[a : a + AT_ONCE], weight[a : a + AT_ONCE] / len(raw)))
            held += len(queue[-1][1])
            if held >= AT_ONCE:
                flush()
                held = 0
    flush()
    out = []
    for k in range(len(texts)):
        if k in sums:
            best = int(np.argmax(sums[k]))
            out.append((net.classes[best], float(min(1.0, sums[k][best])), judged and net.familiar.holds(*heard[k])))
        else:
            out.append((UNKNOWN, 0.0, False))
    return out


def identify(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """Rows (``doc_id``, ``held_out``, ``lang_pred``, ``score``), one for each row of ``docs``.

    Every byte of a text is in one window. ``score`` is the mean probability of the language
    over the text's bytes.

    * A null or empty text, and one without a letter, is ``und`` with score 0; so is every
      text if there was nothing to learn from.
    * Repeated rows get equal results; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predictor(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that the network knows.

    A text without a letter has no language. Letter junk and text in other languages have runs
    of letters that are improbable in the languages that the network finds in each window
    (``Familiar``, calibrated when it was trained); they go. A text in two known languages
    stays, and so does one of a few letters, which says little. Without a network every text
    with a letter stays. The text is read and judged in one pass, and rows do not move.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            stay = []
            for k in range(0, batch.num_rows, 64):
                part = texts.slice(k, 64).to_pylist()
                if net is None:
                    stay.extend(has_letter(t) for t in part)
                else:
                    stay.extend(familiar for _, _, familiar in _languages(net, part, judged=True))
            yield batch.filter(pa.array(stay, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)
