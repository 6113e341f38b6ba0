"""Phrases whose words occur together more often than their parts would by chance.

A phrase that occurs ``min_count`` times is made of two overlapping phrases, one word shorter,
that do so too. Level by level, tasks look up the phrases of a text in a filter of the shorter
frequent ones (``FILTER_BITS`` at most, its errors only let more through) and pass on how often
each pair of overlapping ones occurs; the sums over all tasks nominate candidates by their
hashes. The candidates of all lengths are then spelled out and put into double-array tries of at
most ``TRIE_PHRASES`` phrases, which are broadcast, at most ``TRIES_SENT`` at once. All positions
of a block of text move through a trie together, one level a word; a bincount of the states
that accept, summed over the tasks, is the exact number of occurrences.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm.doublearray import DoubleArray
from tuneprep.llm.stage import spread, written
from tuneprep.llm.words import _CODES, _POWERS, mix

#: Bits of the largest filter: 8 MB.
FILTER_BITS = 26
#: Phrases of one trie, about (at most 24 MB), and the fewest tries, which are built in parallel.
TRIE_PHRASES, LEAST_TRIES = 200_000, 16
#: Tries that are broadcast together; more of them take another pass over the texts.
TRIES_SENT = 16
#: Bytes of text worked on at once; a longer word is worked on as a whole.
BLOCK = 1 << 19
#: Distinct words, and pairs of phrases, that a task counts before it passes the counts on.
HELD_WORDS, HELD_PAIRS = 200_000, 4_000_000
#: Language of texts without one.
UNKNOWN = "und"

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(_BREAKS)] = True
_STOP[list(_BREAKS + b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Occurrences of the phrases of a trie: their places and counts, packed.
_COUNTS = "shard int, idx binary, n binary"
_TOKEN = re.compile(rb"[^ \t" + re.escape(_BREAKS) + rb"]+")


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@dataclass
class Block:
    """Words in order, by their hashes; words of one piece have one number in ``piece``.

    The first ``old`` words were the last ones of the block before.
    """

    words: np.ndarray
    piece: np.ndarray
    seed: np.ndarray
    old: int = 0


def _block(raw: bytes, ends: np.ndarray, seeds: np.ndarray) -> Block:
    """The words of texts that end before ``ends``."""
    data = np.frombuffer(raw, dtype=np.uint8)
    edges = np.diff(np.concatenate([[True], _STOP[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[_LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    words = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Block(words, np.cumsum(_BREAK[data])[start], seeds[np.searchsorted(ends, start, side="right")])


def _blocks(batch: pa.RecordBatch, reach: int) -> Iterator[Block]:
    """The texts of a batch in blocks; one that goes on in the next repeats its last ``reach`` words."""
    held: list[bytes] = []
    seeds: list[int] = []
    size = 0
    known: dict[str, int] = {}

    def flush() -> Block:
        ends = np.cumsum([len(raw) + 1 for raw in held])
        return _block(b"\n".join(held), ends, np.array(seeds, dtype=np.uint64))

    for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
        if not text.is_valid:
            continue
        raw, seed = text.as_buffer().to_pybytes(), known.setdefault(lang, _seed(lang))
        if len(raw) <= BLOCK:
            if size + len(raw) > BLOCK:
                yield flush()
                held, seeds, size = [], [], 0
            held.append(raw)
            seeds.append(seed)
            size += len(raw) + 1
            continue
        last, at = None, 0
        while at < len(raw):
            stop = len(raw)
            for upto in range(at + BLOCK, len(raw), BLOCK):
                found = np.flatnonzero(_STOP[np.frombuffer(raw, dtype=np.uint8)[upto - BLOCK : upto]])
                if len(found):
                    stop = upto - BLOCK + int(found[-1]) + 1
                    break
            block = _block(raw[at:stop], np.array([stop - at + 1]), np.array([seed], dtype=np.uint64))
            breaks = int(_BREAK[np.frombuffer(raw, dtype=np.uint8)[at:stop]].sum())
            if last is not None:
                block.piece = block.piece + last[2]
                block = Block(*(np.concatenate([a, b]) for a, b in zip(last[:2], (block.words, block.piece), strict=True)), np.full(len(last[0]) + len(block.words), seed, dtype=np.uint64), len(last[0]))
            yield block
            before = 0 if last is None else last[2]
            keep = max(0, len(block.words) - reach)
            last, at = (block.words[keep:], block.piece[keep:], before + breaks), stop
    if held:
        yield flush()


def _grams(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase of ``k`` words from each word on, and whether one piece holds it."""
    gram = mix(block.words + block.seed, 1)
    inside = np.ones(len(gram), dtype=bool)
    for j in range(1, k):
        gram = mix(gram[:-1] + block.words[j:], j + 1) if len(gram) else gram
        inside = (block.piece[j:] == block.piece[: len(block.piece) - j]) if len(inside) else inside
    return gram, inside


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n); a null word counts all of them."""
    counts: dict[str, Counter[bytes]] = {}

    def flush(done: bool = False) -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, own in counts.items() for word, n in own.items()]
        counts.clear()
        langs, words, ns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            if text.is_valid:
                found = _TOKEN.findall(text.as_buffer().to_pybytes().lower())
                own = counts.setdefault(lang, Counter())
                own.update(found)
                own[None] += len(found)
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield flush()
    yield flush()


def _test(bits: np.ndarray, size: int, gram: np.ndarray) -> np.ndarray:
    place = gram >> np.uint64(64 - size)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _filter(phrases: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit for each hash of ``phrases``, and how many bits of a hash it goes by."""
    size = min(FILTER_BITS, max(19, (16 * max(count, 1)).bit_length()))

    def fold(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 13, dtype=np.uint8)
        place = table.column("bit").to_numpy() & 0xFFFF
        np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    bit = F.shiftrightunsigned("gram", 64 - size)
    parts = phrases.select(bit.alias("bit")).withColumn("part", F.shiftright("bit", 16)).groupBy("part").applyInArrow(fold, "part long, bits binary")
    bits = np.zeros(1 << (size - 3), dtype=np.uint8)
    for row in parts.collect():
        bits[row["part"] << 13 : (row["part"] + 1) << 13] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits, size


def _nominate(k: int, sent):
    """Rows (prefix, word, n): phrases of ``k`` words both of whose shorter phrases pass the filter."""

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = sent.value
        held: list[np.ndarray] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate(held, axis=1) if held else np.zeros((2, 0), dtype=np.uint64)
            pairs = pairs[:, np.lexsort(pairs[::-1])]
            new = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])[: pairs.shape[1]])
            times = np.diff(np.concatenate([new, [pairs.shape[1]]]))
            for a in range(0, len(new), 100_000):
                part = new[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[0, part].view(np.int64)), pa.array(pairs[1, part].view(np.int64)), pa.array(times[a : a + 100_000])], names=["prefix", "word", "n"]
                )

        for batch in batches:
            for block in _blocks(batch, k - 1):
                gram, inside = _grams(block, k - 1)
                fine = inside & _test(bits, size, gram)
                whole = np.flatnonzero(fine[:-1] & fine[1:] & (block.piece[k - 1 :] == block.piece[: len(block.piece) - k + 1])) if len(fine) > 1 else []
                if len(whole):
                    held.append(np.stack([gram[whole], block.words[whole + k - 1]]))
                    count += len(whole)
                if count > HELD_PAIRS:
                    yield from flush()
                    held, count = [], 0
        yield from flush()

    return nominate


def _hashed(k: int):
    """Adds the hash of a phrase, and of its first two words, from the words themselves."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, langs = batch.column("phrase").to_pylist(), batch.column("lang").to_pylist()
            raw = [p.encode("utf-8", "surrogatepass") for p in phrases]
            ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
            block = _block(b"\n".join(raw), ends, np.array([_seed(lang) for lang in langs], dtype=np.uint64))
            at = np.arange(len(phrases)) * k
            gram, head = _grams(block, k)[0], _grams(block, min(k, 2))[0]
            arrays = [*batch.columns, *(pa.array(x[at].view(np.int64)) for x in (gram, head, block.words[k - 1 :]))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "gram", "head", "last"])

    return hashed


def _tries(table: pa.Table) -> pa.Table:
    """The phrases of a group by their places in its trie, and the trie at place -1.

    A trie goes from a language to words; its symbols are places among sorted hashes.
    """
    table = table.select(["shard", "lang", "phrase", "k"]).sort_by([("lang", "ascending"), ("phrase", "ascending")])
    phrases = [p.encode("utf-8", "surrogatepass") for p in table.column("phrase").to_pylist()]
    seeds = np.array([_seed(lang) for lang in table.column("lang").to_pylist()], dtype=np.uint64)
    block = _block(b"\n".join(phrases), np.cumsum([len(p) + 1 for p in phrases], dtype=np.int64), seeds)
    sizes = np.array([p.count(b" ") + 1 for p in phrases])
    starts, langs = np.unique(block.words), np.unique(seeds)
    rows = np.full((len(phrases), 1 + sizes.max()), -1, dtype=np.int64)
    rows[:, 0] = np.searchsorted(langs, seeds)
    own = np.repeat(np.arange(len(phrases)), sizes)
    rows[own, 1 + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.searchsorted(starts, block.words)
    blob = pickle.dumps((DoubleArray(rows), starts, langs, len(phrases)), protocol=5)
    own = table.append_column("idx", pa.array(np.arange(len(phrases)))).append_column("blob", pa.nulls(len(phrases), pa.binary()))
    trie = pa.table({"shard": table.column("shard")[:1], "lang": [None], "phrase": [None], "k": [None], "idx": [-1], "blob": [blob]}, schema=own.schema)
    return pa.concat_tables([trie, own])


def _symbols(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash among the known ones, or -1."""
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, place, -1)


def _packed(shard: int, total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([some.astype("<i4").tobytes()], pa.binary()), pa.array([total[some].tobytes()], pa.binary())], names=["shard", "idx", "n"]
    )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The sum of packed counts of each shard; rows of one shard follow one another, one is held at a time."""
    shard, total = None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        for k, own in enumerate(batch.column("shard").to_pylist()):
            if own != shard:
                if shard is not None:
                    yield shard, total
                shard, total = own, np.zeros(0, dtype=np.int64)
            idx = np.frombuffer(batch.column("idx")[k].as_buffer(), dtype="<i4")
            if len(idx):
                if idx[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(idx[-1] + 1 - len(total), dtype=np.int64)])
                total[idx] += np.frombuffer(batch.column("n")[k].as_buffer(), dtype=np.int64)
    if shard is not None:
        yield shard, total


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, total in _sums(batches):
        yield _packed(shard, total)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, total in _sums(batches):
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, dtype=np.int32)), pa.array(some), pa.array(total[some])], names=["shard", "idx", "f"])


def _accept(shards: int, longest: int, sent):
    """Rows (shard, idx, n): phrases whose states of a trie accepted, and how often, as packed integers."""

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {shard: pickle.loads(blob) for shard, blob in sent.value}
        totals = {shard: np.zeros(trie[3], dtype=np.int64) for shard, trie in tries.items()}
        held: dict[int, list[np.ndarray]] = {shard: [] for shard in tries}
        count = 0

        def flush() -> None:
            for shard, own in held.items():
                if own:
                    totals[shard] += np.bincount(np.concatenate(own), minlength=len(totals[shard]))
                    own.clear()

        for batch in batches:
            for block in _blocks(batch, longest - 1):
                head, inside = _grams(block, 2)
                of = (head % np.uint64(shards)).astype(np.int64)
                for shard, (trie, starts, langs, _) in tries.items():
                    at = np.flatnonzero(inside & (of == shard))
                    state = trie.advance(np.zeros(len(at), dtype=np.int64), _symbols(langs, block.seed[at]))
                    for step in range(longest):
                        live = (state >= 0) & (at + step < len(block.words))
                        at, state = at[live], state[live]
                        live = block.piece[at + step] == block.piece[at]
                        at, state = at[live], state[live]
                        state = trie.advance(state, _symbols(starts, block.words[at + step]))
                        found = trie.accept[state[(state >= 0) & (at + step >= block.old)]]
                        held[shard].append(found[found >= 0])
                        count += len(held[shard][-1])
                if count > 2_000_000:
                    flush()
                    count = 0
        flush()
        for shard, total in totals.items():
            yield _packed(shard, total)

    return accept


def frequent_phrases(docs: DataFrame, longest: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows (``lang``, ``n``): all words of a language; and (``lang``, ``phrase``, ``k``, ``f``): every
    phrase of up to ``longest`` words that occurs at least ``min_count`` times, and how often.

    Words, pieces and odd rows are as in ``mine_phrases``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counts = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts.where((F.col("n") >= min_count) | F.col("word").isNull()), "words")
    totals = counts.where("word IS NULL").select("lang", "n")
    words = counts.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    hashes = "lang string, phrase string, gram long, head long, last long"
    singles = written(words.select("lang", "phrase").mapInArrow(_hashed(1), hashes), "singles")
    levels = [singles]
    last_words = singles.select("lang", "last", F.col("phrase").alias("ending"))
    for k in range(2, longest + 1):
        count = levels[-1].count()
        if not count:
            break
        sent = spark.sparkContext.broadcast(_filter(levels[-1], count))
        pairs = texts.mapInArrow(_nominate(k, sent), "prefix long, word long, n long")
        many = written(pairs.groupBy("prefix", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "pairs")
        sent.unpersist()
        prefixes = levels[-1].select("lang", "phrase", F.col("gram").alias("prefix"))
        spelled = many.join(prefixes, "prefix").join(last_words.withColumnRenamed("last", "word"), ["lang", "word"])
        phrases = spelled.select("lang", F.concat_ws(" ", "phrase", "ending").alias("phrase")).distinct()
        levels.append(written(phrases.mapInArrow(_hashed(k), hashes), "phrases"))
    longer = [level.select("lang", "phrase", "head", F.lit(k).alias("k")) for k, level in enumerate(levels[1:], 2)]
    found = words.withColumn("k", F.lit(1)).select("lang", "phrase", "k", "f")
    if not longer:
        return totals, found
    candidates = longer[0]
    for level in longer[1:]:
        candidates = candidates.unionAll(level)
    counted = _counted(texts, candidates, longest).where(F.col("f") >= min_count)
    return totals, written(found.unionAll(counted), "frequent")


def _counted(texts: DataFrame, candidates: DataFrame, longest: int) -> DataFrame:
    """The candidates with ``f``, their exact number of occurrences in ``texts``."""
    spark = texts.sparkSession
    shards = max(LEAST_TRIES, -(-candidates.count() // TRIE_PHRASES))
    unsigned = F.conv(F.hex("head"), 16, 10).cast("decimal(20,0)")
    placed = candidates.withColumn("shard", (unsigned % F.lit(shards).cast("decimal(20,0)")).cast("int"))
    tries = placed.groupBy("shard").applyInArrow(_tries, "shard int, lang string, phrase string, k int, idx long, blob binary")
    tries = written(tries, "tries")
    counts = None
    for first in range(0, shards, TRIES_SENT):
        rows = tries.where(f"idx = -1 AND shard >= {first} AND shard < {first + TRIES_SENT}").select("shard", "blob").collect()
        if rows:
            sent = spark.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in rows])
            own = texts.mapInArrow(_accept(shards, longest, sent), _COUNTS).withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(16)))
            # Counts of one task after the other are added up: in parts of a shard, then those.
            own = own.repartition(spread(spark), "shard", "salt").sortWithinPartitions("shard").select("shard", "idx", "n").mapInArrow(_add, _COUNTS)
            own = own.repartition(spread(spark), "shard").sortWithinPartitions("shard").mapInArrow(_unpack, "shard int, idx long, f long")
            own = written(own, "counts")
            sent.unpersist()
            counts = own if counts is None else counts.unionAll(own)
    phrases = tries.where("idx >= 0").drop("blob")
    if counts is None:
        return phrases.select("lang", "phrase", "k", F.lit(0).cast("long").alias("f"))
    return phrases.join(counts, ["shard", "idx"]).select("lang", "phrase", "k", "f")


def mine_phrases(docs: DataFrame, longest: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """Rows (``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): the ``top`` phrases of each
    language of 2 to ``longest`` words that occur at least ``min_count`` times.

    A-Z are lower-cased. Texts are cut at ``.,;:!?`` and 0x0A to 0x0D into pieces and these at spaces
    and tabs into words; a phrase lies within a piece. ``a`` counts its occurrences, ``l`` and ``r``
    those of its first words and of the rest, ``n`` all words of the language. ``score`` is
    floor(1000 * a * n / (l * r)) at the cut with the lowest score, of equal ones the first. A
    phrase that lies in a longer one that occurs as often is left out. Ranks are by score, ``a``
    (both falling) and phrase.

    * A null text has no words, a null language is ``und``. A repeated row counts again.
    * Texts of any length are worked on in blocks; other columns are not read.
    * An empty table, or no frequent phrase, gives no rows.
    """
    totals, found = frequent_phrases(docs, longest, min_count)
    phrases = found.where("k > 1").withColumn("words", F.split("phrase", " "))
    joined = lambda words: F.concat_ws(" ", words)
    # Only phrases one word longer matter: those between two that occur equally often do, too.
    shorter = phrases.where("k > 2").select(
        "lang", "f", F.explode(F.array(joined(F.slice("words", 1, F.col("k") - 1)), joined(F.slice("words", 2, F.col("k") - 1)))).alias("phrase")
    )
    covered = shorter.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR longer < f")
    cuts = kept.join(totals, "lang").select("lang", "phrase", "words", "k", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = {x: found.select("lang", F.col("phrase").alias(f"part_{x}"), F.col("f").alias(x)) for x in "lr"}
    cuts = cuts.withColumn("part_l", joined(F.slice("words", 1, F.col("cut")))).withColumn("part_r", joined(F.slice("words", F.col("cut") + 1, F.col("k"))))
    scored = cuts.join(parts["l"], ["lang", "part_l"]).join(parts["r"], ["lang", "part_r"])
    # Products may pass 64 bits.
    wide = {c: f"CAST({c} AS DECIMAL(18,0))" for c in ("a", "n", "l", "r")}
    scored = scored.withColumn("score", F.expr(f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Ranks within parts of a language first, so that no task sorts all phrases of one.
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread(docs.sparkSession)))
    few = best.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS k)),
found AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM found WHERE k > 1),
parts AS (
  SELECT lang, k, f, w, unnest(range(2, k)) AS size FROM phrases),
inner_parts AS (
  SELECT lang, f, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM parts)),
covered AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT p.* FROM phrases p LEFT JOIN covered c USING (lang, phrase) WHERE c.longer IS NULL OR 100 * c.longer < 100 * p.f),
cuts AS (
  SELECT *, array_to_string(w[1 : cut], ' ') AS part_l, array_to_string(w[cut + 1 : k], ' ') AS part_r FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, l.f AS l, r.f AS r, t.n,
         CAST(1000 * CAST(c.f AS HUGEINT) * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t USING (lang) JOIN found l ON l.lang = c.lang AND l.phrase = c.part_l JOIN found r ON r.lang = c.lang AND r.phrase = c.part_r),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
