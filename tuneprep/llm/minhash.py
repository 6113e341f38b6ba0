"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join.

**Signatures.** Each document's set of word shingles is one class with all documents of the
same set. A class has ``SLOTS`` minima of which ``BITS`` bits are kept. Two sets of Jaccard
similarity s differ in a slot with probability 1 - s, so for the least similarity that counts,
``radius`` slots are exceeded with a probability below ``MISS``.

**Join.** The slots are cut into chunks so that, by the pigeonhole principle, two signatures
that differ in at most ``radius`` slots differ in at most one slot of some chunk. Every chunk
is indexed once for each slot that may be wrong, which the key leaves out. So the join returns
every pair within ``radius``; nothing is capped.

**Hot buckets.** What is asked for are connected classes, not pairs. First each bucket is
compared with one centre, which for a group of copies is the text that occurs most often: a
bucket of n classes gives n pairs. All buckets of one centre are then one group, in which only
classes outside the group's largest component may still have links to find. Those are cut
into blocks and compared with the group, which is cut into blocks as well: a task compares one
block with another, first by signatures, then, what is within the radius, by whole sets, and
returns a spanning forest of the links. No pairs are listed, and no task gets a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.llm.components import components
from tuneprep.llm.covertree import forest
from tuneprep.llm.stage import is_empty, written
from tuneprep.llm.words import mix, shingle_set, word_hashes

SLOTS = 64
BITS = 16
#: Accepted probability that a pair at the least similarity lies beyond the radius.
MISS = 1e-6
#: Classes outside the largest component, and classes of the group, that a task compares.
BLOCK, GROUP_BLOCK = 256, 1024
#: Parts of a group in the join with its totals.
SALTS = 16
#: Distinct shingles that are columns of a matrix at once.
COLUMNS = 4096
#: Bits of the map of classes that are in some bucket, and the most classes for which it is used.
FILTER_BITS, FILTER_MEMBERS = 1 << 24, 1 << 22
#: Shingles hashed at once for the minima of a long text.
PIECE = 1 << 12

_FACTORS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64), 5) | np.uint64(1)
_TERMS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64), 6)

SIGNED = "doc_id long, class_a long, class_b long, n long, sig binary"


def radius_for(percent: int, slots: int = SLOTS, miss: float = MISS) -> int:
    """Least number of differing slots that pairs of ``percent`` similarity exceed with a probability below ``miss``."""
    p, left = 1 - percent / 100, 1.0
    for d in range(slots + 1):
        left -= comb(slots, d) * p**d * (1 - p) ** (slots - d)
        if left < miss:
            return d
    return slots


def chunks_for(radius: int, slots: int = SLOTS) -> list[int]:
    """Borders of the chunks: so many that one of them has at most one of ``radius`` errors."""
    count = radius // 2 + 1
    return [round(k * slots / count) for k in range(count + 1)]


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), PIECE):
        part = shingles[k : k + PIECE]
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(64 - BITS)).astype("<u2")


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            class_a, class_b, n, sig = [], [], [], []
            for words in word_hashes(batch.column("text").to_pylist()):
                found = shingle_set(words, size)
                class_a.append(int(mix(found, 21).sum(dtype=np.uint64).astype(np.int64)))
                class_b.append(int(mix(found, 22).sum(dtype=np.uint64).astype(np.int64)))
                n.append(len(found))
                sig.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(class_a, pa.int64()), pa.array(class_b, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "class_a", "class_b", "n", "sig"],
            )

    return sign


def _indexer(borders: list[int]):
    """Rows (key, rep): a key for each chunk and each slot of it that may differ."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2").reshape(-1, SLOTS).astype(np.uint64)
            keys = []
            for c, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                for wrong in range(a, b):
                    key = np.full(len(sigs), c * SLOTS + wrong, dtype=np.uint64)
                    for slot in range(a, b):
                        if slot != wrong:
                            key = mix(key + sigs[:, slot], slot)
                    keys.append(key.view(np.int64))
            reps = np.tile(batch.column("rep").to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(reps)], names=["key", "rep"])

    return index


def _near(radius: int, percent: int):
    """Keeps pairs whose signatures are within the radius and whose sizes allow the similarity."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = ((one != two).sum(axis=1) <= radius) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return near


def _setter(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for k in range(0, batch.num_rows, 256):
                found = [shingle_set(w, size).tobytes() for w in word_hashes(texts.slice(k, 256).to_pylist())]
                yield pa.RecordBatch.from_arrays([ids.slice(k, 256), pa.array(found, pa.binary())], names=["rep", "shingles"])

    return sets


def _linker(percent: int):
    """Pairs with 100 * intersection >= percent * union, on whole sets."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return link


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(values)]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and tuple(values[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(values[a])
    if held:
        yield pa.Table.from_batches(held)


_BLOCK_KEYS = ["centre", "block", "part"]


def _flagger(radius: int, percent: int):
    """Of the rows of two blocks those that are within the radius of one of another component."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _BLOCK_KEYS):
            rep, comp, n, minor = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "minor"))
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(-1, SLOTS)
            left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
            centre = rep == table.column("centre")[0].as_py()
            hit = np.zeros(len(rep), dtype=bool)
            for k in range(0, len(left) if len(right) else 0, 16):
                one = left[k : k + 16]
                near = (sigs[one][:, None, :] != sigs[right][None, :, :]).sum(axis=2) <= radius
                near &= comp[one][:, None] != comp[right][None, :]
                near &= 100 * np.minimum(n[one][:, None], n[right]) >= percent * np.maximum(n[one][:, None], n[right])
                near &= ~(centre[one][:, None] | centre[right][None, :])
                hit[one] |= near.any(axis=1)
                hit[right] |= near.any(axis=0)
            yield from table.select([*_BLOCK_KEYS, "rep", "comp", "minor"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return flag


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set of one list with each of the other."""
    both = np.zeros((len(one), len(two)), dtype=np.float32)
    columns = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
    for k in range(0, len(columns), COLUMNS):
        part = columns[k : k + COLUMNS]
        sides = []
        for sets in (one, two):
            side = np.zeros((len(sets), len(part)), dtype=np.float32)
            for row, own in zip(side, sets, strict=True):
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                row[at[part[at] == own]] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both


def _block_linker(percent: int):
    """Links between two blocks, as a spanning forest."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, _BLOCK_KEYS):
            rep, comp, minor = (table.column(c).to_numpy() for c in ("rep", "comp", "minor"))
            sets = [np.frombuffer(raw, dtype=np.uint64) for raw in table.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
            if not (len(left) and len(right)):
                continue
            both = _overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
            similar = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
            x, y = np.nonzero(similar & (comp[left][:, None] != comp[right][None, :]))
            ends, roots = forest(left[x], right[y], len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep[ends]), pa.array(rep[roots])], names=["a", "b"])

    return link


def _sets(texts: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """Rows (rep, shingles) of at least the members; ids of ``texts`` do not repeat.

    Up to FILTER_MEMBERS of them a bit map of FILTER_BITS bits, in which each member's hash is
    set, reaches every task, and texts are not moved; a few others pass it, which does no harm.
    More members take a join.
    """
    schema = "rep long, shingles binary"
    members = written(members, "members")
    if members.count() > FILTER_MEMBERS:
        own = texts.join(members, F.col("doc_id") == F.col("rep"), "left_semi")
        return written(own.mapInArrow(_setter(size), schema), "sets")
    places = members.select((F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)) + 1).alias("place"))
    maps = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for row in maps.toLocalIterator():
        own = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little").astype(bool)
        bits[(row["bucket"] - 1) * len(own) :][: len(own)] = own
    packed, make = np.packbits(bits).tobytes(), _setter(size)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        yield from make(b.filter(pa.array(known[b.column("place").to_numpy()])) for b in batches)

    placed = texts.where("doc_id is not null").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    return written(placed.mapInArrow(passing, schema), "sets")


def _repeated(rows: DataFrame) -> DataFrame:
    """The ids of more than one row."""
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def _by_row(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, text_md5, n_shingles, component, component_id) where ids may repeat: each row has a number of its own.

    ``component`` tells groups apart, ``component_id`` is the least id of the group.
    """
    named = texts.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    named = written(named, "rows")
    found = near_duplicates(named.select(F.col("row").alias("doc_id"), "text"), size, percent)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component"))
    known = written(named.select("row", "doc_id", _text_md5(F.col("text")).alias("text_md5")).join(found, "row"), "row-components")
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "component")


def _text_md5(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (``doc_id``, ``n_shingles``, ``component_id``, ``kept``), one for each row of ``docs``.

    Documents are linked if 100 * |A & B| >= ``percent`` * |A | B|, A and B being their sets
    of distinct runs of ``size`` words; fewer words are one run. ``component_id`` is the least
    ``doc_id`` that links reach.

    * A null or blank text has an empty set and is linked with nothing.
    * A row whose ``doc_id`` is null is linked with nothing; its component is null and it is kept.
    * Rows that share a ``doc_id`` are documents of their own: equal texts are one set and get
      the same component, different texts are linked only as their sets are.
    * Other columns are not read. An empty table gives no rows.
    """
    radius = radius_for(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signer(size), SIGNED), "signed")
    if not is_empty(_repeated(signed)):
        nameless = signed.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        shared = _by_row(texts, size, percent).select("doc_id", "n_shingles", "component_id")
        return shared.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    usable = signed.where("n > 0 and doc_id is not null")
    classes = written(
        usable.groupBy("class_a", "class_b").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"), F.first("sig").alias("sig")
        ),
        "classes",
    )
    # A set of n is most similar to another one with one more; small sets are similar only if
    # they are equal, which the classes settle.
    several = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    keys = several.select("rep", "sig").mapInArrow(_indexer(chunks_for(radius)), "key long, rep long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    met = written(keys.join(shared, "key"), "met")
    centres = (
        met.join(classes.select("rep", "mult"), "rep")
        .groupBy("key")
        .agg(F.max(F.struct("mult", F.xxhash64("rep").alias("h"), "rep")).alias("top"))
        .select("key", F.col("top.rep").alias("centre"))
    )
    buckets = written(met.join(centres, "key").select("key", "rep", "centre"), "buckets")

    short = classes.select("rep", "n", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are within the radius and similar."""
        sided = pairs.join(short.toDF("a", "n_a", "sig_a"), "a").join(short.toDF("b", "n_b", "sig_b"), "b")
        near = sided.mapInArrow(_near(radius, percent), "a long, b long")
        near = written(near, "near")
        # Most classes that share a bucket are not within the radius, and need no set.
        sets = _sets(texts, near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), size)
        both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return both.mapInArrow(_linker(percent), "a long, b long")

    stars = buckets.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(confirmed(stars), "links")
    found = written(components(links, "a", "b"), "components")

    # Groups with classes of several components.
    of = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    everyone = buckets.select("centre", "rep").distinct().join(of, "rep", "left")
    everyone = written(everyone.select("centre", "rep", F.coalesce("comp", "rep").alias("comp")), "groups")
    main = (
        everyone.groupBy("centre", "comp")
        .agg(F.count(F.lit(1)).alias("many"))
        .groupBy("centre")
        .agg(F.max(F.struct("many", "comp")).alias("top"), F.sum("many").alias("all"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
        .select("centre", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.many")) / BLOCK).alias("blocks"), F.ceil(F.col("all") / GROUP_BLOCK).alias("parts"))
    )
    # A group may hold a large part of all rows, so the join is salted.
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = everyone.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(SALTS)).cast("int"))
    rows = written(salted.join(main, ["centre", "salt"]).drop("salt"), "apart")
    # Every block of the rest of a group meets every part of the group.
    minor = rows.where("comp != main").select(
        "centre", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "rep", "comp", F.lit(True).alias("minor")
    )
    other = rows.select(
        "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), "parts").alias("part"), "rep", "comp", F.lit(False).alias("minor")
    )
    blocks = minor.union(other).join(short, "rep").repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS)
    keys = "centre long, block long, part long, rep long, comp long, minor boolean"
    flagged = written(blocks.select(*_BLOCK_KEYS, "rep", "comp", "minor", "n", "sig").mapInArrow(_flagger(radius, percent), keys), "flagged")
    sets = _sets(texts, flagged.select("rep").distinct(), size)
    whole = flagged.join(sets, "rep").repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS)
    more = whole.select(*_BLOCK_KEYS, "rep", "comp", "minor", "shingles").mapInArrow(_block_linker(percent), "a long, b long")
    final = written(components(links.union(more), "a", "b"), "components")

    labels = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        "class_a", "class_b", F.coalesce("component", "rep").alias("component")
    )
    known = usable.join(labels, ["class_a", "class_b"]).select("doc_id", "n", "component")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return known.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with all columns: the one of the least ``doc_id``.

    * Rows whose ``doc_id`` is null are in no group and stay.
    * Of several rows with one ``doc_id`` and one text one stays, that whose columns are least
      as JSON. Different texts of one ``doc_id`` stay or go on their own.
    * Other columns may have any type; they are not compared unless ids repeat.
    """
    nameless = docs.where("doc_id is null")
    if is_empty(_repeated(docs)):
        found = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select("doc_id")
        return docs.join(found, "doc_id", "left_semi").unionByName(nameless)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = _by_row(texts, size, percent).groupBy("component").agg(F.min(F.struct("doc_id", "text_md5")).alias("first"))
    first = written(groups.select(F.col("first.doc_id").alias("id"), F.col("first.text_md5").alias("text_md5")).distinct(), "first")
    own = _text_md5(docs["text"].cast("string"))
    stay = docs.join(first, (docs["doc_id"] == first["id"]) & (own == first["text_md5"]), "left_semi")
    number = "number"
    while number in docs.columns:
        number += "_"
    columns = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    order = Window.partitionBy("doc_id", _text_md5(F.col("text").cast("string"))).orderBy(columns)
    stay = stay.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    return stay.unionByName(nameless)
