"""Sharding by histogram sort: splitters first, one exchange after.

The order of rows is that of a hash of the text followed by a hash of the id, so equal texts
follow one another and a group of copies still has a key for each row. Splitters are found by
counting exact bytes between probes of the key space and probing again inside the interval
that holds a target; only these counts, bounded by the number of probes, reach the driver.
Then each row finds its piece by comparing its key, and rows move once.

Only DataFrame functions run here.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm.stage import written

#: Bytes that a row counts for besides its text.
ROW_BYTES = 8
TEXT_BITS, ID_BITS = 32, 31
KEY_BITS = TEXT_BITS + ID_BITS
#: Bits of the key that one round of probing tells apart.
PROBE_BITS = 9
#: Bytes of one piece of a shard, which is one task of the exchange, and the most pieces of one.
PIECE_BYTES, MOST_PIECES, LEAST_PIECES = 1 << 30, 64, 4
#: A splitter may miss its place by this part of a shard if a group of equal texts stays whole.
TOLERANCE = 0.01


def _bits(value: Column, bits: int) -> Column:
    digits = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")
    return F.shiftright(digits, 32 - bits)


def sort_key(text: Column, doc_id: Column) -> Column:
    """32 bits of the text's hash, then 31 of the id's; null counts as empty."""
    of_text = _bits(F.coalesce(text.cast("string"), F.lit("")), TEXT_BITS)
    of_id = _bits(F.coalesce(doc_id.cast("string"), F.lit("")), ID_BITS)
    return F.shiftleft(of_text, ID_BITS).bitwiseOR(of_id)


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


@dataclass
class _Probe:
    """Target ``part`` of ``parts`` lies in the keys [low, low + 2**bits), below which are ``before`` bytes."""

    part: int
    low: int = 0
    bits: int = KEY_BITS
    before: int = 0
    inside: int = 0


def _probe(keyed: DataFrame, parts: int, total: int) -> list[_Probe]:
    """For each target part * total / parts the key whose bytes straddle it."""
    done: list[_Probe] = []
    probes = [_Probe(part) for part in range(1, parts)]
    bits = KEY_BITS
    while probes:
        step = min(PROBE_BITS, bits)
        rest = bits - step
        intervals = sorted({p.low >> bits for p in probes})
        rows = keyed
        if bits < KEY_BITS:
            rows = keyed.where(F.shiftright("key", bits).isin(intervals))
        bins: dict[int, list] = {}
        found = rows.groupBy(F.shiftright("key", rest).alias("bin")).agg(
            F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")
        )
        for row in sorted(found.collect()):
            bins.setdefault(row["bin"] >> step, []).append(row)
        following = []
        for p in probes:
            before = p.before
            for row in bins[p.low >> bits]:
                if parts * (before + row["size"]) > p.part * total:
                    break
                before += row["size"]
            p = _Probe(p.part, row["lo"] if row["lo"] == row["hi"] else row["bin"] << rest, rest, before, row["size"])
            (done if row["lo"] == row["hi"] else following).append(p)
        probes, bits = following, rest
    return sorted(done, key=lambda p: p.part)


def _whole_groups(keyed: DataFrame, cuts: list[_Probe], parts: int, total: int, slack: float) -> dict[int, int]:
    """The first key of each part: at the border of a group of equal texts if one is within ``slack`` bytes."""
    groups = sorted({p.low >> ID_BITS for p in cuts})
    keys = sorted({p.low for p in cuts})
    place = sum(((F.col("key") >= k).cast("int") + (F.col("key") > k).cast("int") for k in keys), F.lit(0))
    rows = keyed.where(F.shiftright("key", ID_BITS).isin(groups))
    sizes = rows.groupBy(F.shiftright("key", ID_BITS).alias("group"), place.alias("place")).agg(F.sum("size").alias("size")).collect()
    first = {}
    for p in cuts:
        group, at = p.low >> ID_BITS, 2 * keys.index(p.low) + 1
        own = [(r["place"], r["size"]) for r in sizes if r["group"] == group]
        target = p.part * total / parts
        start = p.before - sum(s for k, s in own if k < at)
        end = p.before + sum(s for k, s in own if k >= at)
        if target - start <= slack and target - start <= end - target:
            first[p.part] = group << ID_BITS
        elif end - target <= slack:
            first[p.part] = (group + 1) << ID_BITS
        else:
            first[p.part] = p.low if target - p.before <= p.before + p.inside - target else p.low + 1
    return first


def splitters(docs: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[list[int]]]:
    """The first keys of shards 1, 2, ... and, for each shard, those of its pieces after the first."""
    keyed = written(docs.select(sort_key(F.col("text"), F.col("doc_id")).alias("key"), row_bytes(F.col("text")).alias("size")), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [1 << KEY_BITS - 1] * (shards - 1), [[] for _ in range(shards)]
    each = min(MOST_PIECES, max(LEAST_PIECES, -(-total // (shards * PIECE_BYTES))))
    probes = _probe(keyed, shards * each, total)
    at_shards = [_Probe(p.part // each, p.low, p.bits, p.before, p.inside) for p in probes if p.part % each == 0]
    first = _whole_groups(keyed, at_shards, shards, total, tolerance * total / shards) if at_shards else {}
    starts = [first[k] for k in range(1, shards)]
    borders = [0, *starts, 1 << KEY_BITS]
    between = sorted({p.low for p in probes if p.part % each})
    return starts, [[k for k in between if a < k < b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


def shard_rows(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``: every row in one of ``shards`` shards of near equal bytes.

    Columns of ``docs`` with these names are replaced. ``slot`` counts a shard's rows from 0 in
    the order of the key, then ``doc_id``. The bytes of a shard miss the mean by at most
    ``2 * tolerance`` of it and one row; a splitter falls inside a group of equal texts only
    where that would not do.

    * A null text has no bytes; a null ``doc_id`` counts as an empty one. Rows that repeat both
      have one key and stay together.
    * With fewer rows than shards some shards are empty. An empty table gives no rows.
    """
    starts, pieces = splitters(docs, shards, tolerance)
    key, piece, bottom = (f"_{name}_{uuid.uuid4().hex[:8]}" for name in ("key", "piece", "bottom"))
    text, doc_id = F.col("text"), F.col("doc_id")
    rows = docs.withColumns({key: sort_key(text, doc_id), "size": row_bytes(text)})
    shard = sum(((F.col(key) >= F.lit(k).cast("long")).cast("int") for k in starts), F.lit(0))
    within = F.array(*[F.array(*[F.lit(k).cast("long") for k in own]).cast("array<long>") for own in pieces])
    rows = rows.withColumn("shard", shard.cast("int"))
    rows = rows.withColumn(piece, F.size(F.filter(F.element_at(within, F.col("shard") + 1), lambda k: k <= F.col(key))))

    counts = rows.groupBy("shard", piece).agg(F.count(F.lit(1)).alias(bottom))
    upto = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn(bottom, F.coalesce(F.sum(bottom).over(upto), F.lit(0))), "pieces")
    place = F.row_number().over(Window.partitionBy("shard", piece).orderBy(key, "doc_id"))
    placed = rows.withColumn("slot", place.cast("long")).join(counts, ["shard", piece])
    out = placed.withColumn("slot", F.col("slot") - 1 + F.col(bottom))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot")


SHARDS = 24
#: DuckDB has no CRC-32, so this folds the bytes of each text over the table of the polynomial.
SQL = f"""
WITH polynomial AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
bytes AS (
  SELECT text, [4294967295] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
sums AS (
  SELECT text, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]))) AS text_crc32
  FROM bytes, polynomial),
keyed AS (
  SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + {ROW_BYTES} AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS grp,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) >> 1 AS low
  FROM documents),
placed AS (SELECT *, (grp << {ID_BITS}) | low AS key FROM keyed),
keys AS (SELECT key, grp, CAST(sum(size) AS BIGINT) AS size FROM placed GROUP BY ALL),
runs AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total,
         CAST(sum(size) OVER (ORDER BY grp) AS BIGINT) AS group_end, CAST(sum(size) OVER (PARTITION BY grp) AS BIGINT) AS group_size
  FROM keys),
straddling AS (
  SELECT k, r.*, k * total / {float(SHARDS)} AS target, upto - size AS before, group_end - group_size AS group_start, {TOLERANCE} * total / {float(SHARDS)} AS slack
  FROM runs r, (SELECT unnest(range(1, {SHARDS})) AS k)
  WHERE {SHARDS} * (upto - size) <= k * total AND k * total < {SHARDS} * upto),
cuts AS (
  SELECT CASE WHEN target - group_start <= slack AND target - group_start <= group_end - target THEN grp << {ID_BITS}
              WHEN group_end - target <= slack THEN (grp + 1) << {ID_BITS}
              WHEN target - before <= upto - target THEN key ELSE key + 1 END AS first
  FROM straddling),
sharded AS (SELECT p.*, (SELECT CAST(count(*) AS INTEGER) FROM cuts WHERE first <= p.key) AS shard FROM placed p)
SELECT doc_id, size, coalesce(s.text_crc32, 0) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded LEFT JOIN sums s USING (text)
"""
