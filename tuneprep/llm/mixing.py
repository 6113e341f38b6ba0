"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Only DataFrame functions run here. What is computed per source is one row per source; a
document is decided on by comparing its hash with its source's cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm.stage import written
from tuneprep.llm.words import WORD

#: Bits of the hash by which a source's words are counted before its cut is searched.
BIN_BITS = 12
_HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, *columns: Column) -> Column:
    """A hash of 60 bits: the place of a row in the order in which its source is drawn."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))
    return F.conv(F.substring(digest, 1, _HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets for rows (``source``, ``source_size``): adds ``target``.

    Sources in the order of their names, null last, have ``weights`` in turn and share
    ``share`` times all sizes by weight. None exceeds ``most`` times its size; what it cannot
    take is shared by weight among the others, again and again. Where that ends, every source
    has the lesser of its cap and its weight times one level. Sorted by the level at which
    they reach their caps, the full sources come first, and the level follows from the caps
    before and the weights from a source on.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    rows = sources.withColumns({"weight": weight, "place": F.row_number().over(named)})
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * float(share)
    rows = rows.withColumn("level", (total - full_before) / open_weight).withColumn("nth", F.row_number().over(filling))
    below = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nth", "level"))
    rows = rows.withColumn("level", F.min(below).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap")
    return rows.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, seed: int, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: its target, how often all of it is taken, and where the rest ends.

    ``docs`` has ``source``, ``size`` and ``place``. Documents whose place is below ``cut`` are
    taken once more; those at ``cut`` with the fraction ``part`` of their words.
    """
    narrow = written(docs.select("source", "size", "place"), "mix-sizes")
    binned = narrow.withColumn("bin", F.shiftright("place", _HASH_BITS - BIN_BITS))
    # Sizes by bin are added up before they meet, so no source is one task's work.
    bins = written(binned.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    sources = water_fill(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(epochs).cast("long"))
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = written(sources, "mix-targets")

    order = Window.partitionBy("source").orderBy("bin")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = sources.select(F.col("source").alias("of"), "extra")
    cut_bin = (
        bins.withColumn("upto", run)
        .join(own, F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("upto") - F.col("size") < F.col("extra")) & (F.col("upto") >= F.col("extra")))
        .select("of", F.col("bin").alias("cut_bin"), (F.col("extra") - F.col("upto") + F.col("size")).alias("left"))
    )
    cut_bin = written(cut_bin, "mix-cuts")
    inside = binned.join(cut_bin, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("cut_bin")))
    places = inside.groupBy("of", "place").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    run = F.sum("size").over(Window.partitionBy("of").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    cuts = (
        places.withColumn("upto", run)
        .where((F.col("upto") - F.col("size") < F.col("left")) & (F.col("upto") >= F.col("left")))
        .select("of", F.col("place").alias("cut"), ((F.col("left") - F.col("upto") + F.col("size")) / F.col("size")).alias("part"))
    )
    joined = sources.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    return written(joined.select(F.col("source").alias("mix_source"), "source_size", "target", "whole", "cut", "part"), "mix-plan")


def mix_sources(
    docs: DataFrame, seed: int = 17, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Rows (``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``), one for each row of ``docs``.

    ``size`` counts the words of the text, ``target`` the words the mix wants of the source,
    ``taken`` those it takes of this row: whole repetitions, and for a seeded draw of the
    source's documents one more. The document at which the target is reached is taken in part.
    ``copies`` is the number of whole repetitions, that part counting from a half on.

    * A null source is a source, the last one. A null or blank text has no words.
    * Rows that repeat ``doc_id`` and text are drawn together.
    * A source without words has the target 0; an empty table gives no rows.
    """
    size, place = word_count(F.col("text")), draw(seed, F.col("doc_id").cast("string"), F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), place.alias("place"))
    return _taken(rows, plan(rows, seed, weights, share, most)).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies"
    )


def _taken(rows: DataFrame, mix: DataFrame) -> DataFrame:
    drawn, cut = F.col("place") < F.col("cut"), F.col("place") == F.col("cut")
    more = F.when(drawn, F.col("size")).when(cut, F.floor(F.col("size") * F.col("part"))).otherwise(F.lit(0))
    again = F.when(drawn | (cut & (F.col("part") >= 0.5)), 1).otherwise(0)
    joined = rows.join(mix, F.col("source").eqNullSafe(F.col("mix_source")))
    return joined.withColumns({"taken": (F.col("whole") * F.col("size") + more).cast("long"), "copies": F.col("whole") + again})


def mixed_documents(
    docs: DataFrame, seed: int = 17, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken whole, with its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size, place = word_count(F.col("text")), draw(seed, F.col("doc_id").cast("string"), F.col("text"))
    rows = docs.select(F.col("source"), size.alias("size"), place.alias("place"), row.alias("row"))
    taken = _taken(rows, plan(rows, seed, weights, share, most))
    repeated = taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("nth"))
    return repeated.select("row.*")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         CAST('0x' || substr(md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS place
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM named),
leveled AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS BIGINT) FROM named) * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW f AS (ORDER BY cap / weight, nth)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM leveled WHERE level * weight < cap ORDER BY cap / weight, nth LIMIT 1)), cap) AS target
  FROM leveled),
shares AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM targets),
extras AS (SELECT *, target - whole * source_size AS extra FROM shares),
places AS (SELECT source, place, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY source, place),
runs AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place) AS BIGINT) AS upto FROM places),
cuts AS (
  SELECT r.source, r.place AS cut, (e.extra - r.upto + r.size) / r.size AS part
  FROM runs r JOIN extras e ON r.source IS NOT DISTINCT FROM e.source
  WHERE r.upto - r.size < e.extra AND r.upto >= e.extra)
SELECT s.doc_id, s.size, e.source_size, e.target,
       CAST(e.whole * s.size + CASE WHEN s.place < c.cut THEN s.size WHEN s.place = c.cut THEN floor(s.size * c.part) ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN extras e ON s.source IS NOT DISTINCT FROM e.source
LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
