"""Running values along an order, also when one key holds most of the rows.

A window over a key runs in one task. When some key has more than ``hot_rows`` rows, its
range is cut into pieces of about equal size, the window runs per piece, and what earlier
pieces contribute comes from one summary row per piece. Both ways give the same values. Cut
rows are written after each step, so a plan reads the input once and then one written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.session import scratch_dir

HOT_ROWS = 5_000_000
PIECES = 256


class OrderedRuns:
    """Rows of ``df`` per ``key`` in order of the numeric column ``order``.

    ``tie`` orders rows with the same ``order``. Such rows are never separated.
    """

    def __init__(
        self,
        df: DataFrame,
        key: str,
        order: str,
        tie: Sequence[str] = (),
        hot_rows: int = HOT_ROWS,
        pieces: int = PIECES,
    ):
        self.key, self.order, self.tie = key, order, list(tie)
        sizes = df.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
        self.chunked = not sizes.isEmpty()
        self.df = self._cut(df, sizes, pieces) if self.chunked else df

    def _cut(self, df: DataFrame, hot: DataFrame, pieces: int) -> DataFrame:
        marks = [i / pieces for i in range(1, pieces)]
        quantiles = F.percentile_approx(self.order, F.array(*[F.lit(m) for m in marks]), F.lit(20 * pieces))
        bounds = df.join(hot, self.key, "left_semi").groupBy(self.key).agg(quantiles.alias("__bounds"))
        cut = df.join(bounds, self.key, "left")
        below = F.size(F.filter("__bounds", lambda b: b < F.col(self.order)))
        return self._written(cut.withColumn("__piece", F.when(F.col("__bounds").isNull(), 0).otherwise(below)).drop("__bounds"))

    @staticmethod
    def _written(df: DataFrame) -> DataFrame:
        path = scratch_dir(df.sparkSession, "ordered")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @property
    def _scope(self) -> list[str]:
        return [self.key, "__piece"] if self.chunked else [self.key]

    def _window(self):
        return Window.partitionBy(*self._scope).orderBy(self.order, *self.tie)

    def _running(self, inside: dict[str, Column], summary: dict[str, Column], combine) -> "OrderedRuns":
        df = self.df.withColumns(inside)
        if self.chunked:
            pieces = self.df.groupBy(*self._scope).agg(*[c.alias(f"__{n}") for n, c in summary.items()])
            earlier = Window.partitionBy(self.key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
            carried = pieces.select(*self._scope, *[combine(F.col(f"__{n}")).over(earlier).alias(f"__{n}") for n in summary])
            df = self._written(df.join(carried, self._scope, "left"))
        self.df = df
        return self

    def min_before(self, name: str, value: str) -> "OrderedRuns":
        """Smallest earlier value; NULL on the first row."""
        rows = self._window().rowsBetween(Window.unboundedPreceding, -1)
        self._running({name: F.min(value).over(rows)}, {name: F.min(value)}, F.min)
        if self.chunked:
            self.df = self.df.withColumn(name, F.least(name, f"__{name}")).drop(f"__{name}")
        return self

    def previous(self, name: str, value: str) -> "OrderedRuns":
        """Value of the row before; NULL on the first row. ``value`` has no NULLs."""
        last = F.max_by(value, self._position())
        self._running({name: F.lag(value).over(self._window())}, {name: last}, lambda c: F.last(c, ignorenulls=True))
        if self.chunked:
            self.df = self.df.withColumn(name, F.coalesce(name, f"__{name}")).drop(f"__{name}")
        return self

    def last_known(self, name: str, value: str) -> "OrderedRuns":
        """The latest non-NULL value up to and including the row."""
        rows = self._window().rowsBetween(Window.unboundedPreceding, 0)
        known = F.max_by(value, F.when(F.col(value).isNotNull(), self._position()))
        inside = {name: F.last(value, ignorenulls=True).over(rows)}
        self._running(inside, {name: known}, lambda c: F.last(c, ignorenulls=True))
        if self.chunked:
            self.df = self.df.withColumn(name, F.coalesce(name, f"__{name}")).drop(f"__{name}")
        return self

    def _position(self) -> Column:
        return F.struct(self.order, *self.tie)

    def with_columns(self, columns: dict[str, Column]) -> "OrderedRuns":
        self.df = self.df.withColumns(columns)
        return self

    def of_key(self, values: dict[str, Column]) -> "OrderedRuns":
        """Columns with an aggregate over all rows of the key.

        They are window values over the partitioning that is there already; for a cut key
        they are added up per piece first.
        """
        if self.chunked:
            summary = self.df.groupBy(self.key).agg(*[v.alias(n) for n, v in values.items()])
            self.df = self._written(self.df.join(summary, self.key))
        else:
            window = Window.partitionBy(self.key)
            self.df = self.df.withColumns({n: v.over(window) for n, v in values.items()})
        return self

    def result(self) -> DataFrame:
        return self.df.drop("__piece")
