"""Metrics, milestones, running bests and overfitting of training logs that are still written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tuneprep.functions.logs import is_milestone, log_step, loose_losses
from tuneprep.functions.text import strip
from tuneprep.operators.checkpoints import REBOUND_TOLERANCE, SMALLEST_MINIMUM, parse_log_lines

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(run_id, line) of the text files in a folder; a file's name is its run."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*\z", "")
    return reader.text(path).select(name.alias("run_id"), F.col("value").alias("line"))


def metric_stream(lines: DataFrame) -> DataFrame:
    """Progress lines with their metrics."""
    return parse_log_lines(lines)


def milestone_stream(lines: DataFrame) -> DataFrame:
    """Lines that report a validation loss, stripped."""
    return lines.where(is_milestone("line")).select("run_id", strip("line").alias("milestone"))


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_best(lines: DataFrame) -> DataFrame:
    """Lowest validation loss so far with its step, and lines seen; one state row per run."""
    losses = loose_losses("line")
    points = lines.select("run_id", log_step("line").alias("step"), losses["val"].alias("val_loss"))
    best = F.min(F.when(F.col("val_loss").isNotNull(), F.struct(F.col("val_loss").alias("loss"), F.col("step").alias("step"))))
    state = points.where(F.col("step").isNotNull()).groupBy("run_id").agg(best.alias("b"), F.count("val_loss").alias("n_val"))
    return state.select("run_id", F.col("b.loss").alias("best_val_loss"), F.col("b.step").alias("best_step"), "n_val")


def running_accuracy(scored: DataFrame) -> DataFrame:
    """Samples and correct answers so far per run."""
    return scored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("model_correct").cast("int")).alias("correct")
    )


@dataclass
class _Curve:
    """What is known of a run's settled points."""

    step: int | None = None
    previous: float | None = None
    low: float | None = None
    rose: bool = False
    stop_step: int | None = None
    stop_loss: float | None = None
    told: int | None = None
    late: int = 0

    def follow(self, points: Iterator[tuple[int, float]]) -> None:
        """Go on to the stop, or to the last point."""
        for step, loss in points:
            if self.stop_step is not None:
                return
            self.step = step
            if self.low is None or loss < self.low:
                self.low, self.rose = loss, False
            else:
                rises = loss > self.previous
                if (loss - self.low) / max(self.low, SMALLEST_MINIMUM) > REBOUND_TOLERANCE or (rises and self.rose):
                    self.stop_step, self.stop_loss = step, loss
                self.rose = rises
            self.previous = loss


class _RiseWatch(StatefulProcessor):
    """Follows a run's validation loss in the order of its steps.

    The state sums up the points that have settled: (last step, previous, minimum, rose, step and
    loss of the stop, told stop, points too late). With it are the points with the largest
    steps, ``wait`` of them at most, among which a late one still finds its place. It is one
    value, and rows are no frames, because most runs have few points in a batch: each access to
    the state is a message to the JVM.
    """

    def __init__(self, wait: int, idle_ms: int | None) -> None:
        self.wait, self.idle_ms = wait, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "run",
            "step long, previous double, low double, rose boolean, stop_step long, stop_loss double, told long, late long, "
            "steps array<long>, seqs array<long>, losses array<double>",
        )

    def _stored(self) -> tuple[_Curve, dict[int, tuple[int, float]]]:
        stored = self.state.get()
        if stored is None:
            return _Curve(), {}
        *curve, steps, seqs, losses = stored
        return _Curve(*curve), dict(zip(steps, zip(seqs, losses, strict=True), strict=True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        curve, points = self._stored()
        if curve.stop_step is not None:
            return
        late = curve.late
        for _, step, seq, loss in rows:
            if step is None or loss is None or loss != loss:
                continue
            if curve.step is not None and step <= curve.step:
                curve.late += 1
            elif step not in points or (seq or 0) >= points[step][0]:
                points[step] = (seq or 0, loss)
        ordered = sorted(points)
        settled = max(0, len(ordered) - self.wait)
        curve.follow((step, points[step][1]) for step in ordered[:settled])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._tell(key, curve, [(step, *points[step]) for step in ordered[settled:]], curve.late > late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A run that has been silent: all its points settle."""
        curve, points = self._stored()
        if curve.stop_step is None:
            curve.follow((step, loss) for step, (_, loss) in sorted(points.items()))
            yield from self._tell(key, curve, [], True)

    def _tell(self, key, curve: _Curve, waiting: list[tuple[int, int, float]], always: bool) -> Iterator[Row]:
        seen = replace(curve)
        seen.follow((step, loss) for step, _, loss in waiting)
        settled = curve.stop_step is not None or not waiting
        if always or seen.stop_step != curve.told or curve.stop_step is not None:
            yield Row(run_id=key[0], stop_step=seen.stop_step, val_loss=seen.stop_loss, settled=settled, late=curve.late)
        curve.told = seen.stop_step
        columns = zip(*waiting, strict=True) if waiting and curve.stop_step is None else ((), (), ())
        self.state.update((*astuple(curve), *map(list, columns)))

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def overfit_alerts(points: DataFrame, wait: int = 1000, idle_seconds: float | None = None) -> DataFrame:
    """(run_id, stop_step, val_loss, settled, late): the first step at which a run starts to
    overfit, whenever that answer changes; write it with ``keep_latest``.

    ``points`` is a stream of (run_id, step, val_loss) and optionally ``seq``: of equal steps the
    one with the largest ``seq`` counts, or the last to arrive. Points may come in any order of
    their steps: the ``wait`` points of a run with the largest steps wait, and later ones are put
    among them. The answer takes the waiting points into account. If a late point proves it
    wrong, it is corrected, or withdrawn with a null step. ``settled`` says that no late point can
    change it any more. A point at or before the last settled step is too late; ``late`` counts
    those of a run. A point without step or loss is left out.

    A run keeps ``wait`` points and eight values. With ``idle_seconds`` the points of a run that
    has been silent so long settle; timers do that, so such a query runs until it is stopped and
    not with ``available_now``. The query must be started in ``rocksdb_state``.
    """
    if "seq" not in points.columns:
        points = points.withColumn("seq", F.lit(0))
    points = points.select("run_id", F.col("step").cast("long").alias("step"), F.col("seq").cast("long").alias("seq"), F.col("val_loss").cast("double").alias("val_loss"))
    return points.groupBy("run_id").transformWithState(
        statefulProcessor=_RiseWatch(wait, None if idle_seconds is None else int(idle_seconds * 1000)),
        outputStructType="run_id string, stop_step long, val_loss double, settled boolean, late long",
        outputMode="Update",
        timeMode="None" if idle_seconds is None else "ProcessingTime",
    )
