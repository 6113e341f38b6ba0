"""Records of streaming queries, added up over all their batches and restarts.

A listener takes the observed counts of every finished batch to ``<path>/<query id>``: a file for
each batch, named by its number, and one file with the sum of those before. A batch that runs
again after a restart has its old number, so it counts once.
"""

from __future__ import annotations

import json
import threading

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tuneprep.sources.files import filesystem

#: Batches that have a file of their own before they are added up.
FILES = 50


class RecordCounts(StreamingQueryListener):
    """Adds up the metric ``records`` that queries observe under ``name``."""

    def __init__(self, path: str, name: str = "rows") -> None:
        self.path, self.name = path, name
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self._add(str(event.progress.id), event.progress.batchId, int(row["records"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def _folder(self, query_id: str) -> tuple[pafs.FileSystem, str]:
        fs, inner = filesystem(f"{self.path}/{query_id}")
        fs.create_dir(inner, recursive=True)
        return fs, inner

    def _state(self, fs: pafs.FileSystem, inner: str) -> tuple[int, int, dict[int, int]]:
        """(last batch added up, their sum, records of each later batch)."""
        upto, total, later = -1, 0, {}
        for info in fs.get_file_info(pafs.FileSelector(inner)):
            kind, _, number = info.base_name.removesuffix(".json").partition("-")
            if kind in ("sum", "batch"):
                with fs.open_input_stream(info.path) as f:
                    records = json.loads(f.read())
                if kind == "batch":
                    later[int(number)] = records
                elif int(number) > upto:
                    upto, total = int(number), records
        return upto, total, {n: r for n, r in later.items() if n > upto}

    @staticmethod
    def _write(fs: pafs.FileSystem, path: str, records: int) -> None:
        # Written aside and renamed, so that no half file is ever read.
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(records).encode())
        fs.move(f"{path}.new", path)

    def _add(self, query_id: str, batch: int, records: int) -> None:
        fs, inner = self._folder(query_id)
        upto, total, later = self._state(fs, inner)
        if batch <= upto:
            return
        self._write(fs, f"{inner}/batch-{batch}.json", records)
        later[batch] = records
        if len(later) > FILES:
            # The newest may run again after a restart, so it stays apart.
            done = sorted(later)[:-1]
            self._write(fs, f"{inner}/sum-{done[-1]}.json", total + sum(later[n] for n in done))
            for n in done:
                fs.delete_file(f"{inner}/batch-{n}.json")
            if upto >= 0:
                fs.delete_file(f"{inner}/sum-{upto}.json")

    def total(self, query: StreamingQuery, timeout: float = 60.0) -> int:
        """Records of all batches of the query so far, those before a restart included.

        If the query has ended, its last events are waited for.
        """
        if not query.isActive and not self._end(str(query.runId)).wait(timeout):
            raise TimeoutError(f"the events of query {query.runId} have not arrived within {timeout} seconds")
        fs, inner = self._folder(str(query.id))
        _, total, later = self._state(fs, inner)
        return total + sum(later.values())


def count_records(spark: SparkSession, path: str, name: str = "rows") -> RecordCounts:
    """A listener, added to the session, that keeps its counts in ``path``. Add it before the query
    starts; ``spark.streams.removeListener`` takes it out again."""
    counts = RecordCounts(path, name)
    spark.streams.addListener(counts)
    return counts
