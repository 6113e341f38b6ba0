"""Folders that appear when they are complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Store:
    """The store of a path, as Spark's writers see it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def empty(self, path: str) -> bool:
        return not self._fs.listStatus(self._path(path))

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"'{source}' could not be renamed to '{target}'")

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def size(self, path: str) -> tuple[int, int]:
        """(files, bytes) below a folder."""
        summary = self._fs.getContentSummary(self._path(path))
        return summary.getFileCount(), summary.getLength()


@contextmanager
def published(spark: SparkSession, path: str, mark: str) -> Iterator[str]:
    """A folder to write to, which takes the place of ``path`` when the block ends well.

    The block must leave ``mark`` in it. If it fails, ``path`` stays as it was. A ``path`` that
    holds anything but has no ``mark`` was not made this way: it is refused before any work.
    """
    path = path.rstrip("/")
    store = Store(spark, path)
    there = store.exists(path)
    if there and not store.exists(f"{path}/{mark}") and not store.empty(path):
        raise FileExistsError(f"'{path}' holds other files; choose a new or an empty folder")
    run = uuid.uuid4().hex[:12]
    parent, _, name = path.rpartition("/")
    # Hidden, so that nobody who reads the folder above takes them for data.
    staged, old = (f"{parent}/.{name}.{kind}-{run}" if parent or path.startswith("/") else f".{name}.{kind}-{run}" for kind in ("new", "old"))
    try:
        yield staged
        if not store.exists(f"{staged}/{mark}"):
            raise RuntimeError(f"'{path}' is not complete: there is no {mark}")
    except BaseException:
        store.drop(staged)
        raise
    if there:
        store.move(path, old)
    try:
        store.move(staged, path)
    except BaseException:
        if there:
            store.move(old, path)
        raise
    if there:
        store.drop(old)
