"""Compaction of keyed micro-batch outputs.

An upsert table is a directory with one ``batch_id=<n>`` folder per micro-batch,
each holding the rows it changed; a key's newest row counts.  Left alone, a
reader reads every batch ever written.  ``compact`` folds them:

* ``snapshots/upto=<n>`` holds the current rows as of batch n.  Spark writes it
  through its commit protocol, and a ``_SUCCESS`` file marks it complete, so a
  compaction that dies leaves an unmarked folder that no reader looks at.  The
  same mark tells a complete micro-batch from one that is being written.
* A reader takes the newest marked snapshot and the batches after it: the one
  or the other for every batch, never both.  It reads one row per key and what
  has changed since.
* A micro-batch replayed after it was folded rewrites its folder, which is not
  read any more.
* Folders covered by the *previous* snapshot are removed, so a reader that
  listed the files before this compaction still finds them.

Micro-batches that only add rows (Silver) are folded into ``segments``
instead, each of the batches since the segment before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, SNAPSHOTS, SEGMENTS, UPTO, MARK = "batch_id", "snapshots", "segments", "upto", "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    """(file system, folder) of a path in any store that Spark can read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str, prefix: str, marked: bool = False) -> list[int]:
    """The n of the folders ``<prefix>=<n>`` under a path, rising; with ``marked``, of the complete ones."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{prefix}=") and \
                (not marked or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARK))):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


@dataclass(frozen=True)
class Layout:
    """What a reader reads: the newest snapshot (its batch; None without one) and the complete batches after it."""

    path: str
    upto: int | None
    batches: list[int]

    @property
    def snapshot(self) -> str | None:
        return None if self.upto is None else f"{self.path}/{SNAPSHOTS}/{UPTO}={self.upto}"


def layout(spark: SparkSession, path: str) -> Layout:
    marked = _numbers(spark, f"{path}/{SNAPSHOTS}", UPTO, marked=True)
    upto = marked[-1] if marked else None
    return Layout(path, upto, [n for n in _numbers(spark, path, BATCH, marked=True) if upto is None or n > upto])


def changes(spark: SparkSession, at: Layout) -> DataFrame | None:
    """The rows written since the snapshot, with their ``batch_id``; None if there are none."""
    if not at.batches:
        return None
    return (spark.read.option("basePath", at.path).parquet(*[f"{at.path}/{BATCH}={n}" for n in at.batches])
            .withColumn(BATCH, F.col(BATCH).cast("long")))


# ------------------------------------------------------------------ upserts (K7)
def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Per key the row of the newest micro-batch, from the snapshot and what came after it."""
    return _current(spark, layout(spark, path), keys)


def _current(spark: SparkSession, at: Layout, keys: list[str]) -> DataFrame:
    new = changes(spark, at)
    if at.snapshot is None:
        rows = _some(new, at)
    else:
        rows = spark.read.parquet(at.snapshot).withColumn(BATCH, F.lit(at.upto).cast("long"))
        rows = rows if new is None else rows.unionByName(new)
    values = [c for c in rows.columns if c not in keys and c != BATCH]
    newest = F.max(F.struct(BATCH, *values)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[f"newest.{c}" for c in values])


def _some(rows: DataFrame | None, at: Layout) -> DataFrame:
    if rows is None:
        raise FileNotFoundError(f"no complete micro-batch and no snapshot under {at.path}")
    return rows


def compact(spark: SparkSession, path: str, keys: list[str], least: int = 1) -> int | None:
    """Folds the complete batches since the last snapshot if there are ``least`` of them; the new snapshot's batch, or None.

    One compactor at a time; the stream may go on writing, as only batches that were complete when listed are folded.
    """
    at = layout(spark, path)
    if len(at.batches) < max(1, least):
        return None
    upto = at.batches[-1]
    _current(spark, at, keys).write.mode("overwrite").parquet(f"{path}/{SNAPSHOTS}/{UPTO}={upto}")
    if at.upto is not None:
        _forget(spark, path, at.upto)
        for n in _numbers(spark, f"{path}/{SNAPSHOTS}", UPTO):
            if n < at.upto:
                _remove(spark, f"{path}/{SNAPSHOTS}/{UPTO}={n}")
    return upto


def _forget(spark: SparkSession, path: str, upto: int) -> None:
    """Removes the batches that were folded before (a newer snapshot or segment is complete)."""
    for n in _numbers(spark, path, BATCH):
        if n <= upto:
            _remove(spark, f"{path}/{BATCH}={n}")


def _remove(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


# ------------------------------------------------------------------ appends
def appended_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of micro-batches that only add rows, from the segments and what came after them."""
    segments = _numbers(spark, f"{path}/{SEGMENTS}", UPTO, marked=True)
    at = Layout(path, None, _later(spark, path, segments))
    new = changes(spark, at)
    new = None if new is None else new.drop(BATCH)
    if not segments:
        return _some(new, at)
    old = None
    for n in segments:
        rows = spark.read.parquet(f"{path}/{SEGMENTS}/{UPTO}={n}")
        old = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    return old if new is None else old.unionByName(new, allowMissingColumns=True)


def _later(spark: SparkSession, path: str, segments: list[int]) -> list[int]:
    return [n for n in _numbers(spark, path, BATCH, marked=True) if not segments or n > segments[-1]]


def compact_appends(spark: SparkSession, path: str, partition: list[str], least: int = 1) -> int | None:
    """Folds the complete batches since the last segment into one segment of a few files per partition.

    Older segments are not written again, so the cost is that of the new rows.  The new segment's batch, or None.
    """
    segments = _numbers(spark, f"{path}/{SEGMENTS}", UPTO, marked=True)
    batches = _later(spark, path, segments)
    if len(batches) < max(1, least):
        return None
    upto = batches[-1]
    rows = changes(spark, Layout(path, None, batches)).drop(BATCH)
    if partition:
        rows = rows.hint("rebalance", *partition)
    rows.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/{SEGMENTS}/{UPTO}={upto}")
    if segments:
        _forget(spark, path, segments[-1])
    return upto
