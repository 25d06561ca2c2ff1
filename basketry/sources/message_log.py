"""Offset-based streaming source over a message-log table.

The log is a parquet table by topic and partition whose offsets rise within a
partition (``write_log``).  ``spark.readStream.format("message_log")`` reads it
as a broker's consumer does: one Spark partition per topic partition, from the
group's committed offsets (else from the earliest), at most
``maxOffsetsPerTrigger`` new offsets a partition and micro-batch, and a commit
after a micro-batch has succeeded (``commit_processed``).

The stream's checkpoint decides what a query has processed: a restart from it
reads nothing twice and loses nothing.  The committed offsets are for a consumer
that starts without one, and for ``committed`` (lag monitoring).  Offsets may have gaps; a message
that arrives below an offset already read is an error of the log and is not seen.

Options: ``path``; ``group`` (default ``default``); ``topics`` (comma-separated,
default all); ``maxOffsetsPerTrigger`` (default none); ``startingOffsets``
``committed`` (default) or ``earliest``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "topic string, partition int, offset long, key string, value string, timestamp timestamp"
COMMITS = "_commits"
_COLUMNS = ["offset", "key", "value", "timestamp"]


def write_log(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Appends messages (topic, partition, offset, key, value, timestamp): a folder per topic partition, files sorted by offset."""
    (messages.select("topic", "partition", *_COLUMNS).repartition("topic", "partition")
     .sortWithinPartitions("topic", "partition", "offset").write.mode(mode).partitionBy("topic", "partition").parquet(path))


@dataclass
class Slice(InputPartition):
    """The messages of one topic partition from ``start`` (included) to ``end`` (excluded)."""

    topic: str
    partition: int
    start: int
    end: int


class MessageLog:
    """The log's files: what offsets each topic partition has, read from the files' footers, each of them once."""

    def __init__(self, path: str, topics: list[str] | None) -> None:
        if path.startswith("file:/") and not path.startswith("file://"):
            path = path.removeprefix("file:")
        self.store, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.topics = topics
        self.known: dict[str, tuple[str, int, int, int]] = {}       # file -> topic, partition, first and last offset

    def refresh(self) -> None:
        for info in self.store.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.base_name.endswith(".parquet") or info.path in self.known:
                continue
            parts = dict(p.split("=", 1) for p in info.path[len(self.root):].split("/") if "=" in p)
            if "topic" not in parts or (self.topics is not None and parts["topic"] not in self.topics):
                continue
            with self.store.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            column = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == "offset")
            stats = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
            if stats:
                self.known[info.path] = (parts["topic"], int(parts["partition"]), min(s.min for s in stats), max(s.max for s in stats))

    def ends(self) -> dict[str, int]:
        """The offset after the last one, by topic partition."""
        out: dict[str, int] = {}
        for topic, partition, _, last in self.known.values():
            name = f"{topic}/{partition}"
            out[name] = max(out.get(name, 0), last + 1)
        return out

    def messages(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """The slice's messages by offset; files without any of them are not opened."""
        self.refresh()
        files = sorted(p for p, (t, n, first, last) in self.known.items()
                       if t == part.topic and n == part.partition and first < part.end and last >= part.start)
        if not files:
            return
        at = ds.field("offset")
        data = ds.dataset(files, filesystem=self.store, format="parquet").scanner(
            columns=_COLUMNS, filter=(at >= part.start) & (at < part.end))
        for b in data.to_batches():
            if b.num_rows:
                n = b.num_rows
                stamp = b.column("timestamp").cast(pa.timestamp("us", tz="UTC"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.topic] * n), pa.array([part.partition] * n, pa.int32()), b.column("offset"),
                     b.column("key").cast(pa.string()), b.column("value").cast(pa.string()), stamp],
                    ["topic", "partition", *_COLUMNS])

    # -------------------------------------------------------------- commits
    def committed(self, group: str) -> dict[str, int]:
        path = f"{self.root}/{COMMITS}/{group}.json"
        if self.store.get_file_info(path).type != fs.FileType.File:
            return {}
        with self.store.open_input_stream(path) as f:
            return json.loads(f.read().decode())

    def commit(self, group: str, offsets: dict[str, int]) -> None:
        """Replaces the group's offsets in one move; they never go back."""
        now = {**self.committed(group)}
        now.update({k: max(v, now.get(k, 0)) for k, v in offsets.items()})
        self.store.create_dir(f"{self.root}/{COMMITS}", recursive=True)
        draft = f"{self.root}/{COMMITS}/.{group}-{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps(now, sort_keys=True).encode())
        self.store.move(draft, f"{self.root}/{COMMITS}/{group}.json")


class LogReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        topics = options.get("topics")
        self.path, self.topics = options["path"], [t.strip() for t in topics.split(",")] if topics else None
        self.group = options.get("group", "default")
        self.limit = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None
        self.earliest = options.get("startingOffsets", "committed") == "earliest"
        self.log = MessageLog(self.path, self.topics)
        self.at: dict[str, int] | None = None             # the end of the newest micro-batch that this reader knows of

    def initialOffset(self) -> dict:
        start = {} if self.earliest else self.log.committed(self.group)
        self.at = dict(start)
        return start

    def latestOffset(self) -> dict:
        self.log.refresh()
        ends = self.log.ends()
        if self.at is None:                                # restarted from a checkpoint: go on where the group is
            self.at = self.log.committed(self.group)
        if self.limit is not None:
            ends = {k: min(v, max(self.at.get(k, 0), self._first(k)) + self.limit) for k, v in ends.items()}
        self.at = {k: max(v, self.at.get(k, 0)) for k, v in {**self.at, **ends}.items()}
        return dict(self.at)

    def _first(self, name: str) -> int:
        """The first offset at or after where the reader is: gaps do not use up the limit."""
        at = (self.at or {}).get(name, 0)
        firsts = [max(first, at) for t, p, first, last in self.log.known.values() if f"{t}/{p}" == name and last >= at]
        return min(firsts, default=at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {k: max(v, (self.at or {}).get(k, 0)) for k, v in end.items()}
        out = []
        for name, upto in sorted(end.items()):
            topic, partition = name.rsplit("/", 1)
            if upto > start.get(name, 0):
                out.append(Slice(topic, int(partition), start.get(name, 0), upto))
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from MessageLog(self.path, self.topics).messages(partition)

    def commit(self, end: dict) -> None:
        self.log.commit(self.group, end)

    def stop(self) -> None:
        pass


class MessageLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_log(spark: SparkSession, path: str, group: str = "default", **options: str) -> DataFrame:
    """The log as a stream of messages for the consumers of ``group``."""
    spark.dataSource.register(MessageLogSource)
    return spark.readStream.format("message_log").options(path=path, group=group, **options).load()


def commit_processed(query: StreamingQuery, path: str, group: str = "default") -> None:
    """Commits what a query has processed so far, as its own progress says.

    Spark tells a source to commit a micro-batch when it plans the next one, so the last one before a
    consumer stops is committed here.
    """
    for progress in query.recentProgress:
        for source in json.loads(progress.json)["sources"]:
            if source["endOffset"]:
                MessageLog(path, None).commit(group, source["endOffset"])


def committed(path: str, group: str = "default") -> dict[str, int]:
    """The group's committed offsets: the next offset to read, by topic partition."""
    return MessageLog(path, None).committed(group)
