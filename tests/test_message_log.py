"""The offset-based log source: commits, restarts, limits, gaps."""

import datetime as dt

import pytest

from basketry.session import shared_dir
from basketry.sources import message_log as LOG
from basketry.streaming import orders_stream as S

MESSAGE = "topic string, partition int, offset long, key string, value string, timestamp timestamp"
T0 = dt.datetime(2024, 5, 1)


def messages(topic, partition, offsets):
    return [(topic, partition, o, f"k{o}", None if o % 10 == 9 else f"{topic}-{partition}-{o}", T0 + dt.timedelta(seconds=o)) for o in offsets]


def append(spark, path, rows):
    LOG.write_log(spark.createDataFrame(rows, MESSAGE), path)


def run(spark, path, out, ck, **options):
    q = S.to_parquet(LOG.read_log(spark, path, **options), out, ck, available_now=False, interval="0 seconds")
    try:
        q.processAllAvailable()
        LOG.commit_processed(q, path, options.get("group", "default"))
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def seen(spark, out):
    return sorted(map(tuple, spark.read.parquet(out).select(*MESSAGE.replace(",", "").split()[::2]).collect()), key=str)


def test_restarts_lose_and_repeat_nothing(spark):
    path, out, ck = (shared_dir(spark, n) for n in ("log", "out", "ck"))
    rows = messages("a", 0, range(30)) + messages("a", 1, range(100, 140, 2)) + messages("b", 0, range(5))
    append(spark, path, rows)
    run(spark, path, out, ck, group="g")
    assert seen(spark, out) == sorted(rows, key=str)
    assert LOG.committed(path, "g") == {"a/0": 30, "a/1": 139, "b/0": 5}
    more = messages("a", 0, range(30, 45)) + messages("c", 2, [7])
    append(spark, path, more)
    run(spark, path, out, ck, group="g")
    run(spark, path, out, ck, group="g")
    assert seen(spark, out) == sorted(rows + more, key=str)
    assert LOG.committed(path, "g") == {"a/0": 45, "a/1": 139, "b/0": 5, "c/2": 8}


def test_a_new_consumer_starts_where_its_group_is(spark):
    path = shared_dir(spark, "log")
    append(spark, path, messages("a", 0, range(20)))
    run(spark, path, shared_dir(spark, "out"), shared_dir(spark, "ck"), group="g")
    append(spark, path, messages("a", 0, range(20, 25)))
    out = shared_dir(spark, "out")
    run(spark, path, out, shared_dir(spark, "ck"), group="g")
    assert [r[2] for r in seen(spark, out)] == list(range(20, 25))
    for options in ({"group": "other"}, {"group": "g", "startingOffsets": "earliest"}):
        out = shared_dir(spark, "out")
        run(spark, path, out, shared_dir(spark, "ck"), **options)
        assert len(seen(spark, out)) == 25


def test_rate_limit_and_topics(spark):
    path, out, ck = (shared_dir(spark, n) for n in ("log", "out", "ck"))
    append(spark, path, messages("a", 0, range(0, 95)) + messages("b", 0, range(10)) + messages("a", 3, [1_000_000, 1_000_001]))
    batches = run(spark, path, out, ck, topics="a", maxOffsetsPerTrigger="40")
    assert sum(batches) == 97 and max(batches) <= 42
    assert {r[0] for r in seen(spark, out)} == {"a"} and len(seen(spark, out)) == 97


def test_only_files_of_the_slice_are_opened(spark):
    path = shared_dir(spark, "log")
    append(spark, path, messages("a", 0, range(10)))
    append(spark, path, messages("a", 0, range(10, 20)))
    log = LOG.MessageLog(path, None)
    log.refresh()
    assert sorted(v[2:] for v in log.known.values()) == [(0, 9), (10, 19)]
    got = [o for b in log.messages(LOG.Slice("a", 0, 12, 15)) for o in b.column("offset").to_pylist()]
    assert got == [12, 13, 14]
    assert list(log.messages(LOG.Slice("a", 0, 50, 60))) == []


def test_commits_never_go_back(spark):
    path = shared_dir(spark, "log")
    append(spark, path, messages("a", 0, range(3)))
    log = LOG.MessageLog(path, None)
    log.commit("g", {"a/0": 3})
    log.commit("g", {"a/0": 1, "b/0": 2})
    assert log.committed("g") == {"a/0": 3, "b/0": 2} and log.committed("nobody") == {}


@pytest.mark.parametrize("start", ["committed", "earliest"])
def test_empty_log(spark, start):
    path = shared_dir(spark, "log")
    append(spark, path, [])
    log = LOG.LogReader({"path": path, "startingOffsets": start})
    assert log.initialOffset() == {} and log.latestOffset() == {} and log.partitions({}, {}) == []
