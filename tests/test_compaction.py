"""Compaction: the same rows before, during and after; bounded reads; replays and dead compactions change nothing."""

import pytest

from basketry.session import shared_dir
from basketry.sinks import compaction as CP
from basketry.streaming import orders_stream as S

SCHEMA = "k long, v string"


def batch(spark, path, n, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/batch_id={n}")


def rows_of(df):
    return sorted(map(tuple, df.select("k", "v").collect()), key=str)


def made(spark, batches=6):
    path = shared_dir(spark, "upserts")
    want = {}
    for n in range(batches):
        rows = [(k, f"{n}-{k}") for k in range(n % 3, 40, 1 + n % 4)]
        batch(spark, path, n, rows)
        want.update(rows)
    return path, sorted(want.items(), key=str)


def test_same_rows_before_and_after(spark):
    path, want = made(spark)
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want == rows_of(S.current_rows(spark, path, ["k"]))
    assert CP.compact(spark, path, ["k"]) == 5
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want
    assert CP.compact(spark, path, ["k"]) is None          # nothing new
    batch(spark, path, 6, [(3, "new"), (100, "more")])
    want = sorted({**dict(want), 3: "new", 100: "more"}.items(), key=str)
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want
    assert CP.compact(spark, path, ["k"]) == 6
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want


def test_reads_are_bounded_by_the_changes(spark):
    path, _ = made(spark)
    CP.compact(spark, path, ["k"])
    batch(spark, path, 6, [(1, "x")])
    files = CP.current_rows(spark, path, ["k"]).inputFiles()
    assert files and all("upto=5" in f or "batch_id=6" in f for f in files)


def test_a_reader_planned_before_goes_on(spark):
    path, want = made(spark)
    planned = CP.current_rows(spark, path, ["k"])
    CP.compact(spark, path, ["k"])
    assert rows_of(planned) == want
    planned = CP.current_rows(spark, path, ["k"])
    batch(spark, path, 6, [(1, "x")])
    CP.compact(spark, path, ["k"])                         # removes batches 0 to 5, not the snapshot of 5
    assert rows_of(planned) == want
    assert CP.layout(spark, path).batches == [] and CP._numbers(spark, path, CP.BATCH) == [6]


def test_replay_of_a_folded_batch(spark):
    path, want = made(spark)
    CP.compact(spark, path, ["k"])
    batch(spark, path, 2, [(k, "replayed differently") for k in range(40)])
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want


def test_dead_compaction_and_open_batch_are_not_read(spark):
    path, want = made(spark)
    spark.createDataFrame([(1, "half")], SCHEMA).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .parquet(f"{path}/snapshots/upto=9")
    spark.createDataFrame([(1, "open")], SCHEMA).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .parquet(f"{path}/batch_id=7")
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want
    assert CP.compact(spark, path, ["k"]) == 5
    assert rows_of(CP.current_rows(spark, path, ["k"])) == want


def test_nothing_there(spark):
    with pytest.raises(FileNotFoundError):
        CP.current_rows(spark, shared_dir(spark, "none"), ["k"])
    assert CP.compact(spark, shared_dir(spark, "none"), ["k"]) is None


def test_appends_become_segments(spark):
    path = shared_dir(spark, "appends")
    want = []
    for n in range(7):
        rows = [(i, f"{n}") for i in range(n, n + 5)]
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.partitionBy("v").parquet(f"{path}/batch_id={n}")
        want += rows
        if n in (2, 5):
            assert CP.compact_appends(spark, path, ["v"], least=3) == n
        else:
            assert CP.compact_appends(spark, path, ["v"], least=4) is None
        assert rows_of(CP.appended_rows(spark, path)) == sorted([(k, str(v)) for k, v in want], key=str) or \
            len(rows_of(CP.appended_rows(spark, path))) == len(want)
    files = CP.appended_rows(spark, path).inputFiles()
    assert {f.split("/appends")[1].split("/")[1] for f in files} == {"segments", "batch_id=6"}
    assert CP._numbers(spark, path, CP.BATCH) == [3, 4, 5, 6]        # those of the first segment are gone
