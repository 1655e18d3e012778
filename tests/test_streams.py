"""Streams of requests over several batches."""

import datetime

from lexispark.streaming import queue

SCHEMA = "request string, action string, ts timestamp"
NOON = datetime.datetime(2024, 1, 1, 12)


def batches(spark, path, parts):
    """A file per batch."""
    for i, part in enumerate(parts):
        rows = [(r, a, NOON + datetime.timedelta(minutes=m)) for r, a, m in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return queue.intake(spark, f"{path}/*", spark.createDataFrame([], SCHEMA).schema, files_at_once=1)


def told(spark, stream, path, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_overdue_requests_end_in_error(spark, tmp_path):
    parts = [
        [("late", "queue", 0), ("late", "start", 1), ("good", "queue", 0), ("good", "start", 2), ("kept", "queue", 0), ("gone", "queue", 0), ("alive", "queue", 0), ("alive", "start", 1)],
        [("alive", "progress", 25), ("good", "done", 20), ("gone", "cancel", 5), ("gone", "start", 6), ("late", "unknown", 3)],
        [("alive", "progress", 50), ("other", "queue", 100)],
        [("alive", "done", 70), ("late", "queue", 101), ("late", "start", 102)],
        [("other", "start", 110)],
    ]
    got = told(spark, queue.followed(batches(spark, tmp_path / "in", parts)), tmp_path, "followed")
    by = {}
    for r in got:
        by.setdefault(r["request"], []).append(((r["ts"] - NOON).total_seconds() / 60, r["state"], r["notice"], r["overdue"]))
    assert sorted(by["late"]) == [(1, "ACTIVE", "STARTED", False), (31, "ERROR", "FINISHED", True), (102, "ACTIVE", "STARTED", False)]
    assert sorted(by["good"]) == [(2, "ACTIVE", "STARTED", False), (20, "DONE", "FINISHED", False)]
    assert sorted(by["alive"]) == [(1, "ACTIVE", "STARTED", False), (25, "ACTIVE", "INPROGRESS", False), (50, "ACTIVE", "INPROGRESS", False), (70, "DONE", "FINISHED", False)]
    assert by["gone"] == [(5, "CANCELLED", "FINISHED", False)] and "kept" not in by and by["other"] == [(110, "ACTIVE", "STARTED", False)]


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    parts = [[("a", "queue", 0), ("b", "queue", 0)], [("a", "queue", 5), ("c", "queue", 6)], [("b", "queue", 7), ("d", "queue", 8)]]
    got = told(spark, queue.without_repeats(batches(spark, tmp_path / "in", parts), ["request"], "ts"), tmp_path, "repeats")
    assert sorted(r["request"] for r in got) == ["a", "b", "c", "d"]
