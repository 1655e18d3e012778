"""The work queue as a stream of files with requests; each function takes batch and streaming frames alike where it can."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType


def intake(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Requests from a folder of parquet files, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Requests whose key has not been queued within the time that late ones may come in."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per time window and kind (an extra; the catalogue itself has no time windows)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_requests(events: DataFrame) -> DataFrame:
    """The first request of each user and kind."""
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


def states(events: DataFrame) -> DataFrame:
    """The last state of each user, and how many errors there were."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("event_type") == "error").alias("errors"))


def run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply work to every batch and append its rows to out; a batch that is run again replaces its own part, so no row comes twice."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: What an action makes of a request's state; an action that a state doesn't know changes nothing. Only what waits can be cancelled.
TRANSITIONS = {
    ("", "queue"): "QUEUED", ("QUEUED", "start"): "ACTIVE", ("ACTIVE", "done"): "DONE", ("ACTIVE", "error"): "ERROR", ("QUEUED", "cancel"): "CANCELLED",
    ("DONE", "queue"): "QUEUED", ("ERROR", "queue"): "QUEUED", ("CANCELLED", "queue"): "QUEUED",
}


def tracked_all(commands: DataFrame, order: list[str]) -> DataFrame:
    """(request, state, changes) after all commands(request, action, ...) in order; a request's commands are its own history only."""
    known = F.create_map(*[F.lit(x) for (state, action), to in TRANSITIONS.items() for x in (f"{state}:{action}", to)])
    history = F.transform(F.sort_array(F.collect_list(F.struct(*order, "action"))), lambda x: x["action"])

    def step(s, action):
        to = F.try_element_at(known, F.concat(s["state"], F.lit(":"), action))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["changes"] + F.when(to.isNull(), 0).otherwise(1)).alias("changes"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("changes"))
    return commands.groupBy("request").agg(history.alias("h")).select("request", F.aggregate("h", start, step).alias("s")).select("request", "s.*")


def tracked(commands: DataFrame) -> DataFrame:
    """The same over a stream of commands(request, action, ts): a row for each request that a batch has changed. The state is kept per
    request, so cancelling and repeating work across batches; commands of one batch are taken in the order of ts."""

    def update(key, batches, state):
        now, changes = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for action in rows["action"]:
            if to := TRANSITIONS.get((now, action)):
                now, changes = to, changes + 1
        state.update((now, changes))
        yield pd.DataFrame({"request": [key[0]], "state": [now], "changes": [changes]})

    out = "request string, state string, changes int"
    return commands.groupBy("request").applyInPandasWithState(update, out, "state string, changes int", "update", GroupStateTimeout.NoTimeout)


#: What is told of a request when it enters a state, and of a sign of life while it is worked on.
NOTICES = {"ACTIVE": "STARTED", "DONE": "FINISHED", "ERROR": "FINISHED", "CANCELLED": "FINISHED"}
ALIVE, ALIVE_NOTICE = "progress", "INPROGRESS"


def followed(commands: DataFrame, limit: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(request, ts, state, notice, overdue): what is to be told of a stream of commands(request, action, ts), as it happens. A
    request that is worked on must show itself (progress, done, error) within the limit of event time; else it goes into ERROR, with
    overdue set, once the watermark has passed. States are kept per request across batches; commands of one batch are taken in the
    order of ts, and those that a state doesn't know tell nothing."""
    span = int(pd.Timedelta(limit).total_seconds() * 1000)

    def update(key, batches, state):
        now, last = state.get if state.exists else ("", 0)
        told = []
        if state.hasTimedOut:
            if now == "ACTIVE":
                now = "ERROR"
                told.append((last + span, now, "FINISHED", True))
        else:
            for action, ms in pd.concat(list(batches)).sort_values("ms", kind="stable")[["action", "ms"]].itertuples(index=False):
                if now == "ACTIVE" and last + span < ms:  # it was overdue before this came
                    now = "ERROR"
                    told.append((last + span, now, "FINISHED", True))
                to = TRANSITIONS.get((now, action))
                if to is None and not (now == "ACTIVE" and action == ALIVE):
                    continue
                last = int(ms)
                if to is None:
                    told.append((last, now, ALIVE_NOTICE, False))
                else:
                    now = to
                    if now in NOTICES:
                        told.append((last, now, NOTICES[now], False))
        state.update((now, last))
        if now == "ACTIVE":
            state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in told], columns=["request", "ms", "state", "notice", "overdue"])

    out = "request string, ms long, state string, notice string, overdue boolean"
    timed = commands.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    found = timed.groupBy("request").applyInPandasWithState(update, out, "state string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("request", F.timestamp_millis("ms").alias("ts"), "state", "notice", "overdue")
