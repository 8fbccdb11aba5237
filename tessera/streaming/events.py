"""Event streams: windows with watermarks, deduplication, interval joins, late deliveries and custom state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.session import Scratch


def event_stream(spark: SparkSession, path: str, late: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of events as a stream; ``ts`` becomes a timestamp, as watermarks need.

    All files there are go into one batch, so none of their rows is late, whatever their order. With
    ``files_per_trigger`` they are dealt to batches, and the files must be in time order up to ``late``.
    """
    schema = spark.read.parquet(path).schema
    # As a pattern, so that a table may be one file or a folder of files.
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, size: str) -> DataFrame:
    """Events and their value by window and type; a window is put out once the watermark has passed it."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    """Events by user and session."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event id once, with state kept only as long as the watermark asks."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def follow_ups(first: DataFrame, second: DataFrame, within: str) -> DataFrame:
    """Pairs of one user's events where the second comes ``within`` an interval after the first."""
    a = first.select(F.col("event_id").alias("first_id"), F.col("user_id").alias("first_user"), F.col("ts").alias("first_ts"))
    b = second.select(F.col("event_id").alias("second_id"), "user_id", F.col("ts").alias("second_ts"))
    return a.join(b, F.expr(f"first_user = user_id AND second_ts > first_ts AND second_ts <= first_ts + INTERVAL {within}")).select("user_id", "first_id", "second_id")


class _Abandoned(StatefulProcessor):
    """A user's views and purchases until the watermark has passed their time and the interval after it; then views are judged and all of them let go.

    A user has one timer, for the oldest event kept, a view or a purchase: so whoever only buys leaves nothing behind. When it
    expires, all views that are due are judged in one pass over both lists in order of time.
    """

    def __init__(self, minutes: int):
        self.within = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.views = handle.getListState("views", "event_id long, at long")
        self.bought = handle.getListState("bought", "at long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for part in rows:
            views, bought = part[part["event_type"] == "view"], part[part["event_type"] == "purchase"]
            if len(views):
                self.views.appendList([(int(e), int(at)) for e, at in zip(views["event_id"], views["at"])])
            if len(bought):
                self.bought.appendList([(int(at),) for at in bought["at"]])
            if len(part):
                oldest = min(x for x in (oldest, int(part["at"].min())) if x is not None)
        if oldest is not None:
            self.wake(oldest)
        yield pd.DataFrame({"user_id": [], "event_id": []})

    def wake(self, oldest: int) -> None:
        """Have a timer by the time that the interval after ``oldest`` is over."""
        ms = -(-(oldest + self.within) // 1000)
        now = self.due.get()[0] if self.due.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        views, bought = sorted(self.views.get(), key=lambda v: v[1]), sorted(at for (at,) in self.bought.get())
        out, next_buy = [], 0
        due = sum(at + self.within <= now for _, at in views)
        for event_id, at in views[:due]:
            while next_buy < len(bought) and bought[next_buy] <= at:
                next_buy += 1
            if next_buy == len(bought) or bought[next_buy] > at + self.within:
                out.append(event_id)
        # Views that are still to be judged or to come are younger than this time less the interval, and so are the purchases that they need.
        left, kept = views[due:], [(at,) for at in bought if at + self.within > now]
        for state, values in ((self.views, left), (self.bought, kept)):
            state.put(values) if values else state.clear()
        self.due.clear()
        if left or kept:
            self.wake(min([at for _, at in left[:1]] + [at for (at,) in kept[:1]]))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out})

    def close(self) -> None:
        pass


def abandoned(events: DataFrame, minutes: int) -> DataFrame:
    """``(user_id, event_id)`` of views that no purchase of the same user follows within ``minutes``, once the watermark has passed that time.

    Custom state by user with event-time timers. Needs the RocksDB state store, which :func:`run_available` sets.
    """
    rows = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(_Abandoned(minutes), "user_id long, event_id long", "Append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, out: str, state: str, mode: str) -> StreamingQuery:
    """Run a stream over what there is. The sink is written batch by batch under the batch's number, so a batch that is run again after a failure replaces itself."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # state on disk, and the only store for custom state
    try:
        query = stream.writeStream.foreachBatch(batch_sink(out)).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(key, before)


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, ``batch=<number>``, in place of what may be there."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def put_out(spark: SparkSession, stream: DataFrame, out: str) -> DataFrame:
    """All that a stream has put out; nothing, if it has run no batch."""
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/batch=-1")
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def run_available(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into a table in the shared folder, and return that table."""
    scratch = Scratch(spark, label)
    out = f"{scratch.root}/out"
    _run(stream, out, f"{scratch.root}/state", mode)
    return put_out(spark, stream, out)


def run_deliveries(spark: SparkSession, deliveries: list[DataFrame], counted: Callable[[DataFrame], DataFrame], label: str, late: str) -> DataFrame:
    """Run a stream over deliveries that come one after the other, and return all that it has put out.

    The watermark stays between deliveries: rows of windows that it has passed are dropped as too late.
    """
    scratch = Scratch(spark, label)
    source, out = f"{scratch.root}/in", f"{scratch.root}/out"
    for delivery in deliveries:
        delivery.write.mode("append").parquet(source)
        stream = counted(event_stream(spark, source, late))
        _run(stream, out, f"{scratch.root}/state", "append")
    return put_out(spark, stream, out)


def deal_in_time(events: DataFrame, out: str, slices: int) -> None:
    """Write a table as ``slices`` deliveries of equal spans of time, each by all tasks, the earliest first."""
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if ends["a"] is None:
        events.write.mode("append").parquet(out)
        return
    span = (ends["b"] - ends["a"]) / slices
    at = [ends["a"] + span * i for i in range(slices)]
    for i, start in enumerate(at):
        within = F.col("ts") >= F.lit(start).cast(events.schema["ts"].dataType)
        if i + 1 < slices:
            within &= F.col("ts") < F.lit(at[i + 1]).cast(events.schema["ts"].dataType)
        events.where(within).write.mode("append").parquet(out)


def lateness_seconds(spark: SparkSession, path: str) -> int:
    """How far a file's rows lie behind the newest row of the files before it, in the order in which a stream reads them, rounded up."""
    files = spark.read.parquet(path).select("ts", F.col("_metadata.file_modification_time").alias("written"))
    # Files written at one moment are read in any order, so they count as one. A row a file.
    spans = files.groupBy("written").agg(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b")).orderBy("written").collect()
    newest, late = None, 0.0
    for r in spans:
        if newest is not None and r["a"] is not None:
            late = max(late, (newest - r["a"]).total_seconds())
        newest = max((x for x in (newest, r["b"]) if x is not None), default=None)
    return int(-(-late // 1))


def run_in_batches(spark: SparkSession, path: str, counted: Callable[[DataFrame], DataFrame], label: str, files_per_trigger: int, scratch: Scratch | None = None) -> DataFrame:
    """Run a stream over the files of a table in several batches, with a watermark as late as the files were measured to be, so that no row is lost.

    State is dropped as the watermark goes on. A run that was broken off is taken up again by calling this with the same ``scratch``: batches that were
    put out stay, one that was broken off is run again and replaces what it left.
    """
    scratch = scratch or Scratch(spark, label)
    stream = counted(event_stream(spark, path, f"{lateness_seconds(spark, path) + 1} seconds", files_per_trigger))
    _run(stream, f"{scratch.root}/out", f"{scratch.root}/state", "append")
    return put_out(spark, stream, f"{scratch.root}/out")
