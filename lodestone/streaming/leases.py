"""Leases that end by themselves: a job that nothing is heard of falls back without any event.

As a stream each job is a key with state and a timer in event time; at rest the same is told by
windows over all events. Both give one row for each lease that ran out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.jobs import ATTEMPTS

#: Seconds after which a lease is stale. Fixed value.
STALE_LEASE = 900
OUT = "job string, ended long, attempts int, status string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ended(job: str, ended: int, attempts: int, most: int) -> Row:
    return Row(job=job, ended=ended, attempts=attempts, status="failed" if attempts >= most else "pending")


class Leases(StatefulProcessor):
    """A job's lease: opened by a claim, prolonged by a heartbeat, closed by its end, or by a timer."""

    def __init__(self, seconds: int, most: int):
        self.limit, self.most = seconds * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "last long, attempts int, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, attempts, is_open = self.state.get() if self.state.exists() else (0, 0, False)
        # The events of one job in one batch.
        for ms, _, event in sorted((r["ms"], r["ord"], r["event"]) for r in rows):
            if is_open and ms - last > self.limit:
                yield _ended(key[0], last + self.limit, attempts, self.most)
                is_open = False
            if event == "claim":
                last, attempts, is_open = ms, attempts + 1, True
            elif event == "heartbeat":
                last = ms if is_open else last
            else:
                is_open = False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if is_open:
            self.handle.registerTimer(last + self.limit)
        self.state.update((last, attempts, is_open))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, attempts, is_open = self.state.get()
        if is_open and last + self.limit == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, attempts, False))
            yield _ended(key[0], last + self.limit, attempts, self.most)

    def close(self) -> None:
        pass


def _timed(events: DataFrame) -> DataFrame:
    return events.select(F.col("job").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "ord", "event").withColumn("ms", F.unix_millis("ts"))


def stale_leases(events: DataFrame, seconds: int = STALE_LEASE, most: int = ATTEMPTS) -> DataFrame:
    """Leases that ran out: job, ended (milliseconds), attempts, status (pending, or failed after ``most`` attempts).

    ``events``: job, ts, ord (order of equal times), event: ``claim`` opens a lease, ``heartbeat`` prolongs an
    open one, any other ends it. One that nothing is heard of for more than ``seconds`` has ended, at the latest as
    of the last event of all; what is heard of it afterwards counts for nothing until the next claim.
    """
    rows = _timed(events)
    w = Window.partitionBy("job").orderBy("ms", "ord")
    rows = rows.withColumns({"_next": F.lead("ms").over(w), "attempts": F.count(F.when(F.col("event") == "claim", 1)).over(w), "_lease": F.count(F.when(F.col("event") != "heartbeat", 1)).over(w)})
    now = rows.agg(F.max("ms").alias("_now"))
    rows = rows.crossJoin(F.broadcast(now)).withColumn("_silent", F.coalesce("_next", "_now") - F.col("ms") > seconds * 1000)
    of = rows.groupBy("job", "_lease").agg(F.min_by("event", F.struct("ms", "ord")).alias("first"), F.min(F.when(F.col("_silent"), F.col("ms"))).alias("last"), F.max("attempts").alias("attempts"))
    of = of.where((F.col("first") == "claim") & F.col("last").isNotNull())
    return of.select("job", (F.col("last") + seconds * 1000).alias("ended"), F.col("attempts").cast("int").alias("attempts"), F.when(F.col("attempts") >= most, "failed").otherwise("pending").alias("status"))


def follow_leases(stream: DataFrame, folder: str, seconds: int = STALE_LEASE, most: int = ATTEMPTS) -> DataFrame:
    """What :func:`stale_leases` gives, from a ``stream`` of the same columns in the order of time, read until it has no more.

    The watermark is the time of the last event seen; a lease whose time is past it ends by its timer, without
    an event of its own. State is kept in RocksDB and checkpointed in ``folder``, a shared one, so an executor
    that is lost costs a batch; results are appended there.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        timed = _timed(stream).withWatermark("ts", "0 seconds")
        ended = timed.groupBy("job").transformWithState(Leases(seconds, most), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
        query = ended.writeStream.format("parquet").option("path", f"{folder}/ended").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUT).parquet(f"{folder}/ended")
