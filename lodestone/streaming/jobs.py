"""Job states from a stream of job events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds before the first retry and at most, and attempts. Fixed values.
FIRST_WAIT, LONGEST_WAIT, ATTEMPTS = 30, 900, 3


def backoff(attempt):
    return F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2), attempt - 1)).cast("long")


#: The share of a wait that chance may add. Fixed value.
JITTER = 0.3


def fail(jobs: DataFrame, failed_at: Column, retryable: Column, most: Column | None = None) -> DataFrame:
    """``jobs`` (job_id, status, attempts, run_at, last_error) after each failed with ``error`` at a time: pending again, or failed.

    One that used up its attempts, or whose error isn't worth a retry, has failed. Others wait, twice as
    long each time, and up to ``JITTER`` of that longer, by a hash of the job and its attempt, so that a plan that
    runs again waits alike. What was cancelled stays so. Errors are cut at 1000 characters.
    """
    over = ~retryable | (F.col("attempts") >= (F.lit(ATTEMPTS) if most is None else most))
    chance = F.pmod(F.xxhash64("job_id", "attempts"), F.lit(1_000_000)) / 1_000_000
    wait = backoff(F.col("attempts")) * 1000
    later = failed_at + F.make_dt_interval(secs=((wait + F.floor(chance * JITTER * wait + 0.5)) / 1000).cast("decimal(18,6)"))
    stays = F.col("status") == "cancelled"
    return jobs.withColumns({
        "status": F.when(stays, F.col("status")).when(over, "failed").otherwise("pending"),
        "run_at": F.when(~stays & ~over, later).otherwise(F.col("run_at")),
        "last_error": F.when(stays, F.col("last_error")).otherwise(F.substring("error", 1, 1000)),
    }).drop("error")


def next_state(df: DataFrame) -> DataFrame:
    """``df`` (event: claim, done, fail, cancel; status; attempts) with the status that follows.

    Only a running job can be done or fail; what is cancelled stays so.
    """
    e, s = F.col("event"), F.col("status")
    status = F.when(s == "cancelled", s).when(e == "cancel", "cancelled").when((e == "claim") & (s == "pending"), "running")
    status = status.when((e == "done") & (s == "running"), "completed").when((e == "fail") & (s == "running"), F.when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("pending"))
    return df.withColumn("next", status.otherwise(s)).withColumn("wait", F.when((e == "fail") & (F.col("next") == "pending"), backoff(F.col("attempts"))))


def claim(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The pending job that is due first, running, with one attempt more; one writer claims at a time."""
    due = jobs.where((F.col("status") == "pending") & (F.col("run_at") <= as_of)).orderBy("run_at", "job_id").limit(1)
    return due.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def cancel(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """``jobs`` with ``was``, where the unfinished ones of ``sources`` (source) are cancelled; ``was`` is the state before, null where nothing changed."""
    hit = jobs.join(sources.select("source").distinct().withColumn("_hit", F.lit(True)), "source", "left")
    ends = F.col("_hit") & F.col("status").isin("pending", "running")
    return hit.withColumn("was", F.when(ends, F.col("status"))).withColumn("status", F.when(ends, "cancelled").otherwise(F.col("status"))).drop("_hit")


def drain(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Rows by ``keys`` of all that a stream holds now: key columns and n.

    Each micro-batch writes its own partial counts to ``folder``, under its number, so one that runs again
    replaces its files; the counts are summed when read. Nothing passes the driver, and no state is kept.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*keys).schema.fields)
    counts = spark.read.schema(f"{kinds}, n long").parquet(f"{folder}/counts")
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))
