"""Ledgers of long work: runs with a heartbeat, files and pages with a state, and the plan of the next run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without a heartbeat after which a run is dead; age in seconds from which a document without a job counts. Fixed values.
STALE, SETTLED_AFTER = 45, 120
#: States in which a file needs nothing more, in which a document is in flight, and in which a job is. Fixed values.
SETTLED, IN_FLIGHT, ACTIVE = ("queued", "duplicate"), ("queued", "processing", "rag_processing", "workdrive_uploading"), ("pending", "running")


def seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def live_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs (id, started, finished_at, heartbeat_at, ...) that are alive: not finished, and heard of in the last ``STALE`` seconds."""
    return runs.where(F.col("finished_at").isNull() & (F.col("heartbeat_at") > as_of - seconds(STALE)))


def settle_dead(runs: DataFrame, files: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Both ledgers after dead runs were closed; files that one was downloading wait again. ``files``: file_id, run_id, status, message."""
    dead = F.col("finished_at").isNull() & (F.col("heartbeat_at") < as_of - seconds(STALE))
    gone = runs.where(dead).select(F.col("id").alias("run_id"), F.lit(True).alias("_dead"))
    runs = runs.withColumns({"finished_at": F.when(dead, as_of).otherwise(F.col("finished_at")), "stopped": F.when(dead, True).otherwise(F.col("stopped")), "error": F.when(dead, F.coalesce("error", F.lit("Interrupted"))).otherwise(F.col("error"))})
    back = F.col("_dead") & (F.col("status") == "downloading")
    files = files.join(gone, "run_id", "left").select(*[F.when(back, v).otherwise(F.col(c)).alias(c) if (v := {"status": "waiting", "message": "Interrupted"}.get(c)) else F.col(c) for c in files.columns])
    return runs, files


def jobless(documents: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Documents in flight for two minutes or more that no pending or running job has. ``documents``: doc_id, ingest_status, created_at."""
    old = documents.where(F.col("ingest_status").isin(*IN_FLIGHT) & (F.col("created_at") < as_of - seconds(SETTLED_AFTER)))
    return old.join(jobs.where(F.col("status").isin(*ACTIVE)).select("doc_id"), "doc_id", "left_anti")


def pending_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of a listing (file_id, modified_time) to take up: file_id, modified_time, doc_id, why (new, changed, unsettled).

    A file that stopped with a document keeps it while it is unchanged.
    """
    known = ledger.select("file_id", F.col("modified_time").alias("was"), "status", F.col("doc_id").alias("had"))
    both = listing.join(known, "file_id", "left")
    same = F.col("was").eqNullSafe(F.col("modified_time"))
    why = F.when(F.col("status").isNull(), "new").when(~same, "changed").when(~F.col("status").isin(*SETTLED), "unsettled")
    return both.withColumn("why", why).where("why IS NOT NULL").select("file_id", "modified_time", F.when(same, F.col("had")).alias("doc_id"), "why")


def forget_missing(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """``ledger`` without waiting or failed files that have no document and aren't listed; an empty listing forgets nothing."""
    listed = listing.select("file_id", F.lit(True).alias("_listed"))
    some = listing.limit(1).agg(F.count("*").alias("_some"))
    out = ledger.join(listed, "file_id", "left").crossJoin(F.broadcast(some))
    gone = F.col("status").isin("waiting", "failed") & F.col("doc_id").isNull() & F.col("_listed").isNull() & (F.col("_some") > 0)
    return out.where(~gone).select(*ledger.columns)


def plan(waiting: DataFrame, pending: DataFrame) -> DataFrame:
    """The order of a run: stage 1 documents without a job, then paused files; stage 2 all others, once those are done: stage, what, id."""
    docs = waiting.select(F.lit(1).alias("stage"), F.lit("document").alias("what"), F.col("doc_id").cast("string").alias("id"))
    files = pending.select(F.when(F.col("doc_id").isNotNull(), 1).otherwise(2).alias("stage"), F.when(F.col("doc_id").isNotNull(), "paused file").otherwise("file").alias("what"), F.col("file_id").cast("string").alias("id"))
    return docs.unionByName(files)


def totals_by_type(listing: DataFrame, pending: DataFrame, known_types: list[str]) -> DataFrame:
    """type, total, remaining, skipped: files of types that can't be read are skipped and remain nowhere."""
    rows = listing.join(pending.select("file_id", F.lit(1).alias("_p")), "file_id", "left")
    reads = F.col("type").isin(*known_types)
    return rows.groupBy("type").agg(F.count(F.when(reads, 1)).alias("total"), F.count(F.when(reads & F.col("_p").isNotNull(), 1)).alias("remaining"), F.count(F.when(~reads, 1)).alias("skipped"))


def runs_with_files(runs: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """The latest ``k`` runs, newest first, each with its files in order as a list."""
    last = runs.orderBy(F.desc("id")).limit(k)
    few = files.join(F.broadcast(last.select(F.col("id").alias("run_id"))), "run_id")
    listed = few.groupBy(F.col("run_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("file_id", "status"))).alias("files"))
    return last.join(listed, "id", "left").orderBy(F.desc("id"))


def next_page_state(status: Column, event: Column) -> Column:
    """pending, processing, completed, failed: work starts on what isn't completed; only what is in work ends; a retry takes failed pages back."""
    return (
        F.when((event == "start") & status.isin("pending", "failed"), "processing")
        .when((event == "complete") & (status == "processing"), "completed")
        .when((event == "fail") & (status == "processing"), "failed")
        .when((event == "retry") & (status == "failed"), "pending")
        .otherwise(status)
    )


def page_histogram(pages: DataFrame) -> DataFrame:
    """doc_id, and the pages in each state."""
    states = ["pending", "processing", "completed", "failed"]
    return pages.groupBy("doc_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in states])


def progress(done: Column, total: Column) -> Column:
    """Percent, halves up; 0 of nothing."""
    return F.when(total > 0, F.floor(done * 100 / total + 0.5)).otherwise(0).cast("long")


def wait_for_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks of each page that have no vector yet; those without a page count with page 1."""
    return chunks.where("embedding IS NULL").groupBy("doc_id", F.coalesce("page", F.lit(1)).alias("page")).agg(F.count("*").alias("waiting"))


def visual_plan(pages: DataFrame, most: int = 40) -> DataFrame:
    """Pages (doc_id, page, image_px, has_caption, path_ops, has_table) worth a look, the first ``most`` of a document: with ``reasons``."""
    reasons = F.array_compact(F.array(F.when(F.col("image_px") >= 100, "image"), F.when(F.col("has_caption"), "caption"), F.when(F.col("path_ops") >= 150, "drawing"), F.when(F.col("has_table"), "table")))
    out = pages.select("doc_id", "page", reasons.alias("reasons")).where(F.size("reasons") > 0)
    return out.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("n") <= most).drop("n")


def with_descriptions(visuals: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``visuals`` (hash) with the cached ``description`` of this model, or null where one must be made."""
    known = cache.where(F.col("model") == model).groupBy("hash").agg(F.min("description").alias("description"))
    return visuals.join(known, "hash", "left")


def reduce_events(events: DataFrame, key: str = "session_id") -> DataFrame:
    """The state of each session after its ``events`` (key, seq, type, payload as JSON): status, outcome, steps, citations, images, warned.

    The last event that sets a status decides it. A chunk is cited once. Steps are counted and told in order by their digest.
    """
    seq = F.col("seq")
    status = F.when(F.col("type").isin("clarify", "done"), "done").when(F.col("type").isin("not_covered", "conflict"), "refused").when(F.col("type") == "step", "streaming").when(F.col("type") == "error", "error")
    outcome = F.when(F.col("type").isin("clarify", "not_covered", "conflict"), F.col("type")).when(F.col("type") == "done", F.get_json_object("payload", "$.gateOutcome"))
    chunk = F.when(F.col("type") == "citation", F.get_json_object("payload", "$.chunkId"))
    return events.groupBy(key).agg(
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), seq)), F.lit("idle")).alias("status"),
        F.max_by(outcome, F.when(outcome.isNotNull(), seq)).alias("outcome"),
        F.count(F.when(F.col("type") == "step", 1)).alias("steps"),
        F.count_distinct(chunk).alias("citations"),
        F.max_by("payload", F.when(F.col("type") == "images", seq)).alias("images"),
        F.coalesce(F.max(F.col("type") == "deadline_warning"), F.lit(False)).alias("warned"),
    )
