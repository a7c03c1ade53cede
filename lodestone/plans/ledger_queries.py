"""Ledgers, states and merges: events and orders stand for runs, jobs, files and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.files import contains_escaped, extension, is_uuid, kind_of, matches_kind, retries
from lodestone.operators import merging as m
from lodestone.operators import sync as s
from lodestone.operators.layout import gaps, lines
from lodestone.operators.merging import keep_smallest
from lodestone.plans.retrieval_queries import table
from lodestone.shared import new_folder
from lodestone.streaming.jobs import backoff, claim, next_state
from lodestone.streaming.leases import follow_leases, stale_leases

#: What "now" is for the ledgers.
AS_OF = "2024-01-25 16:54:57"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _runs(spark, sf_dir):
    """A user is a run: heard of at its last event before now, finished if that was a purchase."""
    e = table(spark, sf_dir, "events").where(F.col("ts") <= _now())
    last = e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("heartbeat_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return last.select("id", "heartbeat_at", F.when(F.col("kind") == "purchase", F.col("heartbeat_at")).alias("finished_at"), F.lit(False).alias("stopped"), F.when(F.col("kind") == "error", "broke").alias("error"))


RUNS = f"""last AS (SELECT user_id AS id, max(ts) AS heartbeat_at, arg_max(event_type, (ts, event_id)) AS kind FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1),
runs AS (SELECT id, heartbeat_at, kind, kind = 'purchase' AS finished, heartbeat_at < TIMESTAMP '{AS_OF}' - INTERVAL 45 SECONDS AS stale FROM last)"""


def _files(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "downloading").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "purchase", "duplicate").otherwise("failed")
    return e.select(F.col("event_id").alias("file_id"), F.col("user_id").alias("run_id"), status.alias("status"), F.lit("").alias("message"), F.floor("value").cast("long").alias("modified_time"), F.when(F.col("value") > 50, F.col("event_id")).alias("doc_id"), "event_type")


def live_runs(spark, sf_dir):
    return s.live_runs(_runs(spark, sf_dir), _now()).select("id")


LIVE_SQL = f"WITH {RUNS} SELECT id FROM runs WHERE NOT finished AND heartbeat_at > TIMESTAMP '{AS_OF}' - INTERVAL 45 SECONDS"


def settle_dead(spark, sf_dir):
    """Dead runs are closed, and what they were downloading waits again."""
    runs, files = s.settle_dead(_runs(spark, sf_dir), _files(spark, sf_dir), _now())
    closed = runs.groupBy(F.concat_ws(":", F.lit("run"), "stopped", "error").alias("what")).agg(F.count("*").alias("n"))
    return closed.unionByName(files.groupBy(F.concat_ws(":", F.lit("file"), "status", "message").alias("what")).agg(F.count("*").alias("n")))


SETTLE_SQL = f"""WITH {RUNS}, r AS (SELECT *, NOT finished AND stale AS dead FROM runs),
f AS (SELECT CASE event_type WHEN 'click' THEN 'downloading' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'duplicate' ELSE 'failed' END AS status, coalesce(dead, false) AS dead FROM events LEFT JOIN r ON id = user_id)
SELECT concat_ws(':', 'run', dead::VARCHAR, CASE WHEN kind = 'error' THEN 'broke' WHEN dead THEN 'Interrupted' END) AS what, count(*)::BIGINT AS n FROM r GROUP BY 1
UNION ALL SELECT concat_ws(':', 'file', CASE WHEN dead AND status = 'downloading' THEN 'waiting' ELSE status END, CASE WHEN dead AND status = 'downloading' THEN 'Interrupted' ELSE '' END), count(*) FROM f GROUP BY 1"""


def jobless(spark, sf_dir):
    """Orders stand for documents, lines for their jobs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("ingest_status"), F.col("o_orderdate").alias("created_at"))
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "N", "running").otherwise("completed").alias("status"))
    return s.jobless(o, jobs, F.lit("1996-06-01").cast("timestamp_ntz")).select("doc_id", "o_custkey")


JOBLESS_SQL = """SELECT o_orderkey AS doc_id, o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1996-06-01' - INTERVAL 2 MINUTES
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')"""


def _listing(spark, sf_dir):
    """What the folder lists now: documents, as changed as their length says."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (F.col("n_chars") % 100).alias("modified_time"), F.col("lang").alias("type"))


PENDING = """l AS (SELECT doc_id AS file_id, n_chars % 100 AS modified_time, lang AS type FROM documents),
k AS (SELECT event_id AS file_id, floor(value)::BIGINT AS was, CASE event_type WHEN 'click' THEN 'downloading' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'duplicate' ELSE 'failed' END AS status, CASE WHEN value > 50 THEN event_id END AS had FROM events),
p AS (SELECT l.file_id, modified_time, CASE WHEN was = modified_time THEN had END AS doc_id, CASE WHEN status IS NULL THEN 'new' WHEN was IS DISTINCT FROM modified_time THEN 'changed' WHEN status NOT IN ('queued', 'duplicate') THEN 'unsettled' END AS why FROM l LEFT JOIN k USING (file_id))"""


def pending_set(spark, sf_dir):
    """Files that are new, changed or unsettled against the ledger."""
    return s.pending_files(_listing(spark, sf_dir), _files(spark, sf_dir))


PENDING_SQL = f"WITH {PENDING} SELECT * FROM p WHERE why IS NOT NULL"


def forget_missing(spark, sf_dir):
    return s.forget_missing(_files(spark, sf_dir), _listing(spark, sf_dir)).select("file_id", "status")


FORGET_SQL = f"WITH {PENDING} SELECT file_id, status FROM k WHERE NOT (status IN ('waiting', 'failed') AND had IS NULL AND file_id NOT IN (SELECT file_id FROM l))"


def sync_plan(spark, sf_dir):
    waiting = jobless(spark, sf_dir)
    return s.plan(waiting, pending_set(spark, sf_dir)).groupBy("stage", "what").agg(F.count("*").alias("n"))


PLAN_SQL = f"""WITH {PENDING}, j AS ({JOBLESS_SQL}) SELECT 1::INT AS stage, 'document' AS what, count(*)::BIGINT AS n FROM j HAVING count(*) > 0
UNION ALL SELECT CASE WHEN doc_id IS NULL THEN 2 ELSE 1 END, CASE WHEN doc_id IS NULL THEN 'file' ELSE 'paused file' END, count(*) FROM p WHERE why IS NOT NULL GROUP BY ALL"""


def totals_by_type(spark, sf_dir):
    return s.totals_by_type(_listing(spark, sf_dir), pending_set(spark, sf_dir), ["en", "fr"])


TOTALS_SQL = f"""WITH {PENDING} SELECT l.type, count(*) FILTER (l.type IN ('en', 'fr'))::BIGINT AS total, count(*) FILTER (l.type IN ('en', 'fr') AND why IS NOT NULL)::BIGINT AS remaining, count(*) FILTER (l.type NOT IN ('en', 'fr'))::BIGINT AS skipped
FROM l JOIN p USING (file_id) GROUP BY l.type"""


def runs_with_files(spark, sf_dir):
    out = s.runs_with_files(_runs(spark, sf_dir), _files(spark, sf_dir), 10)
    return out.select("id", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("n"), F.get("files", F.lit(0))["file_id"].alias("first_file"))


RUNS_SQL = f"WITH {RUNS}, t AS (SELECT id FROM runs ORDER BY id DESC LIMIT 10) SELECT id, count(event_id)::BIGINT AS n, min(event_id) AS first_file FROM t LEFT JOIN events ON user_id = id GROUP BY id"


def _pages(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "A", "pending").when(F.col("l_returnflag") == "N", "processing").otherwise("failed").alias("status"), F.when(F.col("l_linestatus") == "F", "start").otherwise("complete").alias("event"), "l_quantity", "l_discount", "l_tax")


def page_states(spark, sf_dir):
    """Pages of each document by the state that follows, and how far the document is."""
    moved = _pages(spark, sf_dir).withColumn("status", s.next_page_state(F.col("status"), F.col("event")))
    out = s.page_histogram(moved)
    return out.withColumn("percent", s.progress(F.col("completed"), F.col("pending") + F.col("processing") + F.col("completed") + F.col("failed")))


PAGES_SQL = """WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linestatus = 'F' THEN 'processing' WHEN l_returnflag = 'A' THEN 'pending' WHEN l_returnflag = 'N' THEN 'completed' ELSE 'failed' END AS status FROM lineitem)
SELECT doc_id, count(*) FILTER (status = 'pending')::BIGINT AS pending, count(*) FILTER (status = 'processing')::BIGINT AS processing, count(*) FILTER (status = 'completed')::BIGINT AS completed, count(*) FILTER (status = 'failed')::BIGINT AS failed,
  floor(count(*) FILTER (status = 'completed') * 100 / count(*)::DOUBLE + 0.5)::BIGINT AS percent FROM p GROUP BY doc_id"""


def visual_plan(spark, sf_dir):
    """Pages worth a look, three to a document."""
    p = _pages(spark, sf_dir).groupBy("doc_id", "page").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    p = p.select("doc_id", "page", (F.col("q") * 4).alias("image_px"), (F.col("d") > 0.08).alias("has_caption"), (F.col("q") * 5).alias("path_ops"), (F.col("t") > 0.06).alias("has_table"))
    return s.visual_plan(p, 3).select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"))


VISUAL_SQL = """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY ALL),
r AS (SELECT doc_id, page, list_filter([CASE WHEN q * 4 >= 100 THEN 'image' END, CASE WHEN d > 0.08 THEN 'caption' END, CASE WHEN q * 5 >= 150 THEN 'drawing' END, CASE WHEN t > 0.06 THEN 'table' END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT doc_id, page, array_to_string(l, ',') AS reasons FROM r WHERE len(l) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 3"""


def stream_reducer(spark, sf_dir):
    """The state of each user's session after all its events."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "step").when(F.col("event_type") == "view", "citation").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("deadline_warning")
    payload = F.concat(F.lit('{"chunkId":"'), F.get_json_object("props", "$.k"), F.lit('","gateOutcome":"answered"}'))
    return s.reduce_events(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("type"), payload.alias("payload"))).drop("images")


REDUCER_SQL = """WITH e AS (SELECT user_id AS session_id, event_id, event_type AS t, (props::JSON ->> '$.k') AS k FROM events)
SELECT session_id, coalesce(arg_max(CASE t WHEN 'click' THEN 'streaming' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END, event_id) FILTER (t IN ('click', 'purchase', 'error')), 'idle') AS status,
  max(CASE WHEN t = 'purchase' THEN 'answered' END) AS outcome, count(*) FILTER (t = 'click')::BIGINT AS steps, count(DISTINCT k) FILTER (t = 'view')::BIGINT AS citations, bool_or(t NOT IN ('click', 'view', 'purchase', 'error')) AS warned FROM e GROUP BY session_id"""


def claim_next(spark, sf_dir):
    """The job that is due first, with one attempt more."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "pending").otherwise("running").alias("status"), F.col("ts").alias("run_at"), (F.col("user_id") % 3).alias("attempts"))
    return claim(jobs, _now()).select("job_id", "status", "attempts")


CLAIM_SQL = f"SELECT event_id AS job_id, 'running' AS status, user_id % 3 + 1 AS attempts FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '{AS_OF}' ORDER BY ts, event_id LIMIT 1"


def job_transitions(spark, sf_dir):
    """States of jobs and what events make of them."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "done").when(F.col("event_type") == "purchase", "cancel").otherwise("fail").alias("event"), F.when(F.col("value") < 30, "pending").when(F.col("value") < 80, "running").otherwise("cancelled").alias("status"), (F.col("user_id") % 4).cast("int").alias("attempts"))
    return next_state(rows).select("event_id", "next", "wait")


TRANSITION_SQL = """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'done' WHEN 'purchase' THEN 'cancel' ELSE 'fail' END AS e, CASE WHEN value < 30 THEN 'pending' WHEN value < 80 THEN 'running' ELSE 'cancelled' END AS s, user_id % 4 AS a FROM events),
n AS (SELECT event_id, e, s, a, CASE WHEN s = 'cancelled' THEN s WHEN e = 'cancel' THEN 'cancelled' WHEN e = 'claim' AND s = 'pending' THEN 'running' WHEN e = 'done' AND s = 'running' THEN 'completed' WHEN e = 'fail' AND s = 'running' THEN CASE WHEN a >= 3 THEN 'failed' ELSE 'pending' END ELSE s END AS next FROM r)
SELECT event_id, next, CASE WHEN e = 'fail' AND next = 'pending' THEN least(900, 30 * pow(2, a - 1))::BIGINT END AS wait FROM n"""


def backoff_schedule(spark, sf_dir):
    n = spark.range(1, 9).withColumnRenamed("id", "attempt")
    return n.select("attempt", backoff(F.col("attempt")).alias("seconds"))


BACKOFF_SQL = "SELECT attempt, least(900, 30 * pow(2, attempt - 1))::BIGINT AS seconds FROM range(1, 9) t(attempt)"


def keep_smallest_duplicate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return keep_smallest(d, ["hash"], "doc_id").select("doc_id")


SMALLEST_SQL = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"


def purge(spark, sf_dir):
    """Customers without money go with their orders, but for those with an open order; their nations' notes lose the reference."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    tables = {
        "customers": c.select(F.col("c_custkey").alias("k")),
        "orders": o.select("o_orderkey", F.col("o_custkey").alias("k")),
        "notes": table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("about")),
        "audit": c.limit(0).select(F.col("c_custkey").alias("k"), F.lit("").alias("action"), _now().alias("at")),
    }
    gone = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    busy = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    out = m.purge(tables, gone, "k", {"notes": "about"}, busy, "audit", _now())
    counts = [out[n].agg(F.count("*").alias("n"), F.sum(F.col(c).cast("long")).alias("total")).select(F.lit(n).alias("name"), "n", "total") for n, c in (("customers", "k"), ("orders", "k"), ("notes", "about"), ("audit", "k"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


PURGE_SQL = """WITH g AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
SELECT 'customers' AS name, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey NOT IN (FROM g)
UNION ALL SELECT 'orders', count(*), sum(o_custkey)::BIGINT FROM orders WHERE o_custkey NOT IN (FROM g)
UNION ALL SELECT 'notes', count(*), sum(CASE WHEN user_id NOT IN (FROM g) THEN user_id END)::BIGINT FROM events
UNION ALL SELECT 'audit', count(*), sum(k)::BIGINT FROM g"""


def outbox_merge(spark, sf_dir):
    """What waits to be sent, after a batch of news."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.lit("queued").alias("status"), (F.col("user_id") % 3).cast("int").alias("attempts"), F.col("props").alias("body"))
    kind = F.when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "error", "discarded").otherwise("append")
    return m.outbox(old, e.select(F.col("event_id").alias("id"), kind.alias("event"), F.col("props").alias("body")))


OUTBOX_SQL = """SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'failed' ELSE 'queued' END AS status, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN user_id % 3 + 1 ELSE user_id % 3 END::INT AS attempts, props AS body
FROM events WHERE event_type NOT IN ('purchase', 'error')"""


def orphans(spark, sf_dir):
    """Files that nothing refers to and that are older than ten minutes."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("modified"))
    refs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return m.orphans(files, refs, "k", F.lit("1998-01-01").cast("timestamp_ntz")).select("k")


ORPHAN_SQL = "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTES AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def ledger_reset(spark, sf_dir):
    """A listing put over the ledger: a document stays with its file while the file is unchanged."""
    old = _files(spark, sf_dir).select("file_id", "modified_time", "doc_id")
    new = _listing(spark, sf_dir).select("file_id", "modified_time", F.lit(None).cast("long").alias("doc_id"))
    return m.upsert(old, new, ["file_id"], {"doc_id": m.kept_unless_changed("doc_id", "modified_time")})


RESET_SQL = f"WITH {PENDING} SELECT coalesce(l.file_id, k.file_id) AS file_id, CASE WHEN l.file_id IS NULL THEN was ELSE modified_time END AS modified_time, CASE WHEN l.file_id IS NULL OR was IS NOT DISTINCT FROM modified_time THEN had END AS doc_id FROM l FULL JOIN k USING (file_id)"


def file_kinds(spark, sf_dir):
    """Names, kinds and first bytes; ids; replies worth a retry."""
    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("PDF", "docx", "png", "txt")]), (F.col("p_size") % 4 + 1).cast("int")))
    content = F.when(F.col("p_size") % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.lit("PK\x03\x04")).cast("binary")
    code = F.when(F.col("p_size") % 2 == 0, "ETIMEDOUT").otherwise("EX")
    status = F.nullif(F.element_at(F.array(*[F.lit(x) for x in (0, 200, 408, 429, 500, 404)]), (F.col("p_size") % 6 + 1).cast("int")), F.lit(0))
    digest = F.md5("p_name")
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("4"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return part.select("p_partkey", extension(name).alias("ext"), kind_of(name).alias("kind"), matches_kind(name, content).alias("fits"), is_uuid(F.when(F.col("p_size") > 10, uuid).otherwise(digest)).alias("is_id"), retries(status, code).alias("again"), retries(status, code, True).alias("worker_again"), contains_escaped(F.col("p_name"), "RING").alias("ring"), contains_escaped(F.col("p_name"), "%").alias("percent"))


KIND_SQL = """SELECT p_partkey, ['pdf', 'docx', 'png', 'txt'][p_size % 4 + 1] AS ext, ['pdf', 'docx', 'image', NULL][p_size % 4 + 1] AS kind, (p_size % 4 = 0 AND p_size % 3 = 0) OR (p_size % 4 = 1 AND p_size % 3 <> 0) AS fits, p_size > 10 AS is_id,
  CASE WHEN p_size % 6 = 0 THEN p_size % 2 = 0 ELSE p_size % 6 IN (2, 3, 4) END AS again, CASE WHEN p_size % 6 = 0 THEN true ELSE p_size % 6 IN (2, 3, 4) END AS worker_again, contains(lower(p_name), 'ring') AS ring, contains(p_name, '%') AS percent FROM part"""


def _items(spark, sf_dir):
    """A line's parts as text on a page: the order is the page, its lines stand below each other."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("text"), (F.col("l_partkey") % 50 * 12.0 + F.col("l_suppkey") % 7).alias("x"), (F.col("l_linenumber") * -12.0).alias("y"), (F.col("l_quantity") / 2).alias("width"), (F.col("l_tax") * 100 + 8).alias("size"), (F.col("l_linestatus") == "F").alias("bold"))


ITEMS = "t AS (SELECT l_orderkey AS page, l_returnflag AS text, l_partkey % 50 * 12.0::DOUBLE + l_suppkey % 7 AS x, l_linenumber * -12.0::DOUBLE AS y, l_quantity / 2 AS width, l_tax * 100 + 8 AS size, l_linestatus = 'F' AS bold FROM lineitem)"


def page_lines(spark, sf_dir):
    """Lines of each page, their extent and size; equal places are told apart by their text."""
    out = lines(_items(spark, sf_dir), ["page"])
    return out.select("page", "line", "x", "y", "chars", "bold", F.col("size").alias("size"), F.length(F.regexp_replace("text", "[ |]", "")).cast("long").alias("letters"))


LINES_SQL = f"""WITH {ITEMS}, n AS (SELECT *, CASE WHEN lag(y) OVER w - y <= greatest(1.0, 0.35 * size) THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY page ORDER BY y DESC, x, text)),
l AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY y DESC) AS line FROM n),
z AS (SELECT page, line, round(size, 1) AS size, count(*) AS w FROM l GROUP BY page, line, round(size, 1) QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY count(*) DESC, round(size, 1) DESC) = 1)
SELECT l.page, l.line::BIGINT AS line, min(x) AS x, max(y) AS y, count(*)::BIGINT AS chars, bool_and(bold) AS bold, any_value(z.size) AS size, count(*)::BIGINT AS letters FROM l JOIN z USING (page, line) GROUP BY ALL"""


def page_gaps(spark, sf_dir):
    """Empty stretches of each page from left to right."""
    return gaps(_items(spark, sf_dir), ["page"], "x", "width")


GAPS_SQL = f"""WITH {ITEMS}, r AS (SELECT page, x, max(x + width) OVER (PARTITION BY page ORDER BY x, width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY page ORDER BY x, width) - 1 AS before FROM t)
SELECT page, reach AS gap_from, x AS gap_to, before::INT AS before FROM r WHERE reach < x"""

def _lease_events(spark, sf_dir):
    """A user's events as those of a job: every fourth claims it, the next two are heartbeats, the fourth its end."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("ord"), F.element_at(F.array(*[F.lit(x) for x in ("claim", "heartbeat", "heartbeat", "done")]), (F.col("event_id") % 4 + 1).cast("int")).alias("event"))


def lease_ends(spark, sf_dir):
    """Leases of six hours that ran out, by windows over all events."""
    return stale_leases(_lease_events(spark, sf_dir), 6 * 3600)


def lease_stream(spark, sf_dir):
    """The same from a stream of four batches, by state and timers."""
    events = _lease_events(spark, sf_dir)
    first, last = events.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    folder = new_folder(spark, "leases")
    if first is not None:
        for part in range(4):
            since, until = (F.lit(first) + F.make_dt_interval(secs=F.lit((last - first).total_seconds() * p / 4)) for p in (part, part + 1))
            at = F.col("ts").cast("timestamp")
            events.where((at >= since) & (at < until if part < 3 else F.lit(True))).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    return follow_leases(stream, folder, 6 * 3600)


LEASES_SQL = """WITH e AS (SELECT user_id::VARCHAR AS job, epoch_us(ts) // 1000 AS ms, event_id AS ord, event_id % 4 AS k FROM events),
w AS (SELECT *, lead(ms) OVER v AS next, count(*) FILTER (k = 0) OVER v AS attempts, count(*) FILTER (k IN (0, 3)) OVER v AS lease, max(ms) OVER () AS now FROM e WINDOW v AS (PARTITION BY job ORDER BY ms, ord ROWS UNBOUNDED PRECEDING)),
g AS (SELECT job, lease, arg_min(k, (ms, ord)) AS first, min(ms) FILTER (coalesce(next, now) - ms > 21600000) AS last, max(attempts) AS attempts FROM w GROUP BY ALL)
SELECT job, last + 21600000 AS ended, attempts::INT AS attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status FROM g WHERE first = 0 AND last IS NOT NULL"""

PAIRS = {
    "lease_ends": (lease_ends, LEASES_SQL),
    "lease_stream": (lease_stream, LEASES_SQL),
    "live_runs": (live_runs, LIVE_SQL),
    "settle_dead": (settle_dead, SETTLE_SQL),
    "jobless": (jobless, JOBLESS_SQL),
    "pending_set": (pending_set, PENDING_SQL),
    "forget_missing": (forget_missing, FORGET_SQL),
    "sync_plan": (sync_plan, PLAN_SQL),
    "totals_by_type": (totals_by_type, TOTALS_SQL),
    "runs_with_files": (runs_with_files, RUNS_SQL),
    "page_states": (page_states, PAGES_SQL),
    "visual_plan": (visual_plan, VISUAL_SQL),
    "stream_reducer": (stream_reducer, REDUCER_SQL),
    "claim_next": (claim_next, CLAIM_SQL),
    "job_transitions": (job_transitions, TRANSITION_SQL),
    "backoff_schedule": (backoff_schedule, BACKOFF_SQL),
    "keep_smallest_duplicate": (keep_smallest_duplicate, SMALLEST_SQL),
    "purge": (purge, PURGE_SQL),
    "outbox_merge": (outbox_merge, OUTBOX_SQL),
    "orphans": (orphans, ORPHAN_SQL),
    "ledger_reset": (ledger_reset, RESET_SQL),
    "file_kinds": (file_kinds, KIND_SQL),
    "page_lines": (page_lines, LINES_SQL),
    "page_gaps": (page_gaps, GAPS_SQL),
}
