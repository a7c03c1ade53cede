"""What a service does around its data: pages of a list, checks, reconciliation, refusals, retries, and shapes of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import follow_up
from lodestone.operators import crawl, integrity, paging
from lodestone.operators import publication as p
from lodestone.operators import retrieval as r
from lodestone.operators.conversation import log_turns, with_topic
from lodestone.operators.layout import displayed
from lodestone.operators.sync import wait_for_vectors
from lodestone.plans.retrieval_queries import table
from lodestone.sources.wires import circuit
from lodestone.streaming.jobs import cancel, fail


def documents_page(spark, sf_dir):
    """The third page of ten of the documents of a source, longest first, with their state (1:1) and the total."""
    d, state = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("ingest_status"))
    rows = d.select("doc_id", "source", "n_chars").where(F.ilike("source", F.lit("%C1%"))).join(state, "doc_id")
    return paging.page_of(rows, [F.desc("n_chars"), F.asc("doc_id")], "2", 10)


PAGE_SQL = """WITH f AS (SELECT doc_id, source, n_chars, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS ingest_status FROM documents JOIN labels USING (doc_id) WHERE source ILIKE '%c1%')
SELECT *, (SELECT count(*) FROM f) AS total, 2::INT AS page, 10::INT AS page_size, greatest(1, ceil((SELECT count(*) FROM f) / 10.0))::INT AS total_pages FROM (SELECT * FROM f ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10)"""


def live_invariants(spark, sf_dir):
    """Documents as chunks of their sources, some live that shouldn't be, with parents of other sources; customers as cards."""
    d = table(spark, sf_dir, "documents")
    docs = d.groupBy(F.col("source").alias("doc_id")).agg(F.when(F.max("n_chars") % 7 == 0, "superseded").otherwise("current").alias("status"), F.lit(1).alias("live_version"))
    n = F.col("doc_id")
    chunks = d.select(n.alias("chunk_id"), F.col("source").alias("doc_id"), (n % 29 % 2 + 1 - n % 2 * (n % 29 % 2)).cast("int").alias("version"), (n % 3 != 0).alias("is_live"), (n % 10 == 0).alias("is_parent"), F.when(n % 17 != 0, F.array(F.lit(1.0))).alias("embedding"), F.when(n % 31 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"), F.when(n % 10 != 0, n - n % 10).alias("parent_chunk_id"))
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card_id"), (F.col("c_acctbal") > 0).alias("is_live"))
    actions = table(spark, sf_dir, "orders").select(F.lit("call_card").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "F", "approve").otherwise("reject").alias("action"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("action_id"))
    return integrity.live_invariants(docs, chunks, cards, actions)


LIVE_SQL = """WITH s AS (SELECT source AS doc_id, max(n_chars) % 7 <> 0 AS good FROM documents GROUP BY source),
c AS (SELECT doc_id AS id, source, doc_id % 29 % 2 + 1 - doc_id % 2 * (doc_id % 29 % 2) AS version, doc_id % 3 <> 0 AS live, doc_id % 10 = 0 AS parent, doc_id % 17 <> 0 AS embedded, doc_id % 31 = 0 AS gone FROM documents),
a AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1),
n AS (SELECT 'live chunks that should not be live' AS "check", count(*) AS value FROM c JOIN s ON source = s.doc_id WHERE live AND (NOT good OR version <> 1 OR NOT embedded OR gone)
UNION ALL SELECT 'parent chunks that are live or embedded', count(*) FROM c WHERE parent AND (live OR embedded)
UNION ALL SELECT 'children whose parent is missing or of another document', count(*) FROM c x WHERE NOT parent AND NOT EXISTS (SELECT 1 FROM c y WHERE y.id = x.id - x.id % 10 AND y.source = x.source)
UNION ALL SELECT 'live cards without approval', count(*) FROM customer LEFT JOIN a ON o_custkey = c_custkey WHERE c_acctbal > 0 AND coalesce(last, '') <> 'F')
SELECT "check", value::BIGINT AS value, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n"""


def scraped_rules(spark, sf_dir):
    """Orders as scraped rows of their customers as vehicles."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("entry_id"), F.col("o_custkey").alias("vehicle"), F.when(F.col("o_orderstatus") == "F", "12v").when(F.col("o_orderstatus") == "O", "ignition").otherwise("other").alias("circuit"), (k % 2).alias("ordinal"), F.concat("o_orderpriority", F.when(k % 23 == 0, " near SRS unit").otherwise("")).alias("cell_raw"),
        F.element_at(F.array(F.lit("Red/black"), F.lit("blu"), F.lit("green")), (k % 3 + 1).cast("int")).alias("colour"), F.lit(4).alias("connector_pins"), (k % 6).cast("int").alias("pin"), (F.col("o_totalprice") / 500000).alias("confidence"),
    )
    words = spark.sql("SELECT explode(array('red', 'black', 'green')) AS word")
    out = integrity.scraped_rules(rows, words, 0.1)
    return out.select("entry_id", F.array_join(F.sort_array(F.map_keys("notes")), ",").alias("rules"), F.col("notes")["W4"].alias("w4"), "state")


SCRAPED_SQL = """WITH r AS (SELECT o_orderkey AS k, o_custkey AS v, CASE o_orderstatus WHEN 'F' THEN '12v' WHEN 'O' THEN 'ignition' ELSE 'other' END AS c, lower(o_orderpriority || CASE WHEN o_orderkey % 23 = 0 THEN ' near SRS unit' ELSE '' END) AS t, o_totalprice / 500000 AS f FROM orders),
w AS (SELECT k, k % 23 = 0 AS w1, c <> 'other' AND count(DISTINCT c) FILTER (c <> 'other') OVER (PARTITION BY v, t) = 2 AS w2, k % 6 > 4 AS w3, k % 3 = 1 AS w4, f < 0.1 AS w5, min(t) OVER (PARTITION BY v, c, k % 2) <> max(t) OVER (PARTITION BY v, c, k % 2) AS w6 FROM r)
SELECT k AS entry_id, concat_ws(',', CASE WHEN w1 THEN 'W1' END, CASE WHEN w2 THEN 'W2' END, CASE WHEN w3 THEN 'W3' END, CASE WHEN w4 THEN 'W4' END, CASE WHEN w5 THEN 'W5' END, CASE WHEN w6 THEN 'W6' END) AS rules, CASE WHEN w4 THEN 'blu' END AS w4,
  CASE WHEN w1 OR w3 OR w6 THEN 'quarantined' WHEN w2 OR w4 OR w5 THEN 'flagged' ELSE 'ok' END AS state FROM w"""


def agreement(spark, sf_dir):
    """What customers' first and last orders say of their status, for all customers."""
    o = table(spark, sf_dir, "orders")
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    ours = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.concat(F.lit(" "), "o_orderstatus").alias("v"))
    theirs = o.where("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("k"), F.lower("o_orderstatus").alias("v"))
    return integrity.agreement(every, ours, theirs, ["k"], "v")


AGREEMENT_SQL = """WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) FILTER (o_orderkey % 3 = 0) AS x, list(DISTINCT o_orderstatus) FILTER (o_orderkey % 3 = 1) AS y FROM orders GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN x IS NULL AND y IS NULL THEN 'neither' WHEN y IS NULL THEN 'only ours' WHEN x IS NULL THEN 'only theirs' WHEN list_has_any(x, y) THEN 'agree' ELSE 'disagree' END AS bucket FROM customer LEFT JOIN a ON k = c_custkey"""


def version_order(spark, sf_dir):
    """Parts by versions made of their numbers, of which the highest of each brand counts as numbers do, not as texts."""
    v = F.concat_ws(".", "p_size", (F.col("p_partkey") % 13).cast("string"), F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("v"), v, F.when(F.col("p_partkey") % 2 == 0, "-beta").otherwise("")).alias("version"))
    return parts.groupBy("p_brand").agg(F.max_by("version", integrity.version_parts(F.col("version"))).alias("newest"))


VERSION_SQL = "SELECT p_brand, arg_max('v' || p_size || '.' || p_partkey % 13 || '.' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '-beta' ELSE '' END, (p_size, p_partkey % 13, p_partkey)) AS newest FROM part GROUP BY p_brand"


def admission_faq(spark, sf_dir):
    """Gates of growing strictness, then what a resolved question lets in."""
    s = table(spark, sf_dir, "supplier")
    matches = s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 20000).alias("similarity"), F.when(F.col("s_suppkey") < 0, 1).alias("lexical_rank"))
    gates = spark.sql("SELECT * FROM VALUES ('open', 0.1D, false), ('strict', 0.99D, false) AS g(gate, floor, has_code)")
    refused = r.admission(matches, gates)
    resolved = s.select((F.col("s_suppkey") / (F.col("s_suppkey") + 1)).alias("similarity")).withColumn("strong", F.col("similarity") >= 0.85)
    return r.admission_with_faq(refused, resolved).unionByName(r.admission_with_faq(refused.where("gate = 'strict'"), resolved.where("similarity < 0.5")).withColumn("gate", F.lit("weak")))


ADMISSION_SQL = """WITH m AS (SELECT max(s_acctbal / 20000) AS t, max(s_suppkey / (s_suppkey + 1)::DOUBLE) AS f FROM supplier)
SELECT 'open' AS gate, true AS admit, 'similarity' AS reason, t AS top_similarity FROM m UNION ALL SELECT 'strict', true, 'faq', f FROM m UNION ALL SELECT 'weak', false, 'below_threshold', t FROM m"""


def questions_with_topic(spark, sf_dir):
    """Users' questions as they are searched: one that leans on the talk has the last question before it."""
    c = table(spark, sf_dir, "conversations")
    out = with_topic(c, "conv_id", "turn", follow_up(F.col("text"), ["and", "so", "but"], ["it", "that", "this"]))
    picked = r.with_clarification(F.col("asked"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" model "), F.col("conv_id").cast("string"), F.lit(" "))), F.col("conv_id") % 5 == 0)
    return out.select("conv_id", "turn", F.md5("asked").alias("asked_md5"), F.md5(picked).alias("picked_md5"))


TOPIC_SQL = r"""WITH l AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM conversations),
a AS (SELECT conv_id, turn, text, CASE WHEN last IS NOT NULL AND NOT contains(text, last) AND (len(regexp_extract_all(lower(trim(text)), '[^ \n\t]+')) <= 6
  OR coalesce(regexp_extract_all(lower(trim(text)), '[^ \n\t]+')[1] IN ('and', 'so', 'but'), false) OR list_has_any(regexp_extract_all(lower(trim(text)), '[a-z0-9]+'), ['it', 'that', 'this'])) THEN last || ' ' || text ELSE text END AS asked FROM l WHERE role = 'user')
SELECT conv_id, turn, md5(asked) AS asked_md5, md5(CASE WHEN turn % 4 = 0 AND conv_id % 5 <> 0 THEN trim(asked) || ' (model ' || conv_id || ')' ELSE asked END) AS picked_md5 FROM a"""


def logged_turns(spark, sf_dir):
    """A log of conversations' early turns to which all turns come again."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 5, "0")).alias("turn_id"), "turn", F.md5("text").alias("text"))
    log = c.where("turn <= 1").select("session_id", "turn_id", (F.col("turn") + 1).alias("seq"), "text")
    again = c.select("session_id", "turn_id", "text")
    return log_turns(log, again.unionByName(again))


LOG_SQL = "SELECT conv_id AS session_id, conv_id || '-' || lpad(turn::VARCHAR, 5, '0') AS turn_id, CASE WHEN turn <= 1 THEN turn + 1 ELSE coalesce(max(turn + 1) FILTER (turn <= 1) OVER (PARTITION BY conv_id), 0) + count(*) FILTER (turn > 1) OVER (PARTITION BY conv_id ORDER BY turn) END AS seq, md5(text) AS text FROM conversations"


def job_failures(spark, sf_dir):
    """Orders as jobs that failed: those that may run again wait, and never longer than chance may add."""
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 9 == 0, "cancelled").otherwise("running").alias("status"), (k % 4 + 1).cast("int").alias("attempts"), F.lit(None).cast("timestamp").alias("run_at"), F.lit(None).cast("string").alias("last_error"), F.repeat("o_orderpriority", 200).alias("error"))
    now = F.lit("2024-02-01").cast("timestamp")
    out = fail(jobs, now, F.col("job_id") % 5 != 0)
    wait = F.unix_millis("run_at") - F.unix_millis(now)
    base = F.least(F.lit(900), F.lit(30) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long") * 1000
    return out.select("job_id", "status", F.length("last_error").cast("long").alias("chars"), F.coalesce(wait.between(base, base * 1.3 + 1), F.lit(True)).alias("in_time"), F.col("run_at").isNotNull().alias("waits"))


FAILURES_SQL = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 9 = 0 THEN 'cancelled' WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 9 <> 0 THEN least(1000, 200 * length(o_orderpriority)) END::BIGINT AS chars, true AS in_time, o_orderkey % 9 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 + 1 < 3 AS waits FROM orders"""


def cancelled_jobs(spark, sf_dir):
    """Orders as jobs of their customers, of whom some leave: what each was before it was cancelled."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"))
    return cancel(jobs, table(spark, sf_dir, "customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("source"))).select("job_id", "status", "was")


CANCEL_SQL = """WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000) AND o_orderstatus IN ('O', 'P') AS hit FROM orders)
SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN status END AS was FROM j"""


def cleared_versions(spark, sf_dir):
    """Chunks without the unpublished rows of one version of a source."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), (F.col("doc_id") % 2 + 1).cast("int").alias("version"), F.when(F.col("n_chars") % 3 > 0, F.col("n_chars") % 3 == 1).alias("is_live"))
    return p.clear_unpublished(d, "src1", 2).select("chunk_id", "version")


CLEARED_SQL = "SELECT doc_id AS chunk_id, (doc_id % 2 + 1)::INT AS version FROM documents WHERE NOT (source = 'src1' AND doc_id % 2 = 1 AND n_chars % 3 = 2)"


def waiting_chunks(spark, sf_dir):
    """Chunks without a vector by document and page; those without a page count with page 1."""
    d = table(spark, sf_dir, "documents")
    return wait_for_vectors(d.select(F.col("source").alias("doc_id"), F.when(F.col("n_chars") > 500, F.floor(F.col("n_chars") / 1000).cast("int")).alias("page"), F.when(F.col("lang") == "en", F.array(F.lit(1.0))).alias("embedding")))


WAITING_SQL = "SELECT source AS doc_id, coalesce(CASE WHEN n_chars > 500 THEN floor(n_chars / 1000)::INT END, 1) AS page, count(*)::BIGINT AS waiting FROM documents WHERE lang <> 'en' GROUP BY ALL"


def wire_circuits(spark, sf_dir):
    """Lines of orders as wires: their circuits, and each order's flags of what was found, and with a photo."""
    line = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in ("Constant +12 Volts (2)", "Ignition (1)", "Ignition Interrupt", "constant 12v", "Starter")])
    wires = line.select(F.col("l_orderkey").alias("vehicle"), F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int")).alias("function"), F.when(F.col("l_suppkey") % 2 == 0, "p").alias("photo"))
    kinds = wires.groupBy("vehicle").agg(F.count(F.when(circuit(F.col("function")) == "12v", 1)).alias("power"), F.count(F.when(circuit(F.col("function")) == "ignition", 1)).alias("ignition"))
    return crawl.circuit_flags(wires).join(kinds, "vehicle")


CIRCUIT_SQL = """SELECT l_orderkey AS vehicle, bool_or(l_partkey % 5 IN (0, 3)) AS found_power, bool_or(l_partkey % 5 IN (0, 3) AND l_suppkey % 2 = 0) AS photo_power, bool_or(l_partkey % 5 = 1) AS found_ignition, bool_or(l_partkey % 5 = 1 AND l_suppkey % 2 = 0) AS photo_ignition,
  count(*) FILTER (l_partkey % 5 IN (0, 3))::BIGINT AS power, count(*) FILTER (l_partkey % 5 = 1)::BIGINT AS ignition FROM lineitem GROUP BY l_orderkey"""


def image_tiles(spark, sf_dir):
    """Parts as images by their sizes and prices."""
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 60 + 300).alias("width"), F.floor("p_retailprice").cast("int").alias("height"))
    return paging.tiles(images)


TILES_SQL = """WITH i AS (SELECT p_partkey AS image_id, (p_size * 60 + 300)::BIGINT AS w, floor(p_retailprice)::BIGINT AS h FROM part),
t AS (SELECT *, ceil(w / 2.0::DOUBLE * 1.08::DOUBLE)::BIGINT AS tw, ceil(h / 2.0::DOUBLE * 1.08::DOUBLE)::BIGINT AS th FROM i WHERE least(w, h) >= 1000)
SELECT image_id, 0::INT AS ord, 'whole page' AS label, 0::BIGINT AS x, 0::BIGINT AS y, w AS width, h AS height FROM i
UNION ALL SELECT image_id, (r * 2 + c + 1)::INT, 'zoomed ' || ['top', 'bottom'][r + 1] || '-' || ['left', 'right'][c + 1] || ' quarter', (w - tw) * c, (h - th) * r, tw, th FROM t, (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c)"""


def parallel_rows(spark, sf_dir):
    """Orders' lines as parallel arrays, of which one is shorter, back to rows with their places."""
    line = table(spark, sf_dir, "lineitem")
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    held = line.groupBy("l_orderkey").agg(order.alias("o")).select("l_orderkey", F.col("o.l_partkey").alias("part"), F.slice("o.l_suppkey", F.lit(1), F.greatest(F.size("o") - 1, F.lit(0))).alias("supplier"))
    return paging.rows_of(held, ["part", "supplier"], "place")


PARALLEL_SQL = """WITH n AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, place::INT AS place, l_partkey AS part, CASE WHEN place < n THEN l_suppkey END AS supplier FROM n"""


def displayed_texts(spark, sf_dir):
    """Lines of orders as texts on pages, of which every second is stored turned by 90 degrees."""
    line, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    turned, at_x, at_y = k % 2 == 1, F.col("l_partkey") % 500 * 1.0, F.col("l_suppkey") % 700 * 1.0
    up = F.col("l_linenumber") % 3 == 0
    one, none = F.lit(1.0), F.lit(0.0)
    matrix = {"a": F.when(turned != up, none).otherwise(one * 9), "b": F.when(turned != up, one * 9).otherwise(none), "c": F.when(turned != up, one * -9).otherwise(none), "d": F.when(turned != up, none).otherwise(one * 9), "e": at_x, "f": at_y}
    page = {"va": F.when(turned, none).otherwise(one), "vb": F.when(turned, one).otherwise(none), "vc": F.when(turned, one).otherwise(none), "vd": F.when(turned, none).otherwise(-one), "ve": none, "vf": F.when(turned, none).otherwise(F.lit(800.0)), "page_height": F.when(turned, F.lit(600.0)).otherwise(F.lit(800.0))}
    items = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("\x00"), "l_returnflag")).when(F.col("l_partkey") % 11 == 0, "  ").otherwise(F.col("l_returnflag")).alias("str"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).alias("w"), F.when(F.col("l_partkey") % 3 == 0, 0.0).otherwise(12.0).alias("h"), *[v.alias(c) for c, v in {**matrix, **page}.items()])
    return displayed(items).select("l_orderkey", "l_linenumber", "str", "x", "y", "width", "size")


DISPLAYED_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN '•' || l_returnflag ELSE l_returnflag END AS str,
  CASE WHEN l_orderkey % 2 = 1 THEN l_suppkey % 700 * 1.0::DOUBLE ELSE l_partkey % 500 * 1.0::DOUBLE END AS x, CASE WHEN l_orderkey % 2 = 1 THEN 600 - l_partkey % 500 * 1.0::DOUBLE ELSE l_suppkey % 700 * 1.0::DOUBLE END AS y,
  CASE WHEN l_partkey % 2 = 0 THEN l_quantity ELSE 0 END::DOUBLE AS width, CASE WHEN l_partkey % 3 = 0 THEN 9.0 ELSE 12.0 END::DOUBLE AS size
FROM lineitem WHERE l_linenumber % 3 <> 0 AND (l_partkey % 7 = 0 OR l_partkey % 11 <> 0)"""

PAIRS = {
    "documents_page": (documents_page, PAGE_SQL),
    "live_invariants": (live_invariants, LIVE_SQL),
    "scraped_rules": (scraped_rules, SCRAPED_SQL),
    "agreement": (agreement, AGREEMENT_SQL),
    "version_order": (version_order, VERSION_SQL),
    "admission_faq": (admission_faq, ADMISSION_SQL),
    "questions_with_topic": (questions_with_topic, TOPIC_SQL),
    "logged_turns": (logged_turns, LOG_SQL),
    "job_failures": (job_failures, FAILURES_SQL),
    "cancelled_jobs": (cancelled_jobs, CANCEL_SQL),
    "cleared_versions": (cleared_versions, CLEARED_SQL),
    "waiting_chunks": (waiting_chunks, WAITING_SQL),
    "wire_circuits": (wire_circuits, CIRCUIT_SQL),
    "image_tiles": (image_tiles, TILES_SQL),
    "parallel_rows": (parallel_rows, PARALLEL_SQL),
    "displayed_texts": (displayed_texts, DISPLAYED_SQL),
}
