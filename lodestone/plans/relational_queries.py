"""Relational work: rules, joins, windows, merges and states over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import merging as m
from lodestone.operators.validation import previous, runs
from lodestone.plans.retrieval_queries import table


def drag_fill_runs(spark, sf_dir):
    """Stretches of three or more days in a row on which a user was active."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    days = days.withColumn("before", previous("day", ["user_id"], "day"))
    found = runs(days, ["user_id"], "day", F.datediff("day", "before") == 1).where("run_length >= 3")
    return found.groupBy("user_id", "run").agg(F.count("*").alias("days"), F.min("day").cast("string").alias("first_day")).select("user_id", "days", "first_day")


DRAG_SQL = """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS grp FROM d)
SELECT user_id, count(*)::BIGINT AS days, min(day)::VARCHAR AS first_day FROM g GROUP BY user_id, grp HAVING count(*) >= 3"""


def queue_stats_zero_filled(spark, sf_dir):
    domain = spark.sql("SELECT * FROM VALUES ('F'), ('O'), ('P'), ('X') AS d(status)")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return domain.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


QUEUE_SQL = "SELECT status, count(o_orderkey)::BIGINT AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY status"


def count_by_make(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand")


MAKE_SQL = "SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY p_brand ORDER BY p_brand"


def docs_page_with_counts(spark, sf_dir):
    """The second page of ten customers by name, with their orders by status: counts are joined to the page alone."""
    page = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("customer"))).orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(10)
    orders = table(spark, sf_dir, "orders").join(F.broadcast(page.select("c_custkey")), F.col("o_custkey") == F.col("c_custkey"))
    n = orders.groupBy("c_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"), F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("open"))
    return page.join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("open", F.lit(0)).alias("open"))


PAGE_SQL = """SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS open
FROM (SELECT * FROM customer WHERE lower(c_name) LIKE '%customer%' ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10)"""


def latest_review(spark, sf_dir):
    """Each customer with the latest order, if any."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", F.coalesce("status", F.lit("none")).alias("status"))


LATEST_SQL = """SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN
  (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey"""


def distinct_on_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("versions"))


HASH_SQL = "SELECT sha256(text) AS hash, max(doc_id) AS doc_id, count(*)::BIGINT AS versions FROM documents GROUP BY 1"


def report_chain(spark, sf_dir):
    """Customers, their orders and the lines of those, none of which need exist."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    out = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left").join(line, "o_orderkey", "left")
    return out.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.count("l_quantity").alias("lines"))


CHAIN_SQL = """SELECT c_mktsegment, count(DISTINCT c_custkey)::BIGINT AS customers, count(DISTINCT o_orderkey)::BIGINT AS orders, count(l_quantity)::BIGINT AS lines
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment"""


def report_pivot(spark, sf_dir):
    """Finished and open orders of each customer side by side; a customer without any has one row."""
    def listed(state, name):
        o = table(spark, sf_dir, "orders").where(state).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias(name))
        return o.withColumn("ordinal", F.row_number().over(Window.partitionBy("c_custkey").orderBy(name)))

    both = listed("o_orderstatus = 'F'", "done").join(listed("o_orderstatus <> 'F'", "open"), ["c_custkey", "ordinal"], "full")
    out = table(spark, sf_dir, "customer").select("c_custkey").join(both, "c_custkey", "left")
    label = F.when(F.col("done").isNotNull(), "Found").when(F.coalesce("ordinal", F.lit(1)) == 1, "Not found on site").otherwise("")
    return out.select("c_custkey", F.coalesce("ordinal", F.lit(1)).alias("ordinal"), "done", "open", label.alias("label"))


PIVOT_SQL = """WITH f AS (SELECT o_custkey, o_orderkey AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n FROM orders WHERE o_orderstatus = 'F'),
o AS (SELECT o_custkey, o_orderkey AS open, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT coalesce(f.o_custkey, o.o_custkey) AS k, coalesce(f.n, o.n) AS n, done, open FROM f FULL JOIN o ON f.o_custkey = o.o_custkey AND f.n = o.n)
SELECT c_custkey, coalesce(n, 1)::INT AS ordinal, done, open, CASE WHEN done IS NOT NULL THEN 'Found' WHEN coalesce(n, 1) = 1 THEN 'Not found on site' ELSE '' END AS label
FROM customer LEFT JOIN b ON k = c_custkey"""


def figure_or_join(spark, sf_dir):
    """References that name a text by hash, or else a source: two equi-joins instead of one with OR."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"), "source")
    refs = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).alias("ref_hash"), F.col("source").alias("ref_source"))
    by_hash = refs.where("ref_hash IS NOT NULL").join(d.groupBy("hash").agg(F.min("doc_id").alias("hit")), F.col("ref_hash") == F.col("hash")).select("doc_id", "hit")
    by_source = refs.where("ref_hash IS NULL").join(d.groupBy("source").agg(F.min("doc_id").alias("hit")), F.col("ref_source") == F.col("source")).select("doc_id", "hit")
    return by_hash.unionByName(by_source)


FIGURE_SQL = """WITH h AS (SELECT md5(text) AS k, min(doc_id) AS hit FROM documents GROUP BY 1), s AS (SELECT source AS k, min(doc_id) AS hit FROM documents GROUP BY 1)
SELECT doc_id, hit FROM documents JOIN h ON md5(text) = k WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, hit FROM documents JOIN s ON source = k WHERE doc_id % 2 <> 0"""


def role_matrix(spark, sf_dir):
    grants = spark.sql("SELECT * FROM VALUES ('AFRICA', 'read'), ('ASIA', 'read'), ('ASIA', 'write'), ('NOWHERE', 'read') AS g(role, permission)")
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return grants.join(region, F.col("role") == F.col("r_name")).join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select("role", "permission", "n_name")


ROLE_SQL = """SELECT role, permission, n_name FROM (VALUES ('AFRICA', 'read'), ('ASIA', 'read'), ('ASIA', 'write'), ('NOWHERE', 'read')) g(role, permission)
JOIN region ON r_name = role JOIN nation ON n_regionkey = r_regionkey"""


def _halves(spark, sf_dir):
    """All orders, and a sheet of news with all of them: changed prices, and new keys where an order is finished."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey"))
    new = old.withColumns({"o_orderkey": key, "o_totalprice": F.round(F.col("o_totalprice") * 2, 2), "o_orderpriority": F.when(F.col("o_orderpriority") != "5-LOW", "new").otherwise("5-LOW")})
    return old, new


HALVES = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
b AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice, CASE WHEN o_orderpriority <> '5-LOW' THEN 'new' ELSE '5-LOW' END AS o_orderpriority FROM orders)"""


def upsert_preserve(spark, sf_dir):
    """New rows win, but a priority that is there stays while the status is the same."""
    old, new = _halves(spark, sf_dir)
    keep = {"o_orderpriority": lambda a, b: F.coalesce(a, b)}
    return m.upsert(old, new, ["o_orderkey"], keep)


def insert_ignore(spark, sf_dir):
    return m.insert_ignore(*_halves(spark, sf_dir), ["o_orderkey"])


def replace_children(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return m.replace_children(old, new, "o_orderpriority")


def patch_columns(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    changes = new.select("o_orderkey", (F.col("o_orderstatus") == "O").alias("set_o_orderstatus"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit(True).alias("set_o_totalprice"), "o_totalprice")
    return m.patch(old, changes, "o_orderkey", ["o_orderstatus", "o_totalprice"])


UPSERT_SQL = f"""WITH {HALVES} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus,
  coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey"""
IGNORE_SQL = f"WITH {HALVES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)"
CHILDREN_SQL = f"WITH {HALVES} SELECT * FROM a WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM b) UNION ALL SELECT * FROM b"
PATCH_SQL = f"""WITH {HALVES} SELECT a.o_orderkey, CASE WHEN b.o_orderstatus = 'O' THEN NULL ELSE a.o_orderstatus END AS o_orderstatus,
  coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice, a.o_orderpriority FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey"""


def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


DIFFERENCE_SQL = "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"


def weighted_mode(spark, sf_dir):
    """The language with most characters in each source, the first by name of equals."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("w"))
    return d.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("w"), "lang")).alias("mode"), F.max("w").alias("weight"))


MODE_SQL = "SELECT source, lang AS mode, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY source, lang QUALIFY row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) = 1"


def upper_median(spark, sf_dir):
    """The upper middle length of each source, by rank: no source's lengths meet in one list."""
    d = table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("source"))
    upto = F.sum("c").over(Window.partitionBy("source").orderBy("n_chars"))
    ranked = d.withColumns({"total": total, "upto": upto})
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("source").agg(F.min("n_chars").alias("median"))


MEDIAN_SQL = "SELECT source, list_sort(list(n_chars))[floor(count(*) / 2)::INT + 1] AS median FROM documents GROUP BY source"


def bold_share(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    bold = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    return line.groupBy("l_orderkey").agg(F.round(F.coalesce(bold / F.nullif(F.sum("l_quantity"), F.lit(0)), F.lit(1.0)), 6).cast("double").alias("share"))


BOLD_SQL = "SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE / nullif(sum(l_quantity), 0), 1), 6)::DOUBLE AS share FROM lineitem GROUP BY l_orderkey"


def run_demotion(spark, sf_dir):
    """Runs of three or more events of one kind in a user's time."""
    e = table(spark, sf_dir, "events").withColumn("place", F.struct("ts", "event_id"))
    e = e.withColumn("before", previous("event_type", ["user_id"], "place"))
    found = runs(e, ["user_id"], "place", F.col("event_type") == F.col("before")).where("run_length >= 3")
    return found.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least")).select("user_id", "event_type", "n", "least")


RUN_SQL = """WITH b AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT user_id, event_type, count(*)::BIGINT AS n, min(event_id) AS least FROM g GROUP BY user_id, run, event_type HAVING count(*) >= 3"""


def section_carry_forward(spark, sf_dir):
    """The last purchase before or at each event of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("section"))


CARRY_SQL = "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events"


def vector_reuse_split(spark, sf_dir):
    """Texts whose hash an earlier one has reuse its vector; the others need one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    known = d.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return d.join(known, "hash").select("doc_id", F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("reused"))


REUSE_SQL = "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS reused FROM documents"


def stale_leases(spark, sf_dir):
    """Leases over 15 minutes old at the time of the last event: back to pending, or failed for good."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    old = e.join(F.broadcast(now), F.col("ts") < F.col("now") - F.expr("INTERVAL 15 MINUTES"))
    return old.select("event_id", F.when(F.col("user_id") % 4 == 3, "failed").otherwise("pending").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


STALE_SQL = """SELECT CASE WHEN user_id % 4 = 3 THEN 'failed' ELSE 'pending' END AS status, count(*)::BIGINT AS n
FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTES GROUP BY 1"""


def json_extract_group(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


JSON_SQL = "SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1"


def invariants(spark, sf_dir):
    """One row for each rule that tables must keep."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    checks = [
        ("order without customer", o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("line without order", line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("repeated line number", line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
    ]
    out = None
    for name, broken in checks:
        row = broken.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


INVARIANT_SQL = """WITH c AS (SELECT 'order without customer' AS "check", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'repeated line number', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
SELECT "check", n::BIGINT AS n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""


def reconcile(spark, sf_dir):
    """Customers and suppliers by nation: both, one or neither."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").alias("c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.count("*").alias("s"))
    bucket = F.when(F.col("s").isNull(), "only customers").when(F.col("c").isNull(), "only suppliers").otherwise("both")
    return c.join(s, "n", "full").select("n", bucket.alias("bucket"))


RECONCILE_SQL = """SELECT coalesce(a.n, b.n) AS n, CASE WHEN b.n IS NULL THEN 'only customers' WHEN a.n IS NULL THEN 'only suppliers' ELSE 'both' END AS bucket
FROM (SELECT DISTINCT c_nationkey AS n FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS n FROM supplier) b ON a.n = b.n"""


PAIRS = {
    "drag_fill_runs": (drag_fill_runs, DRAG_SQL),
    "queue_stats_zero_filled": (queue_stats_zero_filled, QUEUE_SQL),
    "count_by_make": (count_by_make, MAKE_SQL),
    "docs_page_with_counts": (docs_page_with_counts, PAGE_SQL),
    "latest_review": (latest_review, LATEST_SQL),
    "distinct_on_hash": (distinct_on_hash, HASH_SQL),
    "report_chain": (report_chain, CHAIN_SQL),
    "report_pivot": (report_pivot, PIVOT_SQL),
    "figure_or_join": (figure_or_join, FIGURE_SQL),
    "role_matrix": (role_matrix, ROLE_SQL),
    "upsert_preserve": (upsert_preserve, UPSERT_SQL),
    "insert_ignore": (insert_ignore, IGNORE_SQL),
    "replace_children": (replace_children, CHILDREN_SQL),
    "patch_columns": (patch_columns, PATCH_SQL),
    "set_difference": (set_difference, DIFFERENCE_SQL),
    "weighted_mode": (weighted_mode, MODE_SQL),
    "upper_median": (upper_median, MEDIAN_SQL),
    "bold_share": (bold_share, BOLD_SQL),
    "run_demotion": (run_demotion, RUN_SQL),
    "section_carry_forward": (section_carry_forward, CARRY_SQL),
    "vector_reuse_split": (vector_reuse_split, REUSE_SQL),
    "stale_leases": (stale_leases, STALE_SQL),
    "json_extract_group": (json_extract_group, JSON_SQL),
    "invariants": (invariants, INVARIANT_SQL),
    "reconcile": (reconcile, RECONCILE_SQL),
}
