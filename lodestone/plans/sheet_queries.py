"""Sheet rules, look-up and publication over order lines, which stand for a sheet's cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.publication import publish_sheet
from lodestone.operators.validation import lookup, validate
from lodestone.plans.retrieval_queries import table

ORG, VERSION = "o", 1


def _entries(spark, sf_dir):
    """A line is a cell of its supplier's vehicle in the year it was shipped; flags are circuits, a high tax a key start."""
    line = table(spark, sf_dir, "lineitem")
    number = F.col("l_quantity").cast("int")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", number).alias("entry_id"), F.lit(ORG).alias("org_id"), F.when(F.col("l_linestatus") == "F", VERSION).otherwise(2).alias("sheet_version"),
        F.when(F.col("l_discount") == 0.1, F.lit("2020-01-01").cast("timestamp")).alias("deleted_at"), F.year("l_shipdate").alias("year"), F.concat(F.lit("S"), "l_suppkey").alias("make"), F.lit("M").alias("model"), F.when(F.col("l_tax") > 0.05, "key").alias("start_type"),
        F.col("l_returnflag").alias("circuit"), F.when(F.col("l_discount") < 0.08, "inline").otherwise("link").alias("cell_kind"), F.concat(F.lit("BCM "), (number % 4).cast("string"), F.lit(", pin "), "l_linenumber").alias("cell_raw"), F.lit("red").alias("wire_colour"),
        F.lit(5).alias("connector_pins"), F.col("l_linenumber").alias("pin"), F.when(F.col("l_tax") == 0, F.create_map(F.lit("V6"), F.lit("low"))).alias("validation_notes"), (F.col("l_linestatus") == "F").alias("is_live"),
    )


ENTRIES = """e AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS entry_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sheet_version, l_discount = 0.1 AS deleted,
  year(l_shipdate) AS year, 'S' || l_suppkey AS make, CASE WHEN l_tax > 0.05 THEN 'key' ELSE '' END AS st, l_returnflag AS circuit, l_discount < 0.08 AS inline, 'bcm ' || (l_quantity::INT % 4) AS stem, 'bcm ' || (l_quantity::INT % 4) || ', pin ' || l_linenumber AS raw, l_linenumber AS pin, l_tax = 0 AS v6 FROM lineitem),
m AS (SELECT * FROM e WHERE sheet_version = 1 AND NOT deleted),
b AS (SELECT *, CASE WHEN pin - lag(pin) OVER w = 1 AND year - lag(year) OVER w = 1 THEN 0 ELSE 1 END AS brk FROM m WHERE inline WINDOW w AS (PARTITION BY make, st, circuit, stem ORDER BY year, entry_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY make, st, circuit, stem ORDER BY year) AS grp FROM b),
v2 AS (SELECT entry_id FROM i QUALIFY count(*) OVER (PARTITION BY make, st, circuit, stem, grp) >= 3),
v4 AS (SELECT DISTINCT a.entry_id FROM m a JOIN m o USING (make, year, st, raw) WHERE a.inline AND o.inline AND a.circuit <> o.circuit),
v5 AS (SELECT DISTINCT a.entry_id FROM m a JOIN m o USING (make, year, st, circuit) WHERE a.raw <> o.raw),
n AS (SELECT m.*, list_filter([CASE WHEN pin > 5 THEN 'V1' END, CASE WHEN entry_id IN (FROM v2) THEN 'V2' END, CASE WHEN entry_id IN (FROM v4) THEN 'V4' END, CASE WHEN entry_id IN (FROM v5) THEN 'V5' END, CASE WHEN v6 THEN 'V6' END], lambda x: x IS NOT NULL) AS notes FROM m),
s AS (SELECT *, CASE WHEN list_has_any(notes, ['V1', 'V5']) THEN 'quarantined' WHEN len(notes) > 0 THEN 'flagged' ELSE 'ok' END AS state FROM n)"""


def _validated(spark, sf_dir):
    return validate(_entries(spark, sf_dir), ORG, VERSION)


def validation_state(spark, sf_dir):
    """Every cell's notes and state; cells of the other version and deleted ones have none."""
    out = _validated(spark, sf_dir)[0]
    return out.select("entry_id", F.array_join(F.sort_array(F.map_keys("validation_notes")), ",").alias("notes"), F.col("validation_state").alias("state"))


STATE_SQL = f"""WITH {ENTRIES} SELECT entry_id, array_to_string(notes, ',') AS notes, state FROM s
UNION ALL SELECT entry_id, CASE WHEN v6 THEN 'V6' END, NULL FROM e WHERE sheet_version = 2 OR deleted"""


def validation_report(spark, sf_dir):
    return _validated(spark, sf_dir)[1]


REPORT_SQL = f"""WITH {ENTRIES}, r(k, rule) AS (VALUES ('V1', 'V1 pin exceeds connector pin count (quarantine)'), ('V2', 'V2 drag-fill pattern (flag)'), ('V4', 'V4 identical 12v and ignition (flag)'), ('V5', 'V5 conflicting duplicates (quarantine)'))
SELECT rule, (SELECT count(*) FROM s WHERE list_contains(notes, k))::BIGINT AS affected FROM r UNION ALL SELECT 'state: ' || state, count(*)::BIGINT FROM s GROUP BY state"""


def rule_hits(rule):
    def run(spark, sf_dir):
        out = _validated(spark, sf_dir)[0]
        return out.where(F.map_contains_key("validation_notes", rule)).select("entry_id", F.col("validation_notes").getItem(rule).alias("note"))

    return run


V1_SQL = f"WITH {ENTRIES} SELECT entry_id, 'pin ' || pin || ' on a 5-pin connector' AS note FROM m WHERE pin > 5"
V2_SQL = f"""WITH {ENTRIES} SELECT entry_id, 'pin rises by 1 each model year across ' || n || ' consecutive years on the same connector' AS note
FROM (SELECT entry_id, count(*) OVER (PARTITION BY make, st, circuit, stem, grp) AS n FROM i) WHERE n >= 3"""
V4_SQL = f"WITH {ENTRIES} SELECT entry_id, '12v and ignition cells are identical for this vehicle' AS note FROM v4"
V5_SQL = f"WITH {ENTRIES} SELECT entry_id, 'the same vehicle and circuit appear more than once with different values' AS note FROM v5"


def lookup_exact(spark, sf_dir):
    """One vehicle and circuit, whatever its start type."""
    return lookup(_validated(spark, sf_dir)[0], "s7", "m", 1996, circuit="A").select("entry_id", "pin", "cell_raw", "validation_state")


def lookup_masked(spark, sf_dir):
    """One vehicle's key start; quarantined values are masked, their rows stay."""
    return lookup(_validated(spark, sf_dir)[0], "S7", "M", 1996, start_type="key").select("entry_id", "circuit", "pin", "connector_pins", "validation_state")


EXACT_SQL = f"""WITH {ENTRIES} SELECT entry_id, CASE WHEN state <> 'quarantined' THEN pin END AS pin, CASE WHEN state <> 'quarantined' THEN 'BCM' || substr(raw, 4) END AS cell_raw, state AS validation_state FROM s WHERE make = 'S7' AND year = 1996 AND circuit = 'A'"""
MASKED_SQL = f"""WITH {ENTRIES} SELECT entry_id, circuit, CASE WHEN state <> 'quarantined' THEN pin END AS pin, CASE WHEN state <> 'quarantined' THEN 5 END AS connector_pins, state AS validation_state FROM s WHERE make = 'S7' AND year = 1996 AND st = 'key'"""


def sheet_swap(spark, sf_dir):
    """The second version of the sheet goes live, the first goes out."""
    out = publish_sheet(_entries(spark, sf_dir), ORG, 2, F.lit("2024-01-01").cast("timestamp"))
    return out.groupBy("sheet_version", "is_live", F.date_format("deleted_at", "yyyy").alias("deleted")).agg(F.count("*").alias("n"))


SWAP_SQL = f"""WITH {ENTRIES} SELECT sheet_version, CASE WHEN deleted THEN sheet_version = 1 ELSE sheet_version = 2 END AS is_live, CASE WHEN deleted THEN '2020' WHEN sheet_version = 1 THEN '2024' END AS deleted, count(*)::BIGINT AS n FROM e GROUP BY ALL"""

PAIRS = {
    "validation_state": (validation_state, STATE_SQL),
    "validation_report": (validation_report, REPORT_SQL),
    "v1_threshold": (rule_hits("V1"), V1_SQL),
    "v2_drag_fill": (rule_hits("V2"), V2_SQL),
    "v4_identical_pairs": (rule_hits("V4"), V4_SQL),
    "v5_conflicts": (rule_hits("V5"), V5_SQL),
    "lookup_exact": (lookup_exact, EXACT_SQL),
    "lookup_masked": (lookup_masked, MASKED_SQL),
    "sheet_swap": (sheet_swap, SWAP_SQL),
}
