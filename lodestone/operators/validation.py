"""Rules over sheet rows, and exact look-up with masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, continues: Column) -> DataFrame:
    """Gaps and islands: ``run`` numbers the stretches of each key in which every row continues the one
    before (``continues`` may use lag through ``previous()``), ``run_length`` their rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_break", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_break").over(w))
    return out.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "run"))).drop("_break")


def previous(column: str, keys: list[str], order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(order))


def stem(circuit: Column) -> Column:
    """A cell's text without its trailing pin."""
    return F.regexp_replace(F.lower(circuit), r",?\s*pin\s*[0-9]+\s*$", "")


#: The rules that :func:`validate` owns, and what its report calls them. Fixed values.
RULES = {
    "V1": "V1 pin exceeds connector pin count (quarantine)",
    "V2": "V2 drag-fill pattern (flag)",
    "V4": "V4 identical 12v and ignition (flag)",
    "V5": "V5 conflicting duplicates (quarantine)",
}


def validate(entries: DataFrame, org: str, sheet_version: int) -> tuple[DataFrame, DataFrame]:
    """``entries`` with notes and state of one sheet version, and the report (rule, affected).

    Columns: entry_id, org_id, sheet_version, deleted_at, year, make, model, start_type, circuit,
    cell_kind, cell_raw, connector_pins, pin, validation_notes (map). V1: pin above the
    connector's pins. V2: inline cells of one vehicle, circuit and stem whose pin and year both
    rise by one, over three rows or more; equal years are one step. V4: an inline cell's text on
    another circuit of the vehicle. V5: another text for the same vehicle and circuit. V1 and V5
    quarantine, any other note flags; notes of other rules stay. Rows of other versions, other
    organisations and deleted ones are returned as they are.

    Each rule is a window; none joins the sheet with itself. Rows are dealt once, by make, model and start
    type, which all windows have among their keys.
    """
    mine = (F.col("org_id") == org) & (F.col("sheet_version") == sheet_version) & F.col("deleted_at").isNull()
    start = F.coalesce("start_type", F.lit(""))
    inline = mine & (F.col("cell_kind") == "inline")
    v1 = mine & (F.col("pin") > F.col("connector_pins"))
    text = F.lower("cell_raw")
    own = {"_make": F.lower("make"), "_model": F.lower("model"), "_start": start, "_text": text, "_stem": stem(F.col("cell_raw"))}
    own |= {"_in": F.coalesce(mine, F.lit(False)), "_steps": F.coalesce(inline & F.col("pin").isNotNull(), F.lit(False)), "_inline": F.coalesce(inline, F.lit(False))}
    # A number for all three, as constants among keys are dropped from a window and not from a deal.
    e = entries.withColumns(own).withColumn("_vehicle", F.xxhash64("_make", "_model", "_start")).repartition("_vehicle")
    sheet = ["_vehicle", "org_id", "sheet_version", "_make", "_model", "_start"]

    # V2: rows that take no part are a partition of their own.
    cell_keys = ["_steps", *sheet, "make", "model", "circuit", "_stem"]
    cell = Window.partitionBy(*cell_keys)
    by_row, by_year = cell.orderBy("year", "entry_id"), cell.orderBy("year")
    goes_on = (F.col("pin") - F.lag("pin").over(by_row) == 1) & (F.col("year") - F.lag("year").over(by_row) == 1)
    e = e.withColumn("_break", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_break").over(by_year))
    e = e.withColumn("_length", F.when(F.col("_steps"), F.count("*").over(Window.partitionBy(*cell_keys, "_run"))))

    same_text = Window.partitionBy("_inline", *sheet, "year", "_text")
    slot = Window.partitionBy("_in", *sheet, "year", "circuit")
    text = F.col("_text")
    e = e.withColumns({"_v4": F.min("circuit").over(same_text) != F.max("circuit").over(same_text), "_v5": F.min(text).over(slot) != F.max(text).over(slot)})
    notes = {
        "V1": (v1, F.format_string("pin %d on a %d-pin connector", "pin", "connector_pins")),
        "V2": (F.col("_length") >= 3, F.format_string("pin rises by 1 each model year across %d consecutive years on the same connector", "_length")),
        "V4": (F.col("_inline") & text.isNotNull() & F.col("_v4"), F.lit("12v and ignition cells are identical for this vehicle")),
        "V5": (F.col("_in") & text.isNotNull() & F.col("_v5"), F.lit("the same vehicle and circuit appear more than once with different values")),
    }
    found = F.filter(F.array(*[F.when(hit, F.struct(F.lit(rule).alias("k"), note.alias("v"))) for rule, (hit, note) in notes.items()]), lambda x: x.isNotNull())
    before = F.coalesce("validation_notes", F.create_map().cast("map<string,string>"))
    kept = F.map_concat(F.map_filter(before, lambda k, _: ~k.isin(*RULES)), F.map_from_entries(found))
    state = F.when(F.map_contains_key("_notes", "V1") | F.map_contains_key("_notes", "V5"), "quarantined").when(F.size("_notes") > 0, "flagged").otherwise("ok")
    e = e.withColumn("_notes", kept).withColumn("_state", state)
    columns = [c for c in entries.columns if c not in ("validation_notes", "validation_state")]
    old = F.col("validation_state") if "validation_state" in entries.columns else F.lit(None).cast("string")
    out = e.select(*columns, F.when(F.col("_in"), F.col("_notes")).otherwise(F.col("validation_notes")).alias("validation_notes"), F.when(F.col("_in"), F.col("_state")).otherwise(old).alias("validation_state"))
    return out, report(out.where(mine))


def report(validated: DataFrame) -> DataFrame:
    """One row for each rule, with 0 where no row breaks it, then one for each state."""
    rules = validated.agg(*[F.count(F.when(F.map_contains_key("validation_notes", r), 1)).alias(r) for r in RULES])
    rules = rules.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(r).alias("affected")) for r, name in RULES.items()])))
    return rules.unionByName(validated.groupBy(F.concat(F.lit("state: "), "validation_state").alias("rule")).agg(F.count("*").alias("affected")))


def lookup(entries: DataFrame, make: str, model: str, year: int, circuit: str | None = None, start_type: str | None = None) -> DataFrame:
    """Live rows of just this vehicle, quarantined values masked. No row is a valid answer; never the nearest year."""
    masked = F.col("validation_state") == "quarantined"
    out = entries.where((F.lower("make") == make.lower()) & (F.lower("model") == model.lower()) & (F.col("year") == year))
    out = out.where("is_live AND deleted_at IS NULL")
    if circuit is not None:
        out = out.where(F.col("circuit") == circuit)
    if start_type is not None:
        out = out.where(F.col("start_type") == start_type)
    for c in ("cell_raw", "wire_colour", "connector_pins", "pin"):
        out = out.withColumn(c, F.when(masked, None).otherwise(F.col(c)))
    return out.orderBy(F.asc_nulls_first("start_type"), "circuit", "entry_id")
