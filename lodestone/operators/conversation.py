"""Conversations: history within a budget, and answers as steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters kept of a turn by role, of a history, and turns of a history. Fixed values.
TURN_CHARS, ANSWER_CHARS, HISTORY_CHARS, HISTORY_TURNS = 500, 900, 4000, 6


def history(turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text", asker: str = "user") -> DataFrame:
    """The last turns of each conversation, cut by role, as many of the newest as fit the budget in one stretch."""
    rows = turns.where(F.trim(text) != "")
    limit = F.when(F.col(role) == asker, F.lit(TURN_CHARS)).otherwise(F.lit(ANSWER_CHARS))
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    rows = rows.withColumn("said", F.substring(F.col(text), F.lit(1), limit)).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= HISTORY_TURNS)
    total = F.sum(F.length("said")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).where(F.col("total") <= HISTORY_CHARS).drop("back", "total")


def steps(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Numbered lines that start at 1 and go on by one, two or more: key, n, step, warns."""
    lines = answers.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    number = F.try_to_number(F.nullif(F.regexp_extract("line", r"^\s*([0-9]{1,4})[.)]\s+\S", 1), F.lit("")), F.lit("9999")).cast("int")
    lines = lines.select(key, "pos", number.alias("n"), F.regexp_extract("line", r"^\s*[0-9]{1,4}[.)]\s+(.*)$", 1).alias("step")).where("n IS NOT NULL")
    w = Window.partitionBy(key).orderBy("pos")
    ok = F.col("n") == F.row_number().over(w)
    whole = Window.partitionBy(key)
    lines = lines.withColumn("ok", ok).withColumns({"all_ok": F.min(F.col("ok").cast("int")).over(whole), "count": F.count("*").over(whole)})
    return lines.where((F.col("all_ok") == 1) & (F.col("count") >= 2)).select(key, "n", "step", F.col("step").rlike(r"(?i)^(warning|caution|danger)\b").alias("warns"))


#: A numbered line, a step that is a precaution, and a mark of a source. Fixed values.
NUMBERED, PRECAUTION = r"^\s*(\d{1,2})[.)]\s+(\S.*)$", r"(?i)^(warning|caution|danger|safety)\b"
SOURCE_REF = r"(?i)\s*\(\s*(?:pages?\s+[\d,\s&–-]+|section:\s*[^)]+)\)"


def without_sources(text: Column) -> Column:
    """A text without the marks of its sources, and without the blanks that they leave."""
    t = F.regexp_replace(F.regexp_replace(text, SOURCE_REF, ""), r"\s+([.,;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def procedures(answers: DataFrame, key: str, text: str = "text", sources: str | None = None) -> DataFrame:
    """Answers as steps to show: key, pos from 0, n, note, text, warns, with_sources.

    A procedure has two numbered lines or more, the first one 1, and none after its closing: an
    introduction (n 0), its steps, and a closing (n 0) that carries the sources. A line behind a step goes on
    with it until a blank line; the first line after that closes. Anything else is one block (n 1) as it was written. An
    introduction is left out if empty, a closing if it is empty and ``sources`` (an array) too. Null texts are blocks without a text.

    The lines of an answer are rows; what comes before and after is told by windows over them. They are shuffled once, and
    an answer that stays as it is is put together from them. Answers of one key, or of none, are apart; one that is repeated comes again.
    """
    cited = F.size(F.coalesce(sources, F.array())) > 0 if sources else F.lit(False)
    of = [key, "_fp"]
    held = answers.select(key, F.xxhash64(F.col(text), cited).alias("_fp"), cited.alias("_cited"), F.split(F.col(text), "\n", -1).alias("_all"))
    lines = held.select(*of, "_cited", F.size("_all").alias("_size"), F.posexplode_outer("_all").alias("_i", "_written")).repartition(*of)
    same = Window.partitionBy(*of, "_i")
    lines = lines.withColumns({"_copies": F.count("*").over(same), "_copy": F.row_number().over(same.orderBy("_size"))}).where("_copy = 1")
    line = F.when((F.col("_i") < F.col("_size") - 1) & F.endswith("_written", F.lit("\r")), F.expr("left(_written, length(_written) - 1)")).otherwise(F.col("_written"))
    lines = lines.withColumn("_line", line)
    number = F.regexp_extract("_line", NUMBERED, 1)
    whole = Window.partitionBy(*of)
    w = whole.orderBy("_i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # White space as a text's ends lose it.
    bare = F.regexp_replace("_line", r"^\s+|\s+$", "")
    lines = lines.withColumns({"_n": F.nullif(number, F.lit("")).cast("int"), "_bare": bare}).withColumn("_step", F.count("_n").over(upto))
    in_step = Window.partitionBy(*of, "_step").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    blank_before = F.coalesce(F.max((F.col("_bare") == "").cast("int")).over(in_step), F.lit(0)) == 1
    closes = (F.col("_step") > 0) & F.col("_n").isNull() & (F.col("_bare") != "") & blank_before
    lines = lines.withColumn("_closed", F.coalesce(F.max(closes.cast("int")).over(upto), F.lit(0)) == 1)
    first = F.min_by("_n", F.when(F.col("_n").isNotNull(), F.col("_i"))).over(whole)
    late = F.max((F.col("_closed") & F.col("_n").isNotNull()).cast("int")).over(whole)
    lines = lines.withColumn("_good", F.coalesce((F.count("_n").over(whole) >= 2) & (first == 1) & (late == 0), F.lit(False)))
    part = F.when(~F.col("_good"), F.lit(1)).when(F.col("_closed"), F.lit(2)).when(F.col("_step") == 0, F.lit(0)).otherwise(F.lit(1))
    said = F.when(~F.col("_good"), F.col("_written")).when(F.col("_n").isNotNull(), F.trim(F.regexp_extract("_line", NUMBERED, 2))).otherwise(F.col("_bare"))
    own = lines.withColumns({"_part": part, "_said": said}).where("NOT _good OR _part != 1 OR _said != ''")
    own = own.withColumn("_group", F.when(~F.col("_good"), 1).when(F.col("_part") == 1, F.col("_step")).otherwise(0))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_said"))), lambda x: x["_said"])
    made = own.groupBy(*of, "_good", "_part", "_group").agg(joined.alias("_lines"), F.count("_i").alias("_n_lines"), F.first("_cited").alias("_cited"), F.first("_copies").cast("int").alias("_copies"))
    as_written = F.when(F.col("_n_lines") > 0, F.array_join("_lines", "\n"))
    tidy = F.regexp_replace(F.regexp_replace(F.array_join("_lines", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    step = F.array_join("_lines", " ")
    good = F.col("_good")
    note = good & (F.col("_part") != 1)
    made = made.withColumn("_whole", F.when(~good, as_written).when(F.col("_part") == 1, step).otherwise(tidy))
    made = made.withColumns({"text": F.when(good, without_sources(F.col("_whole"))).otherwise(F.col("_whole")), "note": note})
    made = made.where("NOT note OR (_part = 0 AND _whole != '') OR (_part = 2 AND (text != '' OR _cited))")
    place = whole.orderBy("_part", "_group")
    # A procedure without a closing line still shows its sources.
    ends = good & F.col("_cited") & (F.col("_part") != 2) & F.lead("_part").over(place).isNull()
    made = made.withColumns({"pos": F.row_number().over(place) - 1, "_ends": ends})
    block = F.struct("pos", F.when(note, 0).otherwise(F.col("_group")).cast("int").alias("n"), "note", "text", (good & ~F.col("note") & F.col("_whole").rlike(PRECAUTION)).alias("warns"), F.when(good, (F.col("_part") == 2) & F.col("_cited")).otherwise(F.col("_cited")).alias("with_sources"))
    closing = F.struct((F.col("pos") + 1).alias("pos"), F.lit(0).alias("n"), F.lit(True).alias("note"), F.lit("").alias("text"), F.lit(False).alias("warns"), F.lit(True).alias("with_sources"))
    blocks = F.when(F.col("_ends"), F.array(block, closing)).otherwise(F.array(block))
    shown = made.select(key, F.explode(F.flatten(F.array_repeat(blocks, F.col("_copies")))).alias("_block"))
    return shown.select(key, "_block.*")


def with_topic(turns: DataFrame, key: str, order: str, leans: Column, role: str = "role", text: str = "text", asker: str = "user") -> DataFrame:
    """Questions with ``asked``: one that ``leans`` on what was said before has the asker's last question before it, unless it holds it already."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = turns.withColumn("_last", F.last(F.when(F.col(role) == asker, F.col(text)), ignorenulls=True).over(before)).where(F.col(role) == asker)
    joined = F.coalesce(leans, F.lit(False)) & F.col("_last").isNotNull() & ~F.contains(text, "_last")
    return own.withColumn("asked", F.when(joined, F.concat_ws(" ", "_last", text)).otherwise(F.col(text))).drop("_last")


def log_turns(log: DataFrame, turns: DataFrame) -> DataFrame:
    """``log`` (session_id, turn_id, seq, ...) with new ``turns`` (without seq) behind each session's last one; a turn that is logged already, or comes twice, counts once."""
    fresh = turns.dropDuplicates(["turn_id"]).join(log.select("turn_id"), "turn_id", "left_anti")
    last = log.groupBy("session_id").agg(F.max("seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id"))
    fresh = fresh.join(last, "session_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + place).cast(log.schema["seq"].dataType))
    return log.unionByName(fresh.select(*log.columns))
