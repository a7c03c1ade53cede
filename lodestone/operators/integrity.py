"""Rules that live data must keep, rules for scraped rows, and how two sources agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of rows that are never served. Fixed value.
UNTOUCHABLE = r"(?i)\b(?:airbag|srs)\b|do not tap"
#: Rules that quarantine a row; the others flag it. Fixed values.
QUARANTINE = ("W1", "W3", "W6")


def checked(checks: dict[str, DataFrame]) -> DataFrame:
    """A row for each check: check, value (rows that break it), status (PASS or FAIL)."""
    rows = [broken.agg(F.count("*").alias("value")).select(F.lit(name).alias("check"), "value", F.when(F.col("value") == 0, "PASS").otherwise("FAIL").alias("status")) for name, broken in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def live_invariants(documents: DataFrame, chunks: DataFrame, cards: DataFrame, actions: DataFrame) -> DataFrame:
    """The invariants of live data, as :func:`checked` gives them.

    ``documents``: doc_id, status, live_version; ``chunks``: chunk_id, doc_id, version, is_live, is_parent,
    embedding, deleted_at, parent_chunk_id; ``cards``: card_id, is_live; ``actions``: entity_type, entity_id, action,
    created_at, action_id. Live chunks belong to the live version of a current document, have a vector and
    aren't deleted; parents are neither live nor embedded; a child's parent is one of its document; the
    last action on a live card approved or edited it.
    """
    of = chunks.where("is_live").join(documents.select("doc_id", "status", "live_version"), "doc_id")
    wrong = of.where(~(F.col("status") == "current") | ~F.col("version").eqNullSafe(F.col("live_version")) | F.col("embedding").isNull() | F.col("deleted_at").isNotNull())
    parents = chunks.where("is_parent").select(F.col("chunk_id").alias("parent_chunk_id"), "doc_id")
    last = actions.where("entity_type = 'call_card'").groupBy(F.col("entity_id").alias("card_id")).agg(F.max_by("action", F.struct("created_at", "action_id")).alias("last"))
    return checked({
        "live chunks that should not be live": wrong,
        "parent chunks that are live or embedded": chunks.where("is_parent AND (is_live OR embedding IS NOT NULL)"),
        "children whose parent is missing or of another document": chunks.where("parent_chunk_id IS NOT NULL").join(parents, ["parent_chunk_id", "doc_id"], "left_anti"),
        "live cards without approval": cards.where("is_live").join(last, "card_id", "left").where(~F.coalesce("last", F.lit("")).isin("approve", "edit")),
    })


def scraped_rules(rows: DataFrame, vocabulary: DataFrame, least: float) -> DataFrame:
    """``rows`` with ``notes`` (a map of rules to reasons) and ``state`` (quarantined, flagged, ok).

    ``rows``: entry_id (unique), vehicle, circuit, ordinal, cell_raw, colour, connector_pins, pin, confidence;
    ``vocabulary``: word, in lower case. W1: words that no one may tap; W2: a vehicle's 12v and ignition texts
    are equal; W3: a pin beyond the connector's; W4: a word of the colour that isn't in the vocabulary; W5: a
    confidence below ``least``; W6: one circuit and ordinal of a vehicle twice with different texts. Nulls
    break no rule. Windows are over a vehicle's rows of one text or one place.
    """
    text = F.lower(F.trim("cell_raw"))
    both = F.collect_set(F.when(F.col("circuit").isin("12v", "ignition"), F.col("circuit"))).over(Window.partitionBy("vehicle", text))
    place = Window.partitionBy("vehicle", "circuit", "ordinal")
    words = F.array_distinct(F.regexp_extract_all(F.lower("colour"), F.lit("[a-z]+"), F.lit(0)))
    unknown = rows.select("entry_id", F.explode(words).alias("word")).join(vocabulary.select("word").distinct(), "word", "left_anti")
    unknown = unknown.groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list("word")), ", ").alias("_unknown"))
    out = rows.join(unknown, "entry_id", "left")
    reasons = {
        "W1": F.when(F.col("cell_raw").rlike(UNTOUCHABLE), "not to be tapped"),
        "W2": F.when(text.isNotNull() & F.col("circuit").isin("12v", "ignition") & (F.size(both) == 2), "both circuits read the same"),
        "W3": F.when(F.col("pin") > F.col("connector_pins"), F.concat_ws(" of ", "pin", "connector_pins")),
        "W4": F.col("_unknown"),
        "W5": F.when(F.col("confidence") < least, F.concat(F.lit("below "), F.lit(str(least)))),
        "W6": F.when(F.min(text).over(place) != F.max(text).over(place), "read twice"),
    }
    out = out.withColumns({f"_{k}": v for k, v in reasons.items()})
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_{k}").alias("value")) for k in reasons]), lambda e: e["value"].isNotNull())
    bad = F.exists(F.map_keys("notes"), lambda k: k.isin(*QUARANTINE))
    out = out.withColumn("notes", F.map_from_entries(entries))
    return out.select(*rows.columns, "notes", F.when(bad, "quarantined").when(F.size("notes") > 0, "flagged").otherwise("ok").alias("state"))


def agreement(every: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each row of ``every`` (key): key, bucket: ``agree`` or ``disagree`` where both sources have a ``value``, ``only ours``, ``only theirs``, ``neither``.

    Values are compared in lower case without outer blanks. A source that says several things of one
    key agrees if one of them is the other's. Null values say nothing.
    """
    said = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.collect_set(F.lower(F.trim(value))).alias(name))
    both = every.select(*key).distinct().join(said(ours, "_a"), key, "left").join(said(theirs, "_b"), key, "left")
    bucket = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "neither").when(F.col("_b").isNull(), "only ours").when(F.col("_a").isNull(), "only theirs").when(F.arrays_overlap("_a", "_b"), "agree").otherwise("disagree")
    return both.select(*key, bucket.alias("bucket"))


def version_parts(version: Column) -> Column:
    """``1.10.2`` as an array of numbers, which compares as versions do; what is behind the numbers is left out."""
    return F.split(F.regexp_extract(version, r"^\s*v?(\d+(?:\.\d+)*)", 1), r"\.").try_cast("array<int>")
