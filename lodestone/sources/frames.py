"""Server-sent events as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The event types that a client reads; others are dropped. Fixed values.
EVENT_TYPES = ("meta", "stage", "delta", "sources", "done", "error")


def parse_frames(streams: DataFrame, text_col: str = "text", types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """One row for each event: the stream's other columns, ``pos``, ``type`` and ``payload`` (JSON text).

    Frames end with a blank line; what follows the last one is not complete yet and waits.
    Heartbeats, malformed JSON and unknown types are dropped.
    """
    keep = [c for c in streams.columns if c != text_col]
    frames = F.split(F.regexp_replace(text_col, "\r\n", "\n"), "\n\n")
    whole = F.slice(frames, F.lit(1), F.size(frames) - 1)
    rows = streams.where(F.col(text_col).isNotNull()).select(*keep, F.posexplode(whole).alias("pos", "frame"))
    data = F.regexp_extract("frame", r"^data: ?(.*)$", 1)
    rows = rows.withColumn("payload", data).withColumn("type", F.get_json_object("payload", "$.type"))
    return rows.where(F.col("type").isin(*types)).select(*keep, "pos", "type", "payload")


def answer_text(events: DataFrame, key: str) -> DataFrame:
    """The text of each stream: its deltas in order."""
    deltas = events.where("type = 'delta'").select(key, F.struct("pos", F.coalesce(F.get_json_object("payload", "$.text"), F.lit("")).alias("t")).alias("d"))
    return deltas.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["t"]), "").alias("text"))
