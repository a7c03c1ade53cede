"""Mixing sources to target weights by capped water-filling.

Each source's share of a word budget follows its weight, but no source is repeated more than
``max_epochs`` times: sources above that are clamped, and the excess goes to the others by
weight, until none is above. A source's target then means so many whole repetitions of its
documents and a fractional one, for which a seeded order of the documents is cut at the
target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import inner, packed, same_document, save, table, unpacked

#: Documents of a source that share a bucket of the seeded order (on average, for the whole table as one source).
DOCS_PER_BUCKET = 50_000


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def code_point_ranks(sources: DataFrame, column: str = "source") -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last.

    Ranks come from range partitions and the row counts of those before each, so that no
    task holds all sources.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sources.repartitionByRange(n, F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    placed = save(ordered.withColumn("part", F.spark_partition_id()), "mix-sources")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition of the exchange above, so a bounded table.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last()))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + inside - 1).drop("part", "before")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``.

    Rounds of clamping: with the clamped sources at their cap, the rest of the budget is shared
    by weight; whatever goes above its cap is clamped next. Each round is one aggregate over the
    sources, of which the driver gets three sums. Weights that are null or not positive, and
    sources of size 0, take nothing. If the caps hold less than ``total``, all are at their cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    takes = F.coalesce(F.col("weight") > 0, F.lit(False)) & (F.col("source_size") > 0)
    open_weight, clamped, level = None, 0.0, 0.0
    while True:
        # A source once clamped stays so, because the level only rises.
        above = takes & (F.col("weight") * F.lit(level) >= cap) if open_weight is not None else F.lit(False)
        weight, held, n = sources.agg(
            F.coalesce(F.sum(F.when(takes & ~above, F.col("weight"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if open_weight is not None and n == clamped:
            break
        open_weight, clamped = weight, n
        if weight == 0:
            level = float("inf")
            break
        level = (total - held) / weight
    share = F.when(F.col("weight") * F.lit(level) >= cap, cap).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.when(takes, share).otherwise(F.lit(0.0)))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``repetitions`` (int) and ``taken`` = size * repetitions.

    ``weights`` (source, weight) defaults to 1, 2, 3, 1, 2, ... by code point of the source, null
    last; sources missing from it weigh nothing. ``share``: the words to take, as a part of all
    words. In the seeded order of a source the documents before its cut are repeated once more
    than the others; the one at the cut is taken if its middle lies before it, so a source is off
    its target by half a document at most. Null sources are a source of their own; null and empty
    texts have size 0 and take 0 words; rows that repeat a document are taken or left together.
    Columns of the input with the result's names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = packed(docs, id_col, text_col, source_col)
    sized = rows.select("id", "fp", F.col("c0").alias("source"), n_words(F.col(inner(docs, text_col))).alias("size"))
    narrow = save(sized.groupBy("id", "fp", "source").agg(F.first("size").alias("size"), F.count("*").alias("rows")), "mix-sizes")
    narrow = narrow.withColumn("words", F.col("size") * F.col("rows"))
    sources = narrow.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        sources = code_point_ranks(sources).select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight"))
    else:
        w = weights.select(F.col("source").alias("ws"), "weight").dropDuplicates(["ws"])
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("ws")), "left").drop("ws")
    sources = save(sources, "mix-weights")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = save(water_fill(sources, total * share, max_epochs), "mix-targets")

    # The seeded order of a source, in buckets: sums of the buckets place each bucket, and only
    # inside a bucket are documents sorted.
    n_buckets = max(16, narrow.count() // DOCS_PER_BUCKET)
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("fp"))
    keyed = narrow.withColumn("u", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("u", 20), F.lit(n_buckets)).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    start = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    place = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), start.alias("start"))
    aims = sources.select(F.col("source").alias("s0"), "source_size", "target")
    place = place.join(aims, F.col("s").eqNullSafe(F.col("s0"))).drop("s0")
    inside = F.sum("words").over(Window.partitionBy("source", "bucket").orderBy("u", "id", "fp").rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("upto", inside).join(place, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cut = (epochs - F.floor(epochs)) * F.col("source_size")
    first = F.col("start") + F.col("upto") - F.col("words") / 2 <= cut
    # Whole targets keep no fraction: rounding must not add a repetition to the cap.
    once_more = first & (epochs < F.lit(float(max_epochs))) & (F.col("size") > 0)
    repetitions = (F.floor(epochs) + once_more.cast("int")).cast("int")
    chosen = placed.select("id", "fp", "source", "size", "source_size", "target", repetitions.alias("repetitions")).withColumnRenamed("source", "c0")
    out = rows.join(chosen, same_document(rows, chosen, "c0"))
    new = {c: chosen[c] for c in ("size", "source_size", "target", "repetitions")}
    return unpacked(out, docs.columns, **new, taken=chosen["size"] * chosen["repetitions"])


def op1_mixing(spark, sf_dir):
    """All documents, mixed to weights 1, 2, 3, ... with three epochs at most."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repetitions")
