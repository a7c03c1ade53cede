"""Hybrid retrieval: two ranked arms, their fusion, and the rules on what comes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import has_code, term_count
from lodestone.functions.vector import cosine


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows with ``rank`` from 1. The limit comes first, so the window sees ``k`` rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dense_arm(vectors: DataFrame, query: Column, k: int = 20, floor: float | None = None) -> DataFrame:
    """id, similarity, rank of the ``k`` nearest by cosine; ``vectors`` has id and vector. Ties go by id."""
    found = vectors.select("id", cosine(F.col("vector"), query).alias("similarity")).where(F.col("similarity").isNotNull())
    if floor is not None:
        found = found.where(F.col("similarity") >= floor)
    return ranked(found, k, F.desc("similarity"), F.asc("id"))


def lexical_arm(texts: DataFrame, terms: list[str], k: int = 20) -> DataFrame:
    """id, hits, rank of the ``k`` texts with most occurrences of any term; ``texts`` has id and text."""
    found = texts.select("id", term_count(F.col("text"), terms).alias("hits")).where("hits > 0")
    return ranked(found, k, F.desc("hits"), F.asc("id"))


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 8, constant: int = 60, boost: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of two arms: id, dense_rank, lexical_rank, score; an arm without the id adds nothing.

    ``boost`` is added to each score; it may use the columns that the arms carry beside their own.
    """
    a = dense.withColumnRenamed("rank", "dense_rank")
    b = lexical.withColumnRenamed("rank", "lexical_rank")
    both = a.join(b, "id", "full")
    score = sum((F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank")), F.lit(0.0))
    both = both.withColumn("score", F.round(score + (F.lit(0.0) if boost is None else boost), 9))
    return both.orderBy(F.desc("score"), F.asc("id")).limit(k).select("id", "dense_rank", "lexical_rank", "score")


def admission(matches: DataFrame, gates: DataFrame) -> DataFrame:
    """For each gate (gate, floor, has_code): admit, reason, top_similarity. ``matches`` has similarity and lexical_rank; one pass over them.

    In this order: nothing found; similar enough; an exact code in the question with a lexical hit; below the floor.
    """
    top = matches.agg(F.count("*").alias("n"), F.coalesce(F.max(F.coalesce("similarity", F.lit(0.0))), F.lit(0.0)).alias("top_similarity"), F.count("lexical_rank").alias("hits"))
    reason = F.when(F.col("n") == 0, "no_matches").when(F.col("top_similarity") >= F.col("floor"), "similarity").when(F.col("has_code") & (F.col("hits") > 0), "exact_code").otherwise("below_threshold")
    out = gates.crossJoin(F.broadcast(top))
    return out.select("gate", reason.isin("similarity", "exact_code").alias("admit"), reason.alias("reason"), "top_similarity")


def best_per(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Words of a title that tell no document from another. Fixed values.
GENERIC_WORDS = (
    "guide guides install installation installer manual manuals instructions instruction "
    "user quick start quickstart reference card document doc pdf docx copy the "
    "and for with how setup set up new old version rev app"
).split()


def title_words(text: Column) -> Column:
    """The different words of three letters or more, hyphens kept inside."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def clarification_options(evidence: DataFrame, question: str, gap: float = 0.05, fewest: int = 2, most: int = 4) -> DataFrame:
    """The titles to choose from, best first: title, id, similarity, rank; none where there is nothing to ask.

    ``evidence`` has title (cleaned), id, similarity and rank. Of each title the best row counts,
    the earliest of equals. Up to ``most`` titles within ``gap`` of the top are options. Nothing is
    asked with fewer than ``fewest``, for a question with a part code, or for one with a word that
    some, but not all, of the options' titles have.
    """
    best = best_per(evidence.where(F.col("title") != ""), F.col("title"), F.desc("similarity"), F.asc("rank"))
    top = best.agg(F.max("similarity").alias("top"))
    order = (F.desc("similarity"), F.asc("rank"))
    near = best.join(F.broadcast(top), F.round(F.col("top") - F.col("similarity"), 6) <= gap).drop("top")
    near = near.orderBy(*order).limit(most).withColumn("option", F.row_number().over(Window.orderBy(*order)))
    own = near.withColumn("words", F.array_except(title_words(F.col("title")), F.array(*[F.lit(w) for w in GENERIC_WORDS])))
    # ``most`` rows at most meet here.
    asked = F.array_intersect(F.col("words"), title_words(F.lit(question)))
    every = own.agg(F.count("*").alias("n"), F.collect_list(asked).alias("lists"))
    single = F.size(F.array_distinct(F.flatten("lists"))) > F.size(F.aggregate("lists", F.element_at("lists", 1), lambda s, x: F.array_intersect(s, x)))
    ask = every.where((F.col("n") >= fewest) & ~F.coalesce(single, F.lit(False)) & ~has_code(F.lit(question)))
    return near.join(F.broadcast(ask.select("n")), F.lit(True), "left_semi").select("title", "id", "similarity", F.col("option").alias("rank"))


def with_clarification(question: Column, value: Column, skipped: Column) -> Column:
    """The question with the pick behind it, if there is one."""
    pick = F.trim(F.substring(F.trim(F.coalesce(value, F.lit(""))), 1, 200))
    return F.when((pick == "") | F.coalesce(skipped, F.lit(False)), question).otherwise(F.concat(F.trim(question), F.lit(" ("), pick, F.lit(")")))


def recall_at_k(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """One row: hits and recall, null for ``k`` = 0. Both sides have id."""
    hits = exact.select("id").join(approximate.select("id"), "id").agg(F.count("*").alias("hits"))
    return hits.select("hits", F.round(F.col("hits") / F.nullif(F.lit(k), F.lit(0)), 3).alias("recall"))


def add_without_repeats(found: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` rows of part 0 that part 1 lacks by id and by text, in order, before the rows of part 1.

    ``found`` (id, text, ord, part) has the few rows of both, so its windows are small.
    """
    has = lambda c: F.max("part").over(Window.partitionBy(c)) == 1
    rows = found.withColumn("new", (F.col("part") == 1) | ~(has("id") | has("text"))).where("new")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("ord", "id")))
    return rows.where((F.col("part") == 1) | (F.col("n") <= most)).select("id", "text", "part", "ord")


def admission_with_faq(admitted: DataFrame, resolved: DataFrame) -> DataFrame:
    """``admitted`` (gate, admit, reason, top_similarity) where a question that was refused is let in by a resolved one that is all but the same.

    ``resolved``: similarity and strong, a row for each passage behind resolved questions; reason ``faq``, with the best similarity.
    """
    best = resolved.agg(F.max("similarity").alias("_best"), F.coalesce(F.bool_or("strong"), F.lit(False)).alias("_strong"))
    out = admitted.crossJoin(F.broadcast(best))
    turned = ~F.col("admit") & F.col("_strong")
    return out.select("gate", (F.col("admit") | turned).alias("admit"), F.when(turned, "faq").otherwise(F.col("reason")).alias("reason"), F.when(turned, F.col("_best")).otherwise(F.col("top_similarity")).alias("top_similarity"))
