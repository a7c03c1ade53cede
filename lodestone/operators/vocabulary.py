"""Words that nearly are words of a vocabulary, by a deletion-neighbourhood index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.shared import save

#: The rule's key in a row's notes. Fixed value.
RULE = "V3"


def neighbourhood(word: Column) -> Column:
    """The word, and what is left of it without any one of its characters, each once."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """The index of ``vocabulary`` (word): variant, word; saved, sorted by variant."""
    each = vocabulary.where("word IS NOT NULL AND word != ''").select("word").distinct()
    posts = each.select(F.explode(neighbourhood(F.col("word"))).alias("variant"), "word")
    return save(posts.repartitionByRange("variant", "word").sortWithinPartitions("variant", "word"), "vocabulary")


def near_words(words: DataFrame, index: DataFrame) -> DataFrame:
    """For the ``words`` (word) that aren't in the vocabulary but within one edit of it: word, meant (the smallest such word).

    Two words within one insertion, deletion or replacement share a word or one of its cuts, so an
    equi-join on those finds all; the distance of what it finds is checked. Null and empty words are left out.
    """
    each = words.where("word IS NOT NULL AND word != ''").select("word").distinct()
    posts = each.select("word", F.explode(neighbourhood(F.col("word"))).alias("variant"))
    met = posts.join(index.withColumnRenamed("word", "meant"), "variant").select("word", "meant").distinct().where(F.levenshtein("word", "meant") <= 1)
    found = met.groupBy("word").agg(F.min("meant").alias("meant"), F.max((F.col("word") == F.col("meant")).cast("int")).alias("own"))
    return found.where("own = 0").select("word", "meant")


def flag_unknown(entries: DataFrame, column: str, index: DataFrame, notes: str = "validation_notes") -> DataFrame:
    """``entries`` with a note V3 where a word of ``column`` nearly is a vocabulary word: ``word -> meant``, several in order; other notes are kept, and an old V3 goes.

    ``notes`` is a map. Each different word is looked up once.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    held = entries.withColumns({"_row": F.monotonically_increasing_id(), "_words": words})
    held = save(held, "entries")
    each = held.select("_row", F.explode("_words").alias("word"))
    said = each.join(near_words(each.select("word"), index), "word").groupBy("_row").agg(F.array_join(F.sort_array(F.collect_list(F.concat("word", F.lit(" -> "), "meant"))), ", ").alias("_said"))
    old = F.map_filter(F.coalesce(notes, F.create_map().cast("map<string,string>")), lambda k, v: k != RULE)
    new = F.when(F.col("_said").isNotNull(), F.map_concat(old, F.create_map(F.lit(RULE), F.col("_said")))).otherwise(old)
    return held.join(said, "_row", "left").withColumn(notes, new).select(*entries.columns)
