"""An inverted index: for each stem the texts that have it, and where.

The postings are a table sorted by (stem, text) and dealt over files by ranges of both, so a question
reads the row groups of its own stems alone, and a stem of very many texts has many files. New texts are
a segment beside the others; whatever is superseded stays out of a search by a semi-join with the live
rows, as the lexical arm of a knowledge base asks for its live chunks anyway.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from lodestone.functions.lexemes import STOP_WORDS, with_stems
from lodestone.functions.text import tokens
from lodestone.shared import save

#: Different tokens with their stems that are sent to all tasks; more of them are joined by shuffles.
BROADCAST_STEMS = 500_000
#: Tokens that are put in order at once, about.
TOKENS_AT_ONCE = 1_000_000


def _by_token(texts: pa.ListArray) -> pa.ListArray:
    """For each list of tokens the different ones, each with its places."""
    size = texts.value_lengths().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), size)
    coded = texts.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    order = np.lexsort((place, code, text))
    text, code, place = text[order], code[order], place[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (code[1:] != code[:-1])]) if len(text) else np.empty(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(text)], pa.int32()), pa.array(place))
    held = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code[first])), places], ["token", "places"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[first], np.arange(len(texts) + 1)), pa.int32()), held)


def _held(texts: pa.Array) -> pa.Array:
    """The same, a few texts at once."""
    size = np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False)) // TOKENS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([_by_token(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])


@dataclass(frozen=True)
class Postings:
    """Saved segments of stem, id, places (sorted positions among all tokens of the text)."""

    segments: tuple[DataFrame, ...]

    def of(self, stems: list[str]) -> DataFrame:
        """The postings of ``stems``; the filter reaches the scan of each segment."""
        return reduce(DataFrame.unionByName, [s.where(F.col("stem").isin(*stems)) for s in self.segments])

    def extended(self, texts: DataFrame) -> Postings:
        """With the postings of further texts, whose ids are new."""
        return Postings((*self.segments, *index_texts(texts).segments))


def index_texts(texts: DataFrame) -> Postings:
    """The postings of ``texts`` (id, text). Null and empty texts have none; stop words are counted as places but not posted.

    Each different token is stemmed once. A text's places of a token become one row in the task that reads the text, so postings
    are shuffled once, by the ranges of their files, and tokens of one stem meet there.
    """
    words = texts.select("id", tokens(F.col("text")).alias("tokens"))
    seen = words.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct().where(~F.col("token").isin(*STOP_WORDS))
    known = save(with_stems(seen), "token-stems")
    if known.count() <= BROADCAST_STEMS:
        known = F.broadcast(known)
    by_token = F.arrow_udf(_held, "array<struct<token:string,places:array<int>>>", ArrowUDFType.SCALAR)
    held = words.select("id", F.explode(by_token("tokens")).alias("t")).select("id", "t.token", "t.places")
    # Stop words have no stem here.
    dealt = held.join(known, "token").select("stem", "id", "places").repartitionByRange("stem", "id")
    merged = dealt.groupBy("stem", "id").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return Postings((save(merged.sortWithinPartitions("stem", "id"), "postings"),))


def stems_of(spark, words: list[str]) -> dict[str, str]:
    """The stems of a question's words, which come to the driver."""
    if not words:
        return {}
    asked = spark.sql("SELECT explode(:words) AS token", args={"words": F.array(*[F.lit(w) for w in words])})
    return {r["token"]: r["stem"] for r in with_stems(asked).collect()}


def _before(places: str, n: int) -> Column:
    return F.transform(places, lambda p: p - n)


def occurrences(index: Postings, live: DataFrame, words: list[str], phrases: list[tuple[str, ...]], absent: list[str]) -> DataFrame:
    """id, hits of the ``live`` texts (id) that have one of the words or phrases by stem, or lack an ``absent`` word.

    Hits are the places of the words' stems, and those from which a phrase's stems follow each other.
    """
    every = list(dict.fromkeys([*words, *(w for p in phrases for w in p), *absent]))
    stem = stems_of(live.sparkSession, every)
    names = {s: f"p{i}" for i, s in enumerate(dict.fromkeys(stem.values()))}
    live = live.select("id")
    read = index.of(list(names)).join(live, "id", "left_semi")
    # A column of places for each stem of the question; a text has one row.
    texts = read.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("stem") == s, F.col("places"))), F.array().cast("array<int>")).alias(c) for s, c in names.items()])
    hits = F.lit(0)
    for s in dict.fromkeys(stem[w] for w in words):
        hits = hits + F.size(names[s])
    for phrase in phrases:
        starts = F.col(names[stem[phrase[0]]])
        for i, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, _before(names[stem[w]], i))
        hits = hits + F.size(starts)
    has = F.lit(True)
    for w in absent:
        has = has & (F.size(names[stem[w]]) > 0)
    # Texts with no posting of the question lack all absent words.
    out = live.join(texts, "id", "left") if absent else texts
    out = out.select("id", F.coalesce(hits, F.lit(0)).cast("long").alias("hits"), F.coalesce(~has, F.lit(True)).alias("lacks"))
    return out.where("hits > 0 OR lacks" if absent else "hits > 0").drop("lacks")
