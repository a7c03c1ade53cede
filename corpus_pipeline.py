"""The corpus pipeline: documents through five operators, each stage on what the one before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table
and further columns of any name; all but the last return the columns they got. Operators see
``doc_id``, ``text`` and ``source`` and one packed column with the rest, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import join_keys, save
from lodestone.llm.bpe import round_trip
from lodestone.llm.jaccard import one_of_each_group
from lodestone.llm.line_dedup import build_state, dedup_lines
from lodestone.llm.mixing import mix_sources
from lodestone.llm.quality import quality_rules

#: A line goes when so many documents still have it.
LINE_DOCS = 10


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines.

    Null and empty texts have too few words and go. Rows that repeat a document are all kept or all go.
    """
    return _documents(quality_rules(_carried(docs)).where("kept"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of LINE_DOCS or more documents. A text of nothing but such lines becomes empty, unless
    LINE_DOCS or more documents have just this text: then its copies alone make its lines frequent, it stays as it is,
    and the next stage keeps one of them.

    All rows stay; a null text comes back empty. A document that is repeated counts once.
    """
    carried = _carried(docs).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    copied = carried.where(F.col("text").isNotNull()).groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n")).where(F.col("n") >= LINE_DOCS)
    copied = save(copied.select("h1", "h2", F.lit(True).alias("copied")), "copied-texts")
    marked = join_keys(carried, copied, ["h1", "h2"], ["doc_id"], "left").drop("h1", "h2")
    state = build_state(docs, min_docs=LINE_DOCS)
    # All lines of a copied text are frequent, so it is taken past the operator whole or not at all.
    changed = dedup_lines(marked.where("copied IS NULL"), state).select("doc_id", "text", "source", "rest")
    return _documents(changed.unionByName(marked.where("copied").select("doc_id", "text", "source", "rest")), docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8 or more): the one with the
    smallest id, nulls last.

    One row stays of those that repeat it. Documents without words, or without a text, link with nothing: each
    stays, once.
    """
    return _documents(one_of_each_group(_carried(docs)), docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; those that it doesn't take go. A document without
    words is repeated as often as its source as a whole."""
    mixed = mix_sources(_carried(docs)).where("repetitions > 0")
    return _documents(mixed.withColumn("text", F.explode(F.expr("array_repeat(text, repetitions)"))), docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids of each text with their number, and the digest of the text that they decode to.

    Null and empty texts have no ids.
    """
    out = round_trip(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, with all columns but the text packed beside them."""
    return docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def _documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


STAGES = [
    ("quality rules", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("mixing to target weights", mix_to_weights),
    ("BPE encoding and decoding", encode_texts),
]

#: The mix is seeded and the tokenizer is a library; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"stage-{k}")
    return docs
