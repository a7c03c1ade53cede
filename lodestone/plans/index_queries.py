"""Indexes and groups: small-world graphs, exact neighbours of many questions, gaps by vectors, names by trigrams, words by their cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import aliases, gaps, graph_index, vocabulary
from lodestone.plans.retrieval_queries import table

K = 20


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _questions(spark, sf_dir):
    """Every twentieth vector asks for its neighbours among all."""
    return _vectors(spark, sf_dir).where(F.col("id") % 20 == 0)


def knn_many(spark, sf_dir):
    """The nearest rows of many questions, by comparing all."""
    return graph_index.nearest_exactly(_vectors(spark, sf_dir), _questions(spark, sf_dir), K)


KNN_MANY_SQL = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM s QUALIFY rank <= 20"""


def ann_graph(spark, sf_dir):
    """The same by a graph for each shard; approximate, so without SQL."""
    return graph_index.nearest(graph_index.build(_vectors(spark, sf_dir)), _questions(spark, sf_dir), K)


def ann_recall(spark, sf_dir):
    """For each question how many of its true neighbours the graphs find."""
    return graph_index.recall(knn_many(spark, sf_dir), ann_graph(spark, sf_dir), K)


def gap_groups(spark, sf_dir):
    """Users' turns as questions that nothing answers, grouped by their words."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), gaps.hashed_words(F.col("text")).alias("vector"))
    return gaps.gap_groups(asked).select("id", "group_id", "asked")


GAP_GROUPS_SQL = r"""WITH RECURSIVE t AS (
  SELECT conv_id || '-' || turn AS id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % 64) AS w FROM conversations WHERE role = 'user'
), v AS (SELECT id, list_transform(range(64), lambda i: len(list_filter(w, lambda x: x = i))::DOUBLE) AS v FROM t),
u AS (SELECT id, v FROM v WHERE list_sum(v) > 0),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.9),
r(x, y) AS (SELECT id, id FROM v UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
g AS (SELECT x AS id, min(y) AS group_id FROM r GROUP BY x)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id)::BIGINT AS asked FROM g"""


def gap_ranking(spark, sf_dir):
    """Groups of questions, the most asked first."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), gaps.hashed_words(F.col("text")).alias("vector"))
    return gaps.ranked_gaps(gaps.gap_groups(asked)).limit(25)


GAP_RANKING_SQL = f"SELECT group_id, count(*)::BIGINT AS asked FROM ({GAP_GROUPS_SQL}) GROUP BY group_id ORDER BY asked DESC, group_id LIMIT 25"


def alias_many(spark, sf_dir):
    """Suppliers by names of which two characters are missing."""
    s = table(spark, sf_dir, "supplier")
    posts = aliases.name_postings(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    asked = s.select(F.col("s_suppkey").alias("asked_id"), F.regexp_replace("s_name", "#0", "").alias("asked"))
    return aliases.similar_names(posts, asked, 0.7).select("asked_id", "id", "score")


ALIAS_MANY_SQL = """WITH n AS (SELECT s_suppkey AS id, list_distinct(list_transform(range(1, len(s_name) + 2), lambda i: substr('  ' || lower(s_name) || ' ', i, 3))) AS g FROM supplier),
q AS (SELECT s_suppkey AS asked_id, list_distinct(list_transform(range(1, len(replace(s_name, '#0', '')) + 2), lambda i: substr('  ' || lower(replace(s_name, '#0', '')) || ' ', i, 3))) AS g FROM supplier),
s AS (SELECT asked_id, id, round(len(list_intersect(n.g, q.g)) / len(list_distinct(list_concat(n.g, q.g)))::DOUBLE, 6) AS score FROM n, q)
SELECT * FROM s WHERE score >= 0.7"""


def near_vocabulary(spark, sf_dir):
    """Words of documents that are one edit away from a word of the benchmark."""
    known = vocabulary.vocabulary_index(table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")))
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    return vocabulary.near_words(words, known)


VOCABULARY_SQL = """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS meant FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
SELECT word, min(meant) AS meant FROM w JOIN v ON abs(length(word) - length(meant)) <= 1 AND levenshtein(word, meant) <= 1 WHERE word NOT IN (SELECT meant FROM v) GROUP BY word"""


def colour_flags(spark, sf_dir):
    """Parts' names as colours of wires, held against the words of the most parts; a note is added where one is misspelt."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    index = vocabulary.vocabulary_index(words.distinct())
    spelt = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", "^(..).", "$1")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x"), "p_name")).otherwise(F.col("p_name"))
    rows = p.select("p_partkey", spelt.alias("wire_colour"), F.create_map(F.lit("V1"), F.lit("pin"), F.lit("V3"), F.lit("old")).alias("validation_notes"))
    out = vocabulary.flag_unknown(rows, "wire_colour", index)
    return out.select("p_partkey", F.col("validation_notes")["V3"].alias("v3"), F.size("validation_notes").alias("notes"))


COLOUR_SQL = r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS meant FROM part),
r AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(CASE p_partkey % 3 WHEN 0 THEN regexp_replace(p_name, '^(..).', '\1') WHEN 1 THEN 'x' || p_name ELSE p_name END), '[a-z]+')) AS w FROM part),
e AS (SELECT DISTINCT unnest(w) AS word FROM r),
n AS (SELECT word, min(meant) AS meant FROM e JOIN v ON levenshtein(word, meant) <= 1 WHERE word NOT IN (SELECT meant FROM v) GROUP BY word),
f AS (SELECT p_partkey, string_agg(word || ' -> ' || meant, ', ' ORDER BY word || ' -> ' || meant) AS v3 FROM (SELECT p_partkey, unnest(w) AS word FROM r) JOIN n USING (word) GROUP BY 1)
SELECT p_partkey, v3, CASE WHEN v3 IS NULL THEN 1 ELSE 2 END::INT AS notes FROM part LEFT JOIN f USING (p_partkey)"""

PAIRS = {
    "knn_many": (knn_many, KNN_MANY_SQL),
    "ann_graph": (ann_graph, None),
    "ann_recall": (ann_recall, None),
    "gap_groups": (gap_groups, GAP_GROUPS_SQL),
    "gap_ranking": (gap_ranking, GAP_RANKING_SQL),
    "alias_many": (alias_many, ALIAS_MANY_SQL),
    "near_vocabulary": (near_vocabulary, VOCABULARY_SQL),
    "colour_flags": (colour_flags, COLOUR_SQL),
}
