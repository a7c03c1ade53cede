"""Retrieval: hybrid search and the rules around it, over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import clean_title, follow_up, has_code, last_segment
from lodestone.operators import retrieval as r

#: The question stands as the vector of row 7 and these terms.
QUESTION, TERMS = 7, ["the", "and", "of"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _question(spark, sf_dir):
    """The question's vector, as a literal: one row is read."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUESTION).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _texts(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", *more)


def hybrid_rrf(spark, sf_dir):
    dense = r.dense_arm(_vectors(spark, sf_dir), _question(spark, sf_dir), 100).select("id", "rank")
    lexical = r.lexical_arm(_texts(spark, sf_dir), TERMS, 100).select("id", "rank")
    return r.fuse(dense, lexical)


def hybrid_rrf_boosted(spark, sf_dir):
    dense = r.dense_arm(_vectors(spark, sf_dir), _question(spark, sf_dir), 100).select("id", "rank")
    lexical = r.lexical_arm(_texts(spark, sf_dir), TERMS, 100).select("id", "rank")
    ids = dense.select("id").union(lexical.select("id")).distinct()
    # Attributes only for the few ids of the arms.
    facts = _texts(spark, sf_dir, "lang", "source").drop("text").join(F.broadcast(ids), "id")
    boost = F.when(F.col("source") == "src0", 0.003).otherwise(0.0) + F.when(F.col("lang") == "en", 0.001).otherwise(0.0)
    return r.fuse(dense, lexical.join(facts, "id", "full"), boost=boost)


DENSE = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7),
sims AS (SELECT vec_id AS id, label, round(list_inner_product(embedding::DOUBLE[], v) /
           (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v, v))), 6) AS similarity
         FROM embeddings, q),
toks AS (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t IN ('the', 'and', 'of')))::BIGINT AS hits FROM documents)
"""
ARMS = DENSE + """,
d AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS dense_rank FROM sims QUALIFY dense_rank <= 100),
l AS (SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) AS lexical_rank FROM toks WHERE hits > 0 QUALIFY lexical_rank <= 100)
"""
HYBRID_SQL = f"""WITH {ARMS}
SELECT coalesce(d.id, l.id) AS id, dense_rank::INT AS dense_rank, lexical_rank::INT AS lexical_rank,
       round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS score
FROM d FULL JOIN l ON d.id = l.id ORDER BY score DESC, id LIMIT 8"""
BOOSTED_SQL = f"""WITH {ARMS}
SELECT coalesce(d.id, l.id) AS id, dense_rank::INT AS dense_rank, lexical_rank::INT AS lexical_rank,
       round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0)
         + CASE WHEN source = 'src0' THEN 0.003 ELSE 0 END::DOUBLE + CASE WHEN lang = 'en' THEN 0.001 ELSE 0 END::DOUBLE, 9) AS score
FROM d FULL JOIN l ON d.id = l.id LEFT JOIN documents x ON x.doc_id = coalesce(d.id, l.id) ORDER BY score DESC, id LIMIT 8"""


def knn_exact(spark, sf_dir):
    return r.dense_arm(_vectors(spark, sf_dir), _question(spark, sf_dir), 20)


def knn_floor(spark, sf_dir):
    return r.dense_arm(_vectors(spark, sf_dir), _question(spark, sf_dir), 10, floor=0.3)


def lexical_or_rank(spark, sf_dir):
    return r.lexical_arm(_texts(spark, sf_dir), TERMS, 20)


def admission_gate(spark, sf_dir):
    """For questions of growing strictness: what the gate says of the hybrid's arms."""
    dense = r.dense_arm(_vectors(spark, sf_dir).where(F.col("id") != QUESTION), _question(spark, sf_dir), 20)
    lexical = r.lexical_arm(_texts(spark, sf_dir), TERMS, 20).withColumnRenamed("rank", "lexical_rank")
    matches = dense.join(lexical, "id", "full")
    gates = spark.sql("SELECT * FROM VALUES ('open', 0.1D, false), ('strict', 0.99D, false), ('code', 0.99D, true) AS g(gate, floor, has_code)")
    none = r.admission(matches.limit(0), spark.sql("SELECT 'none' AS gate, 0.35D AS floor, true AS has_code"))
    return r.admission(matches, gates).unionByName(none)


ADMISSION_SQL = f"""WITH {DENSE},
t AS (SELECT max(similarity) AS top FROM (SELECT similarity FROM sims WHERE id <> 7 ORDER BY similarity DESC, id LIMIT 20)),
h AS (SELECT count(*) > 0 AS hit FROM toks WHERE hits > 0)
SELECT 'open' AS gate, top >= 0.1 AS admit, CASE WHEN top >= 0.1 THEN 'similarity' ELSE 'below_threshold' END AS reason, top AS top_similarity FROM t
UNION ALL SELECT 'strict', top >= 0.99, CASE WHEN top >= 0.99 THEN 'similarity' ELSE 'below_threshold' END, top FROM t
UNION ALL SELECT 'code', top >= 0.99 OR hit, CASE WHEN top >= 0.99 THEN 'similarity' WHEN hit THEN 'exact_code' ELSE 'below_threshold' END, top FROM t, h
UNION ALL SELECT 'none', false, 'no_matches', 0.0"""


def parent_dedup(spark, sf_dir):
    """The best row of each parent, by rank; the label stands for the parent."""
    facts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("parent"))
    top = r.dense_arm(_vectors(spark, sf_dir), _question(spark, sf_dir), 100)
    return r.best_per(facts.join(F.broadcast(top), "id"), F.col("parent"), F.asc("rank")).select("parent", "id", "similarity", F.col("rank"))


PARENT_SQL = f"""WITH {DENSE}, d AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM sims QUALIFY rank <= 100)
SELECT label AS parent, id, similarity, rank FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank) = 1"""


def recall_at_k(spark, sf_dir):
    """Exact neighbours against those by the first half of the components."""
    q = _question(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    cut = vectors.withColumn("vector", F.slice("vector", 1, 32))
    return r.recall_at_k(r.dense_arm(vectors, q, 20), r.dense_arm(cut, F.slice(q, 1, 32), 20), 20)


RECALL_SQL = f"""WITH {DENSE}, half AS (SELECT vec_id AS id, round(list_inner_product(embedding[1:32]::DOUBLE[], v[1:32]) /
  (sqrt(list_inner_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])) * sqrt(list_inner_product(v[1:32], v[1:32]))), 6) AS s FROM embeddings, q)
SELECT count(*)::BIGINT AS hits, round(count(*) / 20.0::DOUBLE, 3) AS recall
FROM (SELECT id FROM sims ORDER BY similarity DESC, id LIMIT 20) JOIN (SELECT id FROM half ORDER BY s DESC, id LIMIT 20) USING (id)"""


def faq_evidence(spark, sf_dir):
    """Texts of the nearest vectors, before the texts that the terms found, without repeats; texts are fetched once, for the ids found."""
    near = r.dense_arm(_vectors(spark, sf_dir), _question(spark, sf_dir), 10).select("id", F.col("rank").alias("ord"), F.lit(0).alias("part"))
    hits = r.lexical_arm(_texts(spark, sf_dir), TERMS, 10).select("id", F.col("rank").alias("ord"), F.lit(1).alias("part"))
    found = _texts(spark, sf_dir).join(F.broadcast(near.unionByName(hits)), "id")
    return r.add_without_repeats(found).select("part", "ord", "id", F.md5("text").alias("text_md5"))


FAQ_SQL = f"""WITH {DENSE},
near AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id)::INT AS ord FROM sims QUALIFY ord <= 10),
l AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id)::INT AS ord FROM toks WHERE hits > 0 QUALIFY ord <= 10),
t AS (SELECT l.id, ord, text FROM l JOIN documents ON doc_id = l.id),
f AS (SELECT near.id, ord, text FROM near JOIN documents ON doc_id = near.id
      WHERE near.id NOT IN (SELECT id FROM t) AND text NOT IN (SELECT text FROM t) ORDER BY ord LIMIT 3)
SELECT 0::INT AS part, ord, id, md5(text) AS text_md5 FROM f UNION ALL SELECT 1::INT, ord, id, md5(text) FROM t"""


def citation_validity(spark, sf_dir):
    """Answers that cite a source by mark, against the sources that are evidence."""
    marked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("See (Section: "), "source", F.lit(") and (Section: src"), (F.col("doc_id") % 25).cast("string"), F.lit(").")).alias("answer"))
    cited = marked.select("doc_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\(Section: ([^)]*)\)"), F.lit(1))).alias("section")).distinct()
    evidence = table(spark, sf_dir, "documents").select(F.col("source").alias("section")).distinct()
    return cited.join(evidence, "section", "left_anti").groupBy("section").agg(F.count("*").alias("violations"))


CITATION_SQL = """WITH c AS (SELECT DISTINCT doc_id, unnest([source, 'src' || (doc_id % 25)]) AS section FROM documents)
SELECT section, count(*)::BIGINT AS violations FROM c WHERE section NOT IN (SELECT DISTINCT source FROM documents) GROUP BY section"""


def sources_distinct(spark, sf_dir):
    """A key keeps its first position and its last value."""
    d = table(spark, sf_dir, "documents")
    w = F.struct("doc_id", "n_chars")
    return d.groupBy("source", "lang").agg(F.min("doc_id").alias("position"), F.max_by("n_chars", w).alias("last_chars"))


SOURCES_SQL = "SELECT source, lang, min(doc_id) AS position, arg_max(n_chars, doc_id) AS last_chars FROM documents GROUP BY source, lang"


def followup_flag(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", follow_up(F.col("text"), ["and", "so", "but"], ["it", "that", "this"]).alias("follow_up"))


FOLLOWUP_SQL = r"""SELECT conv_id, turn,
  len(regexp_extract_all(lower(trim(text)), '[^ \n\t]+')) <= 6
  OR coalesce(regexp_extract_all(lower(trim(text)), '[^ \n\t]+')[1] IN ('and', 'so', 'but'), false)
  OR list_has_any(regexp_extract_all(lower(trim(text)), '[a-z0-9]+'), ['it', 'that', 'this']) AS follow_up
FROM conversations WHERE role = 'user'"""


def exact_code_flag(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", has_code(F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "Brand#", "B"))).alias("has_code"))


CODE_SQL = """SELECT p_partkey, len(list_filter(regexp_extract_all(p_name || ' ' || replace(p_brand, 'Brand#', 'B'), '[A-Za-z0-9]+'),
  lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]'))) > 0 AS has_code FROM part"""


def clean_titles(spark, sf_dir):
    name = F.concat(F.lit("Copy of "), "p_name", F.lit(" ("), (F.col("p_size") % 10).cast("string"), F.lit(").pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", clean_title(name).alias("title"))


TITLES_SQL = "SELECT p_partkey, trim(p_name) AS title FROM part"


def section_tail(spark, sf_dir):
    path = F.concat_ws(" > ", "c_mktsegment", "c_nationkey", "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", last_segment(path).alias("section"))


TAIL_SQL = "SELECT c_custkey, trim(string_split(concat_ws(' > ', c_mktsegment, c_nationkey, c_name), '>')[-1]) AS section FROM customer"


def path_parse(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"://[^/]+/([^/?#]*)", 1).alias("first_segment"), (F.size(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")) - 3).cast("long").alias("depth"))


PATH_SQL = """SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/]+/([^/?#]*)', 1) AS first_segment,
  (len(string_split(regexp_replace(url, '[?#].*$', ''), '/')) - 3)::BIGINT AS depth FROM pages"""


def gap_clusters(spark, sf_dir):
    """Questions by cluster, most first."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("asked"), F.min("vec_id").alias("example"))


GAPS_SQL = "SELECT label, count(*)::BIGINT AS asked, min(vec_id) AS example FROM embeddings GROUP BY label"


def alias_lookup(spark, sf_dir):
    """Names within a trigram similarity of 0.5 of a misspelt one."""
    def grams(c):
        padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))

    wanted = "Supplier#00000001"
    s = table(spark, sf_dir, "supplier").withColumns({"a": grams(F.col("s_name")), "b": grams(F.lit(wanted))})
    score = F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6)
    return s.select("s_suppkey", "s_name", score.alias("score")).where("score >= 0.5")


ALIAS_SQL = """WITH g AS (SELECT s_suppkey, s_name, list_distinct(list_transform(range(1, len('  ' || s_name || ' ') - 1), lambda i: substr('  ' || lower(s_name) || ' ', i, 3))) AS a,
  list_distinct(list_transform(range(1, len('  Supplier#00000001 ') - 1), lambda i: substr('  supplier#00000001 ', i, 3))) AS b FROM supplier)
SELECT s_suppkey, s_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS score FROM g
WHERE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) >= 0.5"""

LEXICAL_SQL = f"WITH {DENSE} SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id)::INT AS rank FROM toks WHERE hits > 0 QUALIFY rank <= 20"
KNN_SQL = f"WITH {DENSE} SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM sims QUALIFY rank <= 20"
FLOOR_SQL = f"WITH {DENSE} SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM sims WHERE similarity >= 0.3 QUALIFY rank <= 10"

PAIRS = {
    "hybrid_rrf": (hybrid_rrf, HYBRID_SQL),
    "hybrid_rrf_boosted": (hybrid_rrf_boosted, BOOSTED_SQL),
    "knn_exact": (knn_exact, KNN_SQL),
    "knn_floor": (knn_floor, FLOOR_SQL),
    "lexical_or_rank": (lexical_or_rank, LEXICAL_SQL),
    "admission_gate": (admission_gate, ADMISSION_SQL),
    "parent_dedup": (parent_dedup, PARENT_SQL),
    "recall_at_k": (recall_at_k, RECALL_SQL),
    "faq_evidence": (faq_evidence, FAQ_SQL),
    "citation_validity": (citation_validity, CITATION_SQL),
    "sources_distinct": (sources_distinct, SOURCES_SQL),
    "followup_flag": (followup_flag, FOLLOWUP_SQL),
    "exact_code_flag": (exact_code_flag, CODE_SQL),
    "clean_title": (clean_titles, TITLES_SQL),
    "section_tail": (section_tail, TAIL_SQL),
    "path_parse": (path_parse, PATH_SQL),
    "gap_clusters": (gap_clusters, GAPS_SQL),
    "alias_lookup": (alias_lookup, ALIAS_SQL),
}
