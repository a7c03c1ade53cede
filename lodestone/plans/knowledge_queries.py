"""Knowledge-base operators over the shared tables: documents stand for chunks, embeddings for their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.lexemes import STOP_WORDS, stems_sql, with_stems
from lodestone.functions.text import clean_title, tokens
from lodestone.operators import knowledge as k
from lodestone.operators import publication as p
from lodestone.operators import retrieval as r
from lodestone.operators.chunking import chunk_blocks, section_paths
from lodestone.operators.postings import index_texts
from lodestone.plans.retrieval_queries import DENSE, _question, table

QUESTION = 'erating or "eriner thanea" -nd anated'
ORG = "en"


def _chunks(spark, sf_dir):
    """A document is a chunk of its language's organisation, live unless it is labelled toxic, of the web if from the first source;
    the first document of a source and language is its parent."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    first = d.groupBy("source", "lang").agg(F.min("id").alias("parent"))
    d = d.join(labels, "id", "left").join(vectors, "id", "left").join(first, ["source", "lang"])
    return d.select(
        "id", F.col("source").alias("doc_id"), F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent_id"), F.col("lang").alias("org_id"), (F.coalesce("toxic", F.lit(0)) == 0).alias("is_live"), F.lit(None).cast("timestamp").alias("deleted_at"),
        F.when(F.col("source") == "src0", "web").otherwise("manual").alias("source_type"), "text", "vector", F.col("source").alias("vendor"), F.array("source", "lang").alias("models"), F.col("lang").alias("language"), F.concat(F.lit("Copy of "), "source", F.lit(".pdf")).alias("title"), F.floor(F.col("n_chars") / 1000).cast("int").alias("page"),
    )


CHUNKS = """lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
chunks AS (SELECT d.doc_id AS id, d.source AS doc_id, nullif(min(d.doc_id) OVER (PARTITION BY source, lang), d.doc_id) AS parent_id, lang AS org_id, coalesce(toxic, 0) = 0 AS is_live,
  CASE WHEN source = 'src0' THEN 'web' ELSE 'manual' END AS source_type, text, embedding::DOUBLE[] AS vector, 'Copy of ' || source || '.pdf' AS title, floor(n_chars / 1000)::INT AS page
  FROM documents d LEFT JOIN lab USING (doc_id) LEFT JOIN embeddings ON vec_id = d.doc_id),
live AS (SELECT * FROM chunks WHERE org_id = 'en' AND is_live AND source_type <> 'web')"""
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SEARCH = f"""toks AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM live),
words AS (SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM toks),
voc AS (SELECT DISTINCT token FROM words WHERE token NOT IN ({STOPS})),
lex AS ({stems_sql("voc")}),
asked AS ({stems_sql("(SELECT unnest(['erating', 'eriner', 'thanea', 'nd', 'anated']) AS token)")}),
forms AS (SELECT asked.token AS word, lex.token FROM lex JOIN asked USING (stem)),
hit AS (SELECT id, count(*) AS n FROM words WHERE token IN (SELECT token FROM forms WHERE word IN ('erating', 'anated')) GROUP BY id
  UNION ALL SELECT a.id, count(*) FROM words a JOIN words b ON a.id = b.id AND b.i = a.i + 1 WHERE a.token IN (SELECT token FROM forms WHERE word = 'eriner') AND b.token IN (SELECT token FROM forms WHERE word = 'thanea') GROUP BY a.id),
lacks AS (SELECT id FROM live WHERE id NOT IN (SELECT id FROM words WHERE token IN (SELECT token FROM forms WHERE word = 'nd'))),
found AS (SELECT id, sum(n)::BIGINT AS hits FROM (SELECT * FROM hit UNION ALL SELECT id, 0 FROM lacks) GROUP BY id),
lexical AS (SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id)::INT AS rank FROM found QUALIFY rank <= 20)"""


def live_chunks(spark, sf_dir):
    """Live rows by organisation of all types but the web; and with the web when asked."""
    chunks = _chunks(spark, sf_dir)
    return k.live_rows(chunks, ORG).select("id", "doc_id", F.lit("default").alias("asked")).unionByName(k.live_rows(chunks, ORG, ["web"]).select("id", "doc_id", F.lit("web").alias("asked")))


LIVE_SQL = f"""WITH {CHUNKS} SELECT id, doc_id, 'default' AS asked FROM live
UNION ALL SELECT id, doc_id, 'web' FROM chunks WHERE org_id = 'en' AND is_live AND source_type = 'web'"""


def stem_lexicon(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    return with_stems(words)


STEM_SQL = stems_sql("(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)")


def text_search(spark, sf_dir):
    """Words, a phrase and an absent word, by stems, over live rows."""
    chunks = _chunks(spark, sf_dir)
    return k.text_search(index_texts(chunks), k.live_rows(chunks, ORG), k.parse_question(QUESTION))


SEARCH_SQL = f"WITH {CHUNKS}, {SEARCH} SELECT id, hits, rank FROM lexical"


def match_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return k.match_chunks(chunks, _question(spark, sf_dir), k.parse_question(QUESTION), index_texts(chunks), ORG, vendor="src1", model="src2", language="en")


MATCH_SQL = f"""WITH {CHUNKS}, {SEARCH}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7),
sims AS (SELECT id, round(list_inner_product(vector, v) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(v, v))), 6) AS similarity FROM live, q),
d AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id)::INT AS dense_rank FROM sims WHERE similarity IS NOT NULL QUALIFY dense_rank <= 20),
b AS (SELECT coalesce(d.id, l.id) AS id, dense_rank, l.rank AS lexical_rank FROM d FULL JOIN lexical l ON d.id = l.id)
SELECT b.id, doc_id, parent_id, dense_rank, lexical_rank, similarity,
  round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + CASE WHEN doc_id = 'src1' THEN 0.003 ELSE 0 END::DOUBLE + CASE WHEN doc_id = 'src2' THEN 0.002 ELSE 0 END::DOUBLE + 0.001::DOUBLE, 9) AS score
FROM b JOIN live USING (id) JOIN sims USING (id) ORDER BY score DESC, id LIMIT 8"""


def parents_of_matches(spark, sf_dir):
    """The nearest rows, one for each parent, with the parent's text and title."""
    chunks = _chunks(spark, sf_dir)
    near = r.dense_arm(chunks.where("vector IS NOT NULL"), _question(spark, sf_dir), 50)
    matches = chunks.select("id", "parent_id").join(F.broadcast(near), "id")
    out = k.with_parents(matches, chunks)
    return out.select("id", "parent_id", "similarity", "rank", F.md5("content").alias("content_md5"), "title")


PARENTS_SQL = f"""WITH {DENSE}, {CHUNKS},
near AS (SELECT s.id, similarity, row_number() OVER (ORDER BY similarity DESC, s.id)::INT AS rank FROM sims s JOIN documents ON doc_id = s.id QUALIFY rank <= 50),
m AS (SELECT c.id, parent_id, similarity, rank, text, title FROM near JOIN chunks c USING (id) QUALIFY row_number() OVER (PARTITION BY coalesce(parent_id, c.id) ORDER BY rank) = 1)
SELECT m.id, m.parent_id, similarity, rank, md5(coalesce(p.text, m.text)) AS content_md5, m.title FROM m LEFT JOIN chunks p ON p.id = m.parent_id"""


def _images(spark, sf_dir):
    """Pages stand for pictures of the source that their number names."""
    row = table(spark, sf_dir, "pages")
    return row.select(F.col("page_id").alias("image_id"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("doc_id"), F.floor(F.length("html") / 1000).cast("int").alias("page"), F.contains("url", F.lit("?")).alias("decorative"), F.col("url").alias("caption"), F.md5("url").alias("content_hash"), F.col("html").alias("description"))


IMAGES = "images AS (SELECT page_id AS image_id, 'src' || (page_id % 20) AS doc_id, floor(length(html) / 1000)::INT AS page, contains(url, '?') AS decorative, url AS caption, md5(url) AS content_hash FROM pages)"


def images_of_chunks(spark, sf_dir):
    """Pictures on the pages of the nearest rows, without their descriptions."""
    chunks = _chunks(spark, sf_dir)
    near = r.dense_arm(chunks.where("vector IS NOT NULL"), _question(spark, sf_dir), 50)
    return k.images_for_chunks(near, chunks, _images(spark, sf_dir))


IMAGES_SQL = f"""WITH {DENSE}, {CHUNKS}, {IMAGES},
near AS (SELECT s.id FROM sims s JOIN documents ON doc_id = s.id ORDER BY similarity DESC, s.id LIMIT 50)
SELECT c.id, image_id, i.doc_id, i.page, caption FROM near JOIN chunks c USING (id) JOIN images i ON i.doc_id = c.doc_id AND i.page = c.page WHERE NOT decorative"""


def evidence_pictures(spark, sf_dir):
    """References by content or by page, in order, each picture once."""
    images = _images(spark, sf_dir)
    d = table(spark, sf_dir, "documents").orderBy("doc_id").limit(40)
    named = images.select(F.col("image_id").alias("doc"), F.col("content_hash").alias("h"))
    refs = d.join(F.broadcast(named), d["doc_id"] == named["doc"], "left").select(F.col("doc").alias("_"), d["doc_id"].alias("ord"), F.when(F.col("lang") == "en", F.col("h")).alias("hash"), F.col("source").alias("doc_id"), F.floor(F.col("n_chars") / 1000).cast("int").alias("page")).drop("_")
    return k.evidence_pictures(refs, images, 40, 12)


PICTURES_SQL = f"""WITH {IMAGES},
refs AS (SELECT d.doc_id AS ord, CASE WHEN lang = 'en' THEN content_hash END AS hash, source AS doc_id, floor(n_chars / 1000)::INT AS page FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 40) d LEFT JOIN images ON image_id = d.doc_id),
hits AS (SELECT ord, image_id, content_hash FROM refs JOIN images i ON hash = content_hash UNION ALL SELECT ord, image_id, content_hash FROM refs JOIN images i ON hash IS NULL AND i.doc_id = refs.doc_id AND i.page = refs.page)
SELECT min(ord) AS ord, arg_min(image_id, (ord, image_id)) AS image_id FROM hits GROUP BY content_hash ORDER BY ord, image_id LIMIT 12"""


def call_cards(spark, sf_dir):
    """Reviewed cards by symptom; a label of quality stands for the review."""
    lab = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    cards = _chunks(spark, sf_dir).join(lab, "id", "left").select("id", "org_id", "is_live", "deleted_at", F.when(F.col("quality") == 1, "indexed").otherwise("pending").alias("review_status"), F.col("vector").alias("symptom_vec"))
    return k.match_call_cards(cards, _question(spark, sf_dir), ORG)


CARDS_SQL = f"""WITH {DENSE}, {CHUNKS}, qual AS (SELECT doc_id AS id, max(quality) AS quality FROM labels GROUP BY 1)
SELECT c.id, similarity, row_number() OVER (ORDER BY similarity DESC, c.id)::INT AS rank FROM chunks c JOIN sims USING (id) JOIN qual USING (id) WHERE org_id = 'en' AND is_live AND quality = 1 QUALIFY rank <= 5"""


def _faqs(spark, sf_dir):
    """A vector is a resolved question whose sources are the documents of its number and the two after it."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("question "), "vec_id").alias("question"), F.col("embedding").alias("vector"), (F.col("label") != 3).alias("active"), F.lit(0).cast("long").alias("uses"), F.array("vec_id", F.col("vec_id") + 1, F.col("vec_id") + 2).alias("chunk_ids"), F.concat(F.lit("turn "), "vec_id").alias("turn_id"))


def faq_passages(spark, sf_dir):
    """Live passages behind the nearest resolved questions."""
    return k.faq_evidence(_faqs(spark, sf_dir), _chunks(spark, sf_dir), _question(spark, sf_dir), floor=0.1, strong=0.92, k=20)


FAQ_SQL = f"""WITH {DENSE}, {CHUNKS},
n AS (SELECT id, similarity FROM sims WHERE label <> 3 AND similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 20),
x AS (SELECT unnest([id, id + 1, id + 2]) AS id, similarity FROM n), m AS (SELECT id, max(similarity) AS similarity FROM x GROUP BY id),
b AS (SELECT c.id, similarity FROM m JOIN chunks c USING (id) WHERE is_live QUALIFY row_number() OVER (PARTITION BY coalesce(parent_id, c.id) ORDER BY similarity DESC, c.id) = 1)
SELECT id, similarity, (SELECT max(similarity) >= 0.92 FROM n) AS strong, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM b"""


def _resolutions(spark, sf_dir):
    faqs = _faqs(spark, sf_dir).withColumn("id", F.col("id").cast("string")).withColumn("chunk_ids", F.col("chunk_ids").cast("array<string>"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("t"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding", "label")
    turns = turns.join(vectors, "conv_id").select(
        F.concat(F.lit("turn "), "conv_id").alias("turn_id"), F.when(F.col("label") == 3, "resolved").when(F.col("label") == 5, "unresolved").otherwise("resolved").alias("rating"), F.when(F.col("label") == 7, "not_covered").otherwise("answered").alias("outcome"), (F.col("label") != 9).alias("verified"),
        F.col("t.text").alias("question"), F.when(F.col("label") < 12, F.reverse("embedding")).otherwise(F.col("embedding")).alias("vector"), F.when(F.col("label") != 1, F.array(F.lit("c"))).alias("chunk_ids"),
    )
    return k.record_resolutions(faqs, turns)


def faq_resolutions(spark, sf_dir):
    """What became of rated turns."""
    return _resolutions(spark, sf_dir)[1]


def faq_ledger(spark, sf_dir):
    """The questions after rated turns."""
    out = _resolutions(spark, sf_dir)[0]
    return out.groupBy("active", (F.col("uses") > 0).alias("used")).agg(F.count("*").alias("n"), F.sum("uses").alias("uses"))


RESOLVED = """t AS (SELECT conv_id, label, arg_max(text, turn) AS question, any_value(CASE WHEN label < 12 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END) AS v
  FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role = 'user' GROUP BY ALL),
r AS (SELECT 'turn ' || conv_id AS turn_id, v, label <> 5 AS resolved, CASE WHEN label = 5 THEN NULL WHEN label = 7 THEN 'not an answer' WHEN label = 9 THEN 'the answer was flagged unverified' WHEN label = 1 THEN 'no question or sources were recorded' END AS reason FROM t),
near AS (SELECT turn_id, arg_max(vec_id, s) AS known FROM (SELECT turn_id, vec_id, round(list_inner_product(v, embedding::DOUBLE[]) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS s
  FROM r, embeddings WHERE resolved AND reason IS NULL AND label <> 3) WHERE s >= 0.97 GROUP BY turn_id)"""
RESOLUTION_SQL = f"""WITH {RESOLVED} SELECT turn_id, CASE WHEN NOT resolved THEN 'removed' WHEN reason IS NOT NULL THEN 'skipped' WHEN known IS NOT NULL THEN 'already_known' ELSE 'added' END AS faq, reason FROM r LEFT JOIN near USING (turn_id)"""
LEDGER_SQL = f"""WITH {RESOLVED}, used AS (SELECT known AS vec_id, count(*) AS uses FROM near GROUP BY 1),
f AS (SELECT label <> 3 AND 'turn ' || vec_id NOT IN (SELECT turn_id FROM r WHERE NOT resolved) AS active, coalesce(uses, 0) AS uses FROM embeddings LEFT JOIN used USING (vec_id)
  UNION ALL SELECT true, 0 FROM r WHERE resolved AND reason IS NULL AND turn_id NOT IN (SELECT turn_id FROM near))
SELECT active, uses > 0 AS used, count(*)::BIGINT AS n, sum(uses)::BIGINT AS uses FROM f GROUP BY ALL"""


def clarify_options(spark, sf_dir):
    """Titles that are as near as the nearest one."""
    chunks = _chunks(spark, sf_dir)
    top = r.dense_arm(chunks.where("vector IS NOT NULL"), _question(spark, sf_dir), 100)
    titled = chunks.select("id", clean_title(F.col("title")).alias("title")).join(F.broadcast(top), "id")
    return r.clarification_options(titled, "How does it start?", gap=0.8)


CLARIFY_SQL = f"""WITH {DENSE}, {CHUNKS},
d AS (SELECT s.id, similarity, row_number() OVER (ORDER BY similarity DESC, s.id) AS rank FROM sims s JOIN documents ON doc_id = s.id QUALIFY rank <= 100),
b AS (SELECT source AS title, id, similarity, rank AS r FROM d JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY source ORDER BY similarity DESC, rank) = 1)
SELECT title, id, similarity, row_number() OVER (ORDER BY similarity DESC, r)::INT AS rank FROM b WHERE round((SELECT max(similarity) FROM b) - similarity, 6) <= 0.8 QUALIFY rank <= 4"""


def citations_resolve(spark, sf_dir):
    """Citations by page and by section to the texts that they mean."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.floor(F.col("n_chars") / 1000).cast("int").alias("page_from"), F.floor(F.col("n_chars") / 900).cast("int").alias("page_to"), F.concat_ws(" > ", "source", F.concat(F.lit("Part "), "lang")).alias("section_path"), F.md5("text").alias("text"))
    cites = table(spark, sf_dir, "pages").select(F.col("page_id").alias("cite_id"), F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("doc_id"), F.when(F.contains("url", F.lit("?")), F.floor(F.length("html") / 500).cast("int")).alias("page"), F.when(~F.contains("url", F.lit("?")), F.lit(" part EN ")).alias("section"))
    return k.citation_text(chunks, cites, F.md5).select("cite_id", "page", F.col("text").alias("text_md5"))


RESOLVE_SQL = """WITH c AS (SELECT source AS doc_id, doc_id AS i, floor(n_chars / 1000)::INT AS a, floor(n_chars / 900)::INT AS b, 'part ' || lang AS section, md5(text) AS text FROM documents),
x AS (SELECT page_id AS cite_id, 'src' || (page_id % 25) AS doc_id, CASE WHEN contains(url, '?') THEN floor(length(html) / 500)::INT END AS page FROM pages),
j AS (SELECT cite_id, i, text FROM x JOIN c USING (doc_id) WHERE CASE WHEN page IS NOT NULL THEN page BETWEEN a AND b ELSE section = 'part en' END)
SELECT x.cite_id, page, md5(t) AS text_md5 FROM x LEFT JOIN (SELECT cite_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS t FROM j GROUP BY 1) USING (cite_id)"""


def literal_guard(spark, sf_dir):
    """Answers whose measures no evidence has, or that leave its warnings out; lines of orders stand for both."""
    line = table(spark, sf_dir, "lineitem")
    said = line.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.concat_ws(" ", F.lit("Use"), F.max("l_quantity").cast("int").cast("string"), F.lit("volts on pin"), F.max("l_linenumber").cast("string")).alias("text"))
    known = line.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" Volts at PIN "), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", F.lit("\nWARNING: hot")).otherwise(F.lit(""))).alias("text"))
    return k.literal_guard(said, known.where("text NOT LIKE '%PIN 7%'"))


GUARD_SQL = """WITH s AS (SELECT l_orderkey AS answer_id, max(l_quantity)::INT AS q, max(l_linenumber) AS p FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey AS answer_id, l_quantity::INT AS q, l_linenumber AS p, l_returnflag AS f FROM lineitem WHERE l_linenumber <> 7)
SELECT answer_id, 'detail_mismatch' AS type, q || ' volts' AS what FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.answer_id = s.answer_id AND e.q = s.q)
UNION ALL SELECT answer_id, 'detail_mismatch', 'pin ' || p FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.answer_id = s.answer_id AND e.p = s.p)
UNION ALL SELECT DISTINCT answer_id, 'dropped_warning', 'WARNING: hot' FROM e WHERE f = 'R'"""


def citation_keys(spark, sf_dir):
    """Sources as keys and labels, each once."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("answer_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("ord"), (F.col("l_suppkey") % 5).alias("doc_id"), F.concat(F.lit("Guide "), "l_returnflag").alias("title"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("page"), F.concat_ws(" > ", F.lit("Wiring"), "l_linestatus").alias("section"))
    return k.citation_keys(rows)


KEYS_SQL = """WITH s AS (SELECT l_orderkey AS answer_id, l_partkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS ord, l_suppkey % 5 AS doc_id, 'Guide ' || l_returnflag AS title, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS page, l_linestatus AS tail FROM lineitem),
n AS (SELECT answer_id, ord, doc_id || ':' || coalesce('p' || page, 'sWiring > ' || tail) AS key, title || ', ' || coalesce('Page ' || page, tail) AS label FROM s)
SELECT answer_id, key, arg_max(label, (ord, label)) AS label, min(ord) AS ord FROM n GROUP BY ALL"""


def gap_records(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.col("text").alias("question"), F.lit(None).cast("array<float>").alias("vector"), F.when(F.col("turn") > 0, F.array("conv_id")).alias("candidates"), F.when(F.col("turn") > 0, "below_threshold").otherwise("no_matches").alias("reason"))
    return k.gap_records(turns).select("gap_id", F.length("question").cast("long").alias("chars"), F.size("candidates").cast("long").alias("candidates"), "reason")


GAP_SQL = """SELECT sha256(conv_id || '-' || turn || '|' || text) AS gap_id, least(length(text), 2000)::BIGINT AS chars, (turn > 0)::BIGINT AS candidates, CASE WHEN turn > 0 THEN 'below_threshold' ELSE 'no_matches' END AS reason
FROM conversations WHERE role = 'user'"""


def _blocks(spark, sf_dir):
    """Lines of documents as blocks: every line of under 30 characters is a heading, level by its length, the rest are paragraphs."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    head = (F.length("text") < 30) & (F.length("text") > 0)
    none = {"items": "array<struct<marker:string,text:string>>", "ordered": "boolean", "callout_kind": "string", "page_end": "int"}
    return d.select("doc_id", "title", "pos", F.when(head, "heading").otherwise("paragraph").alias("type"), "text", F.when(head, F.length("text") % 4 + 1).alias("level"), F.floor(F.col("pos") / 5).cast("int").alias("page"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def heading_paths(spark, sf_dir):
    """The headings that hold at each line."""
    return section_paths(_blocks(spark, sf_dir)).select("doc_id", "pos", "section_path")


PATHS_SQL = """WITH b AS (SELECT doc_id, (unnest(generate_series(1, len(l))) - 1)::INT AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT *, CASE WHEN length(text) BETWEEN 1 AND 29 THEN length(text) % 4 + 1 END AS level FROM b),
w AS (SELECT doc_id, pos, """ + ", ".join(f"last_value(CASE WHEN level = {i} THEN pos END IGNORE NULLS) OVER v AS p{i}, last_value(CASE WHEN level = {i} THEN text END IGNORE NULLS) OVER v AS t{i}" for i in range(1, 5)) + """ FROM h WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, pos, coalesce(nullif(concat_ws(' > ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END, CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) THEN t4 END), ''), 'Doc ' || doc_id) AS section_path FROM w"""


def chunk_tree(spark, sf_dir):
    """Parents and children of all documents; greedy filling has no SQL."""
    return chunk_blocks(_blocks(spark, sf_dir)).select("doc_id", "chunk_index", "parent_index", "is_parent", "section_path", F.md5("text").alias("text_md5"), "page_from", "page_to", "kind")


def publish_swap(spark, sf_dir):
    """Versions of sources, of one of which the second goes live and the first is superseded."""
    d = table(spark, sf_dir, "documents")
    version = F.when(F.col("lang") == "en", 2).otherwise(1)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), version.alias("version"), (F.col("n_chars") > 3000).alias("is_parent"), F.array(F.lit(1.0)).alias("embedding"), (version == 1).alias("is_live"), F.lit(None).cast("timestamp").alias("deleted_at"))
    docs = d.select(F.col("source").alias("doc_id")).distinct().withColumn("version", F.lit(2))
    out = p.publish_version(chunks, docs, "src1", 2, F.lit("2024-01-01").cast("timestamp"))
    return out.select("chunk_id", "is_live", F.col("deleted_at").isNotNull().alias("gone"))


PUBLISH_SQL = "SELECT doc_id AS chunk_id, CASE WHEN source = 'src1' THEN lang = 'en' AND n_chars <= 3000 ELSE lang <> 'en' END AS is_live, source = 'src1' AND lang <> 'en' AS gone FROM documents"


def retire(spark, sf_dir):
    """A source out of the index: rows live and not, after and by table."""
    d = table(spark, sf_dir, "documents")
    docs = d.select(F.col("source").alias("doc_id")).distinct().withColumns({"status": F.lit("rag_completed"), "supersedes_doc_id": F.lit(None).cast("string")})
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.lit(True).alias("is_live"))
    images = _images(spark, sf_dir).select("image_id", "doc_id", F.lit(True).alias("is_live"))
    docs, chunks, images = p.retire(docs, chunks, images, "src3", "superseded", "src4")
    named = docs.select(F.concat_ws(":", F.lit("document"), "doc_id", "status", "supersedes_doc_id").alias("what"), F.lit(True).alias("is_live"), F.lit(1).cast("long").alias("n"))
    for name, t in (("chunks", chunks), ("images", images)):
        named = named.unionByName(t.groupBy("is_live").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "is_live", "n"))
    return named


RETIRE_SQL = """SELECT concat_ws(':', 'document', source, CASE WHEN source = 'src3' THEN 'superseded' ELSE 'rag_completed' END, CASE WHEN source = 'src4' THEN 'src3' END) AS what, true AS is_live, 1::BIGINT AS n FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT 'chunks', source <> 'src3', count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'images', page_id % 20 <> 3, count(*) FROM pages GROUP BY 2"""


def publishable(spark, sf_dir):
    """Orders stand for documents: lines are chunks, and a line flagged R a failed page."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("version"), "l_linenumber", "l_returnflag", "l_discount")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("version"))
    pages = line.select("doc_id", "version", F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"))
    chunks = line.select("doc_id", "version", (F.col("l_linenumber") == 1).alias("is_parent"), F.when(F.col("l_discount") < 0.09, 1).alias("embedding"))
    out = p.publishable(docs, pages, chunks)
    return out.select("doc_id", "n_chunks", "failed_pages", "publishes", p.final_status(F.col("n_chunks"), F.col("failed_pages"), F.col("doc_id") < 0).alias("status"))


PUBLISHABLE_SQL = """WITH a AS (SELECT o_orderkey AS doc_id, count(*) FILTER (l_linenumber <> 1)::BIGINT AS n_chunks, count(*) FILTER (l_returnflag = 'R')::BIGINT AS failed_pages, count(*) FILTER (l_linenumber <> 1 AND l_discount >= 0.09) AS bare
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT doc_id, n_chunks, failed_pages, n_chunks > 0 AND bare = 0 AND failed_pages = 0 AS publishes, CASE WHEN n_chunks = 0 THEN 'failed' WHEN failed_pages > 0 THEN 'completed_with_errors' ELSE 'rag_completed' END AS status FROM a"""


def card_approval(spark, sf_dir):
    """Customers' cards that want to go live, and what their latest order says of it."""
    c = table(spark, sf_dir, "customer")
    new = c.select(F.col("c_custkey").alias("card_id"), (F.col("c_acctbal") > 0).alias("is_live"), F.lit("draft").alias("review_status"), F.when(F.col("c_nationkey") != 3, 1).alias("symptom_vec"), F.lit(1).alias("resolution_vec"))
    old = c.select(F.col("c_custkey").alias("card_id"), (F.col("c_acctbal") > 5000).alias("is_live"))
    actions = table(spark, sf_dir, "orders").select(F.lit("call_card").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "O", "reject").otherwise("edit").alias("action"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("action_id"))
    good, bad = p.approve_cards(old, new, actions)
    return good.select("card_id", F.col("review_status").alias("result")).unionByName(bad.select("card_id", F.col("why").alias("result")))


APPROVAL_SQL = """WITH a AS (SELECT o_custkey AS card_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'reject' ELSE 'edit' END, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS card_id, c_acctbal > 0 AND c_acctbal <= 5000 AS turns, latest, c_nationkey FROM customer LEFT JOIN a ON card_id = c_custkey)
SELECT card_id, CASE WHEN NOT turns THEN 'draft' WHEN coalesce(latest, '') NOT IN ('approve', 'edit') THEN 'no approval' WHEN c_nationkey = 3 THEN 'no vectors' ELSE 'indexed' END AS result FROM c"""


def new_uploads(spark, sf_dir):
    """Uploads by byte hash, against documents that are done."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "lang")
    done = d.select("hash", F.when(F.col("lang") == "en", "completed").otherwise("failed").alias("status"))
    return p.new_uploads(d.select(F.col("doc_id").alias("upload_id"), "hash"), done).select("upload_id")


UPLOADS_SQL = "SELECT min(doc_id) AS upload_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text"

PAIRS = {
    "live_chunks": (live_chunks, LIVE_SQL),
    "stem_lexicon": (stem_lexicon, STEM_SQL),
    "text_search": (text_search, SEARCH_SQL),
    "match_chunks": (match_chunks, MATCH_SQL),
    "parents_of_matches": (parents_of_matches, PARENTS_SQL),
    "images_of_chunks": (images_of_chunks, IMAGES_SQL),
    "evidence_pictures": (evidence_pictures, PICTURES_SQL),
    "call_cards": (call_cards, CARDS_SQL),
    "faq_passages": (faq_passages, FAQ_SQL),
    "faq_resolutions": (faq_resolutions, RESOLUTION_SQL),
    "faq_ledger": (faq_ledger, LEDGER_SQL),
    "clarify_options": (clarify_options, CLARIFY_SQL),
    "citations_resolve": (citations_resolve, RESOLVE_SQL),
    "literal_guard": (literal_guard, GUARD_SQL),
    "citation_keys": (citation_keys, KEYS_SQL),
    "gap_records": (gap_records, GAP_SQL),
    "heading_paths": (heading_paths, PATHS_SQL),
    "chunk_tree": (chunk_tree, None),
    "publish_swap": (publish_swap, PUBLISH_SQL),
    "retire": (retire, RETIRE_SQL),
    "publishable": (publishable, PUBLISHABLE_SQL),
    "card_approval": (card_approval, APPROVAL_SQL),
    "new_uploads": (new_uploads, UPLOADS_SQL),
}
