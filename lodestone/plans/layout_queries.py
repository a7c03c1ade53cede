"""Pages from lines to blocks and chunks: documents' lines, set on pages, with heads, feet, marks and sizes of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_blocks
from lodestone.operators.layout import blocks, classify, demote, without_running_heads
from lodestone.plans.retrieval_queries import table

#: Lines of a page, and points between them.
LINES, PITCH = 56, 14.0


def _lines(spark, sf_dir):
    """Every line of every document at its place, with a head and a foot on each page; some begin with a mark, some are in capitals."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "said"))
    at, page = F.col("pos") % LINES, F.floor(F.col("pos") / LINES).cast("int")
    mark = F.element_at(F.array(*[F.lit(x) for x in ("", "WARNING: ", "", "• ", "Figure 3 ", "2.4 A", "Step 7: ", "", "", "", "Note: ")]), F.col("pos") % 11 + 1)
    mark = F.when(F.col("pos") % 11 == 2, F.concat((at % 9).cast("string"), F.lit(". "))).otherwise(mark)
    own = F.concat(mark, F.when(F.col("pos") % 13 == 0, F.translate("said", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("said")))
    text = F.when(at == 0, F.concat(F.lit("Manual "), "source", F.lit(" "), page.cast("string"))).when(at == LINES - 1, F.concat(F.lit("Page "), (page + 1).cast("string"))).otherwise(own)
    return d.select("doc_id", "pos", page.alias("page"), F.lit("0").alias("region"), (790.0 - at * PITCH).alias("y"), (8.0 + F.length(text) % 7).alias("size"), text.alias("text"), (F.length(text) % 3 == 0).alias("bold"))


LINES_SQL = r"""p AS (SELECT doc_id, source, unnest(range(len(s)))::INT AS pos, unnest(s) AS said FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)),
q AS (SELECT *, pos // 56 AS page, CASE pos % 11 WHEN 1 THEN 'WARNING: ' WHEN 2 THEN pos % 56 % 9 || '. ' WHEN 3 THEN '• ' WHEN 4 THEN 'Figure 3 ' WHEN 5 THEN '2.4 A' WHEN 6 THEN 'Step 7: ' WHEN 10 THEN 'Note: ' ELSE '' END || CASE WHEN pos % 13 = 0 THEN translate(said, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE said END AS own FROM p),
u AS (SELECT *, CASE pos % 56 WHEN 0 THEN 'Manual ' || source || ' ' || page WHEN 55 THEN 'Page ' || (page + 1) ELSE own END AS text FROM q),
l AS (SELECT doc_id, pos, page, 790.0::DOUBLE - pos % 56 * 14 AS y, 8.0::DOUBLE + length(text) % 7 AS size, text, length(text) % 3 = 0 AS bold FROM u)"""


def running_heads(spark, sf_dir):
    """Lines without what repeats at the top and bottom of pages."""
    rows = _lines(spark, sf_dir)
    pages = rows.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    return without_running_heads(rows, pages).select("doc_id", "pos", F.md5("text").alias("text_md5"))


HEADS_SQL = rf"""WITH {LINES_SQL},
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM l GROUP BY 1),
k AS (SELECT l.*, n, y > 744 OR y < 56 AS band, trim(regexp_replace(lower(text), '\d+', '#', 'g')) AS key FROM l JOIN n USING (doc_id)),
o AS (SELECT doc_id, key, count(DISTINCT page) AS often FROM k WHERE band GROUP BY ALL)
SELECT k.doc_id, pos, md5(text) AS text_md5 FROM k LEFT JOIN o ON o.doc_id = k.doc_id AND o.key = k.key
WHERE NOT band OR (NOT regexp_matches(trim(text), '(?i)^(page\s*)?\d+(\s*(of|/)\s*\d+)?$') AND NOT (n >= 3 AND coalesce(often, 0) >= greatest(2, ceil(n * 0.3))))"""


def _kinds(spark, sf_dir):
    return classify(_lines(spark, sf_dir), F.lit(10.0), F.lit(0.1))


def line_kinds(spark, sf_dir):
    """What each line is, by the first rule that fits."""
    return _kinds(spark, sf_dir).select("doc_id", "pos", "type", "basis", "number", "callout_kind", F.md5("rest").alias("rest_md5"))


KINDS = LINES_SQL + r""",
a AS (SELECT *, regexp_replace(text, '^[^A-Za-z0-9•●▪■◦‣▸►\-–—]+', '') AS s FROM l),
b AS (SELECT *, regexp_replace(s, '[^A-Za-z]', '', 'g') AS letters, regexp_matches(regexp_replace(s, ':$', ''), '[.!?]$') AS ends, contains(s, ' | ') AS cell,
  coalesce(nullif(regexp_extract(s, '^(\d{1,3})[.)]\s+\S', 1), ''), nullif(regexp_extract(s, '(?i)^Step\s+(\d{1,3})\s*[:.)\-–]\s*', 1), '')) AS num,
  '^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|ATTENTION|NOTE)\b\s*[!:.\-–—]*\s*|^(Warning|Caution|Danger|Notice|Important|Attention|Note)\s*[!:]\s*' AS callout FROM a),
c AS (SELECT *, length(s) <= 90 AND NOT ends AS short, CASE WHEN regexp_matches(s, '^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|ATTENTION|NOTE)\b\s*[!:.\-–—]*\s*|^(Warning|Caution|Danger|Notice|Important|Attention|Note)\s*[!:]\s*') THEN 'callout'
  WHEN regexp_matches(s, '(?i)^(FIGURE|FIG\.?|TABLE|DIAGRAM|PHOTO|IMAGE)\s*[A-Z]?\d+') THEN 'caption'
  WHEN size >= 13 AND length(s) <= 90 AND NOT ends AND length(letters) >= 3 THEN 'size'
  WHEN regexp_matches(s, '^(\d+(?:\.\d+)+)[.)]?\s+[A-Z][A-Za-z]') AND NOT regexp_matches(s, '(?i)^\d+(?:\.\d+)+\s*(?:watts?|amps?|volts?|vdc|vac|v|a|mm|cm|in|inch|lbs?|kg|hz|ohms?|awg|ft|nm|psi|mph|fpm)\b') AND length(s) <= 100 AND NOT ends THEN 'numbered'
  WHEN num IS NOT NULL AND NOT cell THEN 'num' WHEN (regexp_matches(s, '^[•●▪■◦‣▸►]\s*\S') OR regexp_matches(s, '^[-–—]\s+[A-Za-z]{2,}')) AND NOT cell THEN 'bullet'
  WHEN length(letters) >= 4 AND length(s) <= 60 AND letters = upper(letters) AND NOT ends THEN 'caps' WHEN bold AND length(s) <= 90 AND NOT ends AND length(letters) >= 3 THEN 'bold' ELSE 'text' END AS why FROM b),
d AS (SELECT doc_id, pos, page, y, size, text, CASE WHEN why IN ('size', 'numbered', 'caps', 'bold') THEN 'heading' WHEN why IN ('num', 'bullet') THEN 'item' ELSE why END AS type, CASE WHEN why IN ('callout', 'caption', 'text') THEN NULL ELSE why END AS basis, CASE WHEN why = 'num' THEN num::INT END AS number,
  CASE WHEN why = 'callout' THEN lower(coalesce(nullif(regexp_extract(s, '^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|ATTENTION|NOTE)\b\s*[!:.\-–—]*\s*|^(Warning|Caution|Danger|Notice|Important|Attention|Note)\s*[!:]\s*', 1), ''), regexp_extract(s, '^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|ATTENTION|NOTE)\b\s*[!:.\-–—]*\s*|^(Warning|Caution|Danger|Notice|Important|Attention|Note)\s*[!:]\s*', 2))) END AS callout_kind,
  CASE why WHEN 'callout' THEN regexp_replace(s, '^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|ATTENTION|NOTE)\b\s*[!:.\-–—]*\s*|^(Warning|Caution|Danger|Notice|Important|Attention|Note)\s*[!:]\s*', '') WHEN 'num' THEN regexp_replace(regexp_replace(s, '^(\d{1,3})[.)]\s+', ''), '(?i)^Step\s+(\d{1,3})\s*[:.)\-–]\s*', '') WHEN 'bullet' THEN regexp_replace(s, '^[•●▪■◦‣▸►]\s*|^[-–—]\s+', '') ELSE text END AS rest FROM c)"""
KINDS_SQL = f"WITH {KINDS} SELECT doc_id, pos, type, basis, number, callout_kind, md5(rest) AS rest_md5 FROM d"


def demoted_lines(spark, sf_dir):
    """Headings that are text after all: without prose below them, or too many in a row."""
    return demote(_kinds(spark, sf_dir), PITCH).select("doc_id", "pos", "type")


DEMOTED_SQL = f"""WITH {KINDS},
e AS (SELECT *, lead(page) OVER w = page AND y - lead(y) OVER w <= 35 AND lead(type) OVER w IN ('text', 'item', 'callout') AND length(lead(text) OVER w) >= 20 AND regexp_matches(lead(text) OVER w, '[a-z]') AS prose FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT * REPLACE (CASE WHEN type = 'heading' AND basis IN ('caps', 'bold') AND NOT coalesce(prose, false) THEN 'text' ELSE type END AS type) FROM e),
g AS (SELECT *, CASE WHEN type = 'heading' AND lag(type) OVER w = 'heading' AND lag(page) OVER w = page AND abs(lag(size) OVER w - size) < 0.05 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g)
SELECT doc_id, pos, CASE WHEN type = 'heading' AND count(*) OVER (PARTITION BY doc_id, run) >= 3 THEN 'text' ELSE type END AS type FROM h"""


def _blocks(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    pages = rows.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    kept = without_running_heads(rows, pages)
    return blocks(demote(classify(kept, F.lit(10.0), F.lit(0.1)), PITCH), PITCH)


def page_blocks(spark, sf_dir):
    """Blocks of all documents: headings, paragraphs, lists, tables, callouts and captions; tests hold the rules against fixtures."""
    return _blocks(spark, sf_dir).select("doc_id", "pos", "type", F.md5("text").alias("text_md5"), "level", F.size("items").alias("n_items"), "ordered", "callout_kind", "page", "page_end")


def page_chunks(spark, sf_dir):
    """Chunks of those blocks, so that lists, tables and callouts are filled too; greedy filling has no SQL."""
    titled = _blocks(spark, sf_dir).withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    return chunk_blocks(titled).select("doc_id", "chunk_index", "parent_index", "is_parent", "section_path", F.md5("text").alias("text_md5"), "page_from", "page_to", "kind", "has_warning", "step_count", "part")


PAIRS = {
    "running_heads": (running_heads, HEADS_SQL),
    "line_kinds": (line_kinds, KINDS_SQL),
    "demoted_lines": (demoted_lines, DEMOTED_SQL),
    "page_blocks": (page_blocks, None),
    "page_chunks": (page_chunks, None),
}
