"""Documents, pages, conversations and event frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators.conversation import history, steps
from lodestone.plans.retrieval_queries import table
from lodestone.shared import new_folder
from lodestone.sources.frames import answer_text, parse_frames
from lodestone.sources.wires import page_heads, parse_wires
from lodestone.streaming.jobs import drain


def history_budget(spark, sf_dir):
    h = history(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return h.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("said")).cast("long").alias("chars"), F.min("turn").alias("first_turn"))


HISTORY_SQL = """WITH r AS (SELECT *, substr(text, 1, CASE WHEN role = 'user' THEN 500 ELSE 900 END) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE trim(text) <> ''),
t AS (SELECT *, sum(length(said)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total FROM r WHERE back <= 6)
SELECT conv_id, count(*)::BIGINT AS turns, sum(length(said))::BIGINT AS chars, min(turn) AS first_turn FROM t WHERE total <= 4000 GROUP BY conv_id"""


def conversation_fold(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.md5(said).alias("text_md5"))


FOLD_SQL = "SELECT conv_id, count(*)::BIGINT AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id"


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "noise").otherwise("delta")
    data = F.when(F.col("event_id") % 11 == 0, F.lit(": ping")).otherwise(F.concat(F.lit('data: {"type":"'), kind, F.lit('","text":"'), F.col("event_type"), F.lit('"}')))
    ordered = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", data.alias("d")))).alias("f"))
    return ordered.select("user_id", F.concat(F.array_join(F.transform("f", lambda x: x["d"]), "\n\n"), F.lit("\n\ndata: {\"type\":\"del")).alias("text"))


def sse_parse(spark, sf_dir):
    out = answer_text(parse_frames(_frames(spark, sf_dir)), "user_id")
    return out.select("user_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


SSE_SQL = """SELECT user_id, length(string_agg(event_type, '' ORDER BY event_id))::BIGINT AS chars, md5(string_agg(event_type, '' ORDER BY event_id)) AS text_md5
FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY user_id"""


def html_title_links(spark, sf_dir):
    """Each page's title and its links in order."""
    return page_heads(table(spark, sf_dir, "pages")).select("page_id", "title", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


TITLE_SQL = """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
  len(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1))::BIGINT AS n, array_to_string(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), ' ') AS links FROM pages"""


def wire_rows(spark, sf_dir):
    """Rows of wires made of pages: their URL's parts as cells, sections and notes between."""
    cell = lambda c: F.concat(F.lit('<td class="wires">'), c, F.lit("</td>"))
    part = lambda i: F.coalesce(F.get(F.split("url", "/"), F.lit(i)), F.lit("none"))
    row = F.concat(F.lit('<tr class="title"><td>Host '), part(2), F.lit('</td></tr><tr class="row1">'), cell(part(2)), cell(part(3)), cell(F.lit("+&nbsp;<b>x</b>")), cell(part(0)), F.lit('</tr><tr class="wirenote"><td>Note '), part(3), F.lit('</td></tr><tr class="row2">'), cell(F.lit("Ignition")), cell(F.lit("blue")), cell(F.lit("-")), cell(F.lit("kick")), F.lit("</tr>"))
    out = parse_wires(table(spark, sf_dir, "pages").select("page_id", row.alias("html")))
    return out.select("page_id", "ordinal", "section", "function", "color", "polarity", "location", "notes")


WIRE_SQL = """WITH p AS (SELECT page_id, string_split(url, '/') AS u FROM pages)
SELECT page_id, 1::INT AS ordinal, 'Host ' || u[3] AS section, u[3] AS function, coalesce(u[4], 'none') AS color, '+ x' AS polarity, u[1] AS location, 'Note ' || coalesce(u[4], 'none') AS notes FROM p
UNION ALL SELECT page_id, 2, 'Host ' || u[3], 'Ignition', 'blue', '-', 'kick', NULL FROM p"""


def answer_steps(spark, sf_dir):
    """Numbered steps of answers; a conversation's words after its marks stand for an answer."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Do this:\n1. Caution "), F.substring("text", 1, 20), F.lit("\n"), F.when(F.col("turn") == 1, F.lit("3")).otherwise(F.lit("2")), F.lit(") Next\nDone")).alias("text"))
    return steps(c.withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key").select("key", "n", "warns")


STEPS_SQL = """SELECT conv_id || '-' || turn AS key, n::INT AS n, n = 1 AS warns FROM conversations, (VALUES (1), (2)) v(n) WHERE turn <> 1"""


def repeated_lines(spark, sf_dir):
    """Lines, digits read as #, that stand in more than one document."""
    line = F.explode(F.array_distinct(F.split(F.regexp_replace("text", "[0-9]", "#"), "\n"))).alias("line")
    d = table(spark, sf_dir, "documents").select(line).where("line <> ''")
    return d.groupBy("line").agg(F.count("*").alias("documents")).where("documents > 1").select(F.md5("line").alias("line_md5"), "documents")


LINES_SQL = """SELECT md5(line) AS line_md5, count(*)::BIGINT AS documents FROM (SELECT unnest(list_distinct(string_split(regexp_replace(text, '[0-9]', '#', 'g'), chr(10)))) AS line FROM documents)
WHERE line <> '' GROUP BY line HAVING count(*) > 1"""


def paragraph_explode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p"))
    return d.select("doc_id", "pos", F.length("p").cast("long").alias("chars"))


PARAGRAPH_SQL = "SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos, length(unnest(string_split(text, chr(10))))::BIGINT AS chars FROM documents"


def chunk_pack_stats(spark, sf_dir):
    """Token estimates by source: least, upper median by counts, most."""
    d = table(spark, sf_dir, "documents").select("source", token_estimate(F.col("text")).alias("t")).groupBy("source", "t").agg(F.count("*").alias("c"))
    d = d.withColumns({"upto": F.sum("c").over(Window.partitionBy("source").orderBy("t")), "total": F.sum("c").over(Window.partitionBy("source"))})
    return d.groupBy("source").agg(F.min("t").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("t"))).alias("median"), F.max("t").alias("most"))


PACK_SQL = """SELECT source, min(t) AS least, list_sort(list(t))[floor(count(*) / 2)::INT + 1] AS median, max(t) AS most
FROM (SELECT source, ceil(length(text) / 4.0)::BIGINT AS t FROM documents) GROUP BY source"""


def stream_counts(spark, sf_dir):
    """Events by user and kind, from the same file as a stream; the SQL counts them at rest."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return drain(stream, ["user_id", "event_type"], new_folder(spark, "stream"))


STREAM_SQL = "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL"

PAIRS = {
    "history_budget": (history_budget, HISTORY_SQL),
    "conversation_fold": (conversation_fold, FOLD_SQL),
    "sse_parse": (sse_parse, SSE_SQL),
    "html_title_links": (html_title_links, TITLE_SQL),
    "repeated_lines": (repeated_lines, LINES_SQL),
    "paragraph_explode": (paragraph_explode, PARAGRAPH_SQL),
    "chunk_pack_stats": (chunk_pack_stats, PACK_SQL),
    "stream_counts": (stream_counts, STREAM_SQL),
    "wire_rows": (wire_rows, WIRE_SQL),
    "answer_steps": (answer_steps, STEPS_SQL),
}
