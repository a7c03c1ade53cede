"""Vehicles: the catalogue's levels, a crawl that goes on, pictures by address and content, the report; folders and procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import crawl, listing
from lodestone.operators.conversation import procedures
from lodestone.operators.layout import regions
from lodestone.plans.retrieval_queries import table
from lodestone.sources.catalog import lattice


def _lattice(spark, sf_dir):
    """Nations and regions are makes, the years of their customers' orders years, priorities models, orders key types. Regions have
    no years, 1900 has no models, and the model ``bare`` no key types."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    makes = nation.select(F.col("n_name").alias("make")).unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("region "), "r_name").alias("make")))
    sold = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = sold.select(F.col("n_name").alias("make"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderpriority").alias("model"), F.col("o_orderkey").cast("string").alias("recnum"), F.col("o_orderstatus").alias("key_type"))
    years = keys.select("make", "year").distinct()
    models = keys.select("make", "year", "model").distinct().unionByName(years.withColumn("model", F.lit("bare")))
    return makes, years.unionByName(nation.select(F.col("n_name").alias("make"), F.lit("1900").alias("year"))), models, keys


LATTICE = """k AS (SELECT n_name AS make, year(o_orderdate)::VARCHAR AS year, o_orderpriority AS model, o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _crawled(spark, sf_dir):
    """Two runs: at the first every seventh order can't be read, at the second every 35th; those of a low price have no wires."""
    makes, years, models, keys = _lattice(spark, sf_dir)
    price = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("recnum"), F.when(F.col("o_totalprice") < 50000, 0).otherwise(3).alias("wires"))
    pages = keys.select(*crawl.KEY).join(price, "recnum")
    fails = lambda n: F.when(F.col("recnum").cast("long") % n == 0, F.lit("timeout"))
    marks = spark.createDataFrame([], "make string, year string, model string, state string")
    vehicles = spark.createDataFrame([], "make string, year string, model string, recnum string, key_type string, status string, problem string")
    # The first run stops before the makes behind M.
    early = [t.where(F.col("make") < "M") for t in (makes, years, models, keys)]
    marks, vehicles = crawl.resume(*early, pages.withColumn("problem", fails(7)), marks, vehicles)
    return crawl.resume(makes, years, models, keys, pages.withColumn("problem", fails(35)), marks, vehicles)


def crawl_marks(spark, sf_dir):
    return _crawled(spark, sf_dir)[0]


MARKS_SQL = f"""WITH {LATTICE}
SELECT 'region ' || r_name AS make, '' AS year, '' AS model, 'no_years' AS state FROM region
UNION ALL SELECT n_name, '1900', '', 'no_models' FROM nation
UNION ALL SELECT DISTINCT make, year, 'bare', 'no_keys' FROM k
UNION ALL SELECT make, year, model, 'done' FROM k GROUP BY ALL HAVING NOT bool_or(o_orderkey % 35 = 0)
UNION ALL SELECT n_name, '', '', 'no_years' FROM nation WHERE false"""


def crawl_vehicles(spark, sf_dir):
    return _crawled(spark, sf_dir)[1].select("make", "year", "model", "recnum", "key_type", "status", "problem")


VEHICLES_SQL = f"""WITH {LATTICE}
SELECT make, year, model, o_orderkey::VARCHAR AS recnum, o_orderstatus AS key_type, CASE WHEN o_orderkey % 35 = 0 THEN 'error' WHEN o_totalprice < 50000 THEN 'no wire table' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 35 = 0 THEN 'timeout' END AS problem FROM k
UNION ALL SELECT DISTINCT make, year, 'bare', NULL, NULL, 'no key types', NULL FROM k"""


def _pictures(spark, sf_dir):
    """Documents are downloads: an address for some of each source's, with the text's digest; those of the first languages are stored before."""
    d = table(spark, sf_dir, "documents")
    url = F.concat_ws("/", "source", (F.col("n_chars") % 500).cast("string"))
    fetched = d.select(F.col("doc_id").alias("seq"), url.alias("url"), F.when(F.col("doc_id") % 11 != 0, F.md5("text")).alias("hash"), "lang")
    empty = spark.createDataFrame([], "url string, image_id string, hash string")
    old, images = crawl.store_pictures(fetched.where("lang < 'f'").drop("lang"), empty.select("url", "image_id"), empty.select("image_id", "hash"))
    return crawl.store_pictures(fetched.drop("lang"), old.select("url", "image_id"), images)


def picture_sources(spark, sf_dir):
    """What each address means after two runs, and by which key."""
    return _pictures(spark, sf_dir)[0]


PICTURES_SQL = """WITH f AS (SELECT doc_id AS seq, source || '/' || n_chars % 500 AS url, CASE WHEN doc_id % 11 <> 0 THEN md5(text) END AS hash, lang FROM documents),
a AS (SELECT url, min(seq) AS seq, arg_min(hash, seq) AS hash FROM f WHERE hash IS NOT NULL AND lang < 'f' GROUP BY url),
b AS (SELECT url, min(seq) AS seq, arg_min(hash, seq) AS hash FROM f WHERE hash IS NOT NULL AND url NOT IN (SELECT url FROM a) GROUP BY url)
SELECT url, sha256(hash) AS image_id, 'url' AS how FROM a
UNION ALL SELECT url, sha256(hash), CASE WHEN hash NOT IN (SELECT hash FROM a) AND row_number() OVER (PARTITION BY hash ORDER BY seq) = 1 THEN 'new' ELSE 'content' END FROM b"""


def stored_pictures(spark, sf_dir):
    """Images that the second run adds."""
    return _pictures(spark, sf_dir)[1]


STORED_SQL = f"""SELECT image_id, hash FROM ({PICTURES_SQL.replace("SELECT url, sha256(hash), CASE", "SELECT hash AS url, sha256(hash), CASE")}) JOIN (SELECT DISTINCT md5(text) AS hash FROM documents) ON url = hash WHERE how = 'new'"""


def tracker_rows(spark, sf_dir):
    """The report over orders as vehicles and their lines as wires."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 10 == 0, "error").when(F.col("o_orderkey") % 10 == 1, "no wire table").otherwise("ok")
    year = F.when(F.col("o_orderkey") % 13 == 0, "classic").otherwise(F.year("o_orderdate").cast("string"))
    vehicles = o.select(F.col("o_orderkey").alias("vehicle"), F.col("o_orderpriority").alias("make"), year.alias("year"), F.col("o_orderstatus").alias("model"), status.alias("status"))
    line = table(spark, sf_dir, "lineitem")
    function = F.when(F.col("l_linenumber") % 4 == 1, "Constant +12 Volts (2)").when(F.col("l_linenumber") % 4 == 2, "Ignition").when(F.col("l_linenumber") % 4 == 3, "Ignition Interrupt").otherwise("CONSTANT 12V")
    wires = line.select(
        F.col("l_orderkey").alias("vehicle"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"), function.alias("function"), F.when(F.col("l_partkey") % 5 == 0, "NULL").otherwise(F.col("l_returnflag")).alias("color"),
        F.concat(F.lit("("), "l_linestatus", F.lit(")")).alias("polarity"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise("kick panel").alias("location"), F.when(F.col("l_partkey") % 7 == 0, "30A").alias("notes"), F.when(F.col("l_partkey") % 2 == 0, (F.col("l_partkey") % 4).cast("string")).alias("photo"),
    )
    return crawl.tracker(vehicles, wires).select("vehicle", "ordinal", "power_option", "ignition_option", "power_label", "ignition_label", "year_number", "embedded")


TRACKER_SQL = r"""WITH w AS (SELECT l_orderkey AS vehicle, l_linenumber * 10000000 + l_partkey AS pos, CASE l_linenumber % 4 WHEN 1 THEN 'Constant +12 Volts (2)' WHEN 2 THEN 'Ignition' WHEN 3 THEN 'Ignition Interrupt' ELSE 'CONSTANT 12V' END AS function,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS color, '(' || l_linestatus || ')' AS polarity, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'kick panel' END AS location, CASE WHEN l_partkey % 7 = 0 THEN ' (30A)' ELSE '' END AS notes, CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 4)::VARCHAR END AS photo FROM lineitem),
d AS (SELECT vehicle, function LIKE 'I%' AS ign, color, polarity, location, function, photo, min((pos, function || ': ' || concat_ws(' ', color, polarity, location) || notes)) AS o FROM w WHERE function <> 'Ignition Interrupt' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY vehicle, ign ORDER BY o) AS ordinal FROM d),
j AS (SELECT coalesce(p.vehicle, i.vehicle) AS vehicle, coalesce(p.ordinal, i.ordinal) AS ordinal, p.o[2] AS power_option, p.photo AS pp, i.o[2] AS ignition_option, i.photo AS ip FROM (SELECT * FROM n WHERE NOT ign) p FULL JOIN (SELECT * FROM n WHERE ign) i ON p.vehicle = i.vehicle AND p.ordinal = i.ordinal),
v AS (SELECT o_orderkey AS vehicle, o_orderkey % 10 AS s, CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate)::INT END AS year_number FROM orders)
SELECT v.vehicle, coalesce(ordinal, 1)::INT AS ordinal, power_option, ignition_option,
  CASE WHEN s = 0 THEN 'Error' WHEN s = 1 THEN 'Not found on site' WHEN power_option IS NOT NULL THEN CASE WHEN pp IS NULL THEN 'Not found on site' ELSE 'Found' END WHEN coalesce(ordinal, 1) = 1 THEN 'Not found on site' ELSE '' END AS power_label,
  CASE WHEN s = 0 THEN 'Error' WHEN s = 1 THEN 'Not found on site' WHEN ignition_option IS NOT NULL THEN CASE WHEN ip IS NULL THEN 'Not found on site' ELSE 'Found' END WHEN coalesce(ordinal, 1) = 1 THEN 'Not found on site' ELSE '' END AS ignition_label,
  year_number, (count(pp) OVER () + count(ip) OVER ()) <= 1000 AS embedded FROM v LEFT JOIN j ON j.vehicle = v.vehicle"""


def _answers(spark, sf_dir):
    """Endpoints' answers made of the tables: nations as makes; years of the even ones at the first source, of the others at the second, whose first answer is broken or empty."""
    makes, years, models, keys = _lattice(spark, sf_dir)
    makes, even = makes.where("make NOT LIKE 'region%'"), F.length("make") % 2 == 0
    array = lambda c: F.to_json(F.sort_array(F.collect_list(c)))
    none = F.lit(None).cast("string")
    row = lambda df, api, source, body, year=none, model=none: df.select(F.lit(api).alias("api"), source.cast("int").alias("source"), F.col("make").alias("make"), year.alias("year"), model.alias("model"), body.alias("body"))
    out = row(makes.groupBy().agg(array(F.struct(F.col("make").alias("name"))).alias("b")).withColumn("make", none), "makes", F.lit(1), F.col("b"))
    per_make = years.groupBy("make").agg(array(F.struct(F.col("year").cast("int").alias("year"))).alias("objects"), array("year").alias("plain"))
    out = out.unionByName(row(per_make.where(even), "years", F.lit(1), F.col("objects"))).unionByName(row(per_make.where(even), "years", F.lit(2), F.lit('["2999"]')))
    out = out.unionByName(row(per_make.where(~even), "years", F.lit(1), F.when(F.startswith("make", F.lit("A")), "[]").otherwise("{broken"))).unionByName(row(per_make.where(~even), "years", F.lit(2), F.col("plain")))
    per_year = models.groupBy("make", "year").agg(array(F.struct(F.col("model").alias("m"))).alias("b"))
    out = out.unionByName(row(per_year, "models", F.lit(1) + F.length("make") % 2, F.col("b"), F.col("year")))
    per_model = keys.groupBy("make", "year", "model").agg(array(F.struct(F.col("recnum").alias("pid"), F.col("key_type").alias("kt"))).alias("b"))
    return out.unionByName(row(per_model, "keys", F.lit(1), F.col("b"), F.col("year"), F.col("model")))


def catalog_levels(spark, sf_dir):
    """All levels of the catalogue, each value with its level."""
    makes, years, models, keys = lattice(_answers(spark, sf_dir))
    none = lambda c: F.lit(None).cast("string").alias(c)
    out = makes.select(F.lit("make").alias("level"), "make", none("year"), none("model"), none("recnum"), none("key_type"))
    out = out.unionByName(years.select(F.lit("year").alias("level"), "make", "year", none("model"), none("recnum"), none("key_type")))
    out = out.unionByName(models.select(F.lit("model").alias("level"), "make", "year", "model", none("recnum"), none("key_type")))
    return out.unionByName(keys.select(F.lit("key").alias("level"), "make", "year", "model", "recnum", "key_type"))


CATALOG_SQL = f"""WITH {LATTICE}
SELECT 'make' AS level, n_name AS make, NULL AS year, NULL AS model, NULL AS recnum, NULL AS key_type FROM nation
UNION ALL SELECT 'year', n_name, '1900', NULL, NULL, NULL FROM nation
UNION ALL SELECT DISTINCT 'year', make, year, NULL, NULL, NULL FROM k
UNION ALL SELECT DISTINCT 'model', make, year, model, NULL, NULL FROM k UNION ALL SELECT DISTINCT 'model', make, year, 'bare', NULL, NULL FROM k
UNION ALL SELECT 'key', make, year, model, o_orderkey::VARCHAR, o_orderstatus FROM k"""


def _folders(spark, sf_dir):
    """Customers are folders, three in each, of which some are a cycle; parts are files in them, and suppliers shortcuts to parts and folders."""
    c, p, s = (table(spark, sf_dir, t) for t in ("customer", "part", "supplier"))
    at, text = F.col("c_custkey"), lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    parent = F.when(at % 50 == 48, text("F", at + 1)).when(at % 50 == 49, text("F", at - 1)).otherwise(text("F", F.floor(at / 3)))
    none = [F.lit(None).cast("string").alias(c) for c in ("target_id", "target_mime")]
    folders = c.select(text("F", at).alias("id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("name"), F.lit(listing.FOLDER).alias("mime"), parent.alias("parent"), *none)
    kinds = [("application/pdf", ""), ("application/pdf", ".PDF"), ("application/octet-stream", ".docx"), ("image/png", ".png"), ("application/vnd.ms-excel", ".xlsx"), ("application/msword", ".doc"), ("video/mp4", ".mp4"), ("application/vnd.google-apps.document", ""), ("application/vnd.google-apps.form", ""), ("text/plain", ".txt"), ("image/gif", "")]
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    files = p.select(text("P", F.col("p_partkey")).alias("id"), F.concat("p_name", pick(1)).alias("name"), pick(0).alias("mime"), text("F", F.floor(F.col("p_partkey") * 3 / 4)).alias("parent"), *none)
    n = F.col("s_suppkey")
    target = F.when(n % 5 == 0, text("F", n)).when(n % 5 != 1, text("P", n * 3))
    cuts = s.select(text("S", n).alias("id"), F.concat("s_name", F.lit(".pdf")).alias("name"), F.lit(listing.SHORTCUT).alias("mime"), text("F", n % 7).alias("parent"), target.alias("target_id"))
    known = files.select(F.col("id").alias("target_id"), F.col("mime").alias("target_mime")).unionByName(folders.select(F.col("id").alias("target_id"), F.col("mime").alias("target_mime")))
    return folders.unionByName(files).unionByName(cuts.join(known, "target_id", "left").select(folders.columns))


def folder_listing(spark, sf_dir):
    files, _ = listing.listing(_folders(spark, sf_dir), "F0")
    return files.select("id", "file_name", "type", "folder")


def folder_skips(spark, sf_dir):
    return listing.listing(_folders(spark, sf_dir), "F0")[1]


FOLDERS = """fo AS (SELECT 'F' || c_custkey AS id, c_mktsegment || ' ' || c_nationkey AS name, 'F' || CASE c_custkey % 50 WHEN 48 THEN c_custkey + 1 WHEN 49 THEN c_custkey - 1 ELSE c_custkey // 3 END AS parent FROM customer WHERE c_custkey > 0),
tree(id, names, ids) AS (SELECT 'F0', []::VARCHAR[], []::STRUCT(n VARCHAR, i VARCHAR)[] UNION ALL SELECT fo.id, list_append(names, name), list_append(ids, {'n': name, 'i': fo.id}) FROM fo JOIN tree ON parent = tree.id),
fi AS (SELECT 'P' || p_partkey AS id, p_partkey % 11 AS k, p_name AS base, p_name || ['', '.PDF', '.docx', '.png', '.xlsx', '.doc', '.mp4', '', '', '.txt', ''][p_partkey % 11 + 1] AS name, 'F' || p_partkey * 3 // 4 AS parent FROM part),
al AS (SELECT id, k, name, parent, CASE k WHEN 0 THEN name || '.pdf' WHEN 7 THEN name || '.pdf' ELSE name END AS file_name FROM fi
  UNION ALL SELECT fi.id, k, s_name || '.pdf', 'F' || s_suppkey % 7, s_name || '.pdf' FROM supplier JOIN fi ON fi.id = 'P' || s_suppkey * 3 WHERE s_suppkey % 5 > 1
  UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey <= (SELECT max(c_custkey) FROM customer) THEN 20 ELSE 21 END, s_name || '.pdf', 'F' || s_suppkey % 7, s_name || '.pdf' FROM supplier WHERE s_suppkey % 5 <= 1),
ty AS (SELECT al.*, names, ids, CASE WHEN k = 20 THEN 'Shortcut to a folder' WHEN k = 21 THEN 'Shortcut' WHEN k = 7 THEN 'Google Doc' WHEN k = 8 THEN 'Other Google file' WHEN file_name ILIKE '%.pdf' THEN 'PDF' WHEN file_name LIKE '%.docx' THEN 'Word' WHEN file_name LIKE '%.png' THEN 'Image'
  WHEN name LIKE '%.doc' THEN 'Old Word (.doc)' WHEN name LIKE '%.xlsx' THEN 'Excel file' WHEN k = 6 THEN 'Video' WHEN k = 10 THEN 'Other image' ELSE 'Other' END AS type FROM al JOIN tree ON al.parent = tree.id),
ra AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ids, name, id) AS r FROM ty WHERE type IN ('PDF', 'Word', 'Image', 'Google Doc'))"""
LISTING_SQL = f"WITH RECURSIVE {FOLDERS} SELECT id, file_name, type, array_to_string(names, ' / ') AS folder FROM ra WHERE r = 1"
SKIPS_SQL = f"""WITH RECURSIVE {FOLDERS} SELECT type, count(*)::BIGINT AS n FROM ty WHERE type NOT IN ('PDF', 'Word', 'Image', 'Google Doc') GROUP BY type
UNION ALL SELECT 'Shortcut to a file already listed', count(*) FROM ra WHERE r > 1 HAVING count(*) > 0"""


def answer_procedures(spark, sf_dir):
    """Documents as answers: every fourth line is numbered, and pages are cited where the id is even."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x, i: F.when((i % 4 == 1) & (F.trim(x) != ""), F.concat((F.floor(i / 4) + 1).cast("string"), F.lit(") "), x, F.lit(" (Page 7)."))).otherwise(x))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"), F.when(F.col("doc_id") % 2 == 0, F.array("doc_id")).alias("sources"))
    return procedures(d, "doc_id", sources="sources").select("doc_id", "pos", "n", "note", F.md5("text").alias("text_md5"), "warns", "with_sources")


PROCEDURE_SQL = r"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
m AS (SELECT doc_id, i, CASE WHEN i % 4 = 1 AND trim(x) <> '' THEN (i // 4 + 1) || ') ' || x || ' (Page 7).' ELSE x END AS x FROM l),
p AS (SELECT *, nullif(regexp_extract(x, '^\s*(\d{1,2})[.)]\s+(\S.*)$', 1), '')::INT AS num, regexp_replace(x, '^\s+|\s+$', '', 'g') AS bare FROM m),
q AS (SELECT *, count(num) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM p),
b AS (SELECT *, step > 0 AND num IS NULL AND bare <> '' AND coalesce(bool_or(bare = '') OVER (PARTITION BY doc_id, step ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closes FROM q),
z AS (SELECT *, bool_or(closes) OVER (PARTITION BY doc_id ORDER BY i) AS closed FROM b),
g AS (SELECT doc_id, coalesce(count(num) >= 2 AND (arg_min(num, i) FILTER (num IS NOT NULL)) = 1 AND NOT bool_or(closed AND num IS NOT NULL), false) AS good FROM z GROUP BY doc_id),
y AS (SELECT z.*, CASE WHEN closed THEN 2 WHEN step = 0 THEN 0 ELSE 1 END AS part FROM z JOIN g USING (doc_id) WHERE good),
t AS (SELECT doc_id, part, CASE WHEN part = 1 THEN step ELSE 0 END AS grp, CASE WHEN part = 1
    THEN string_agg(CASE WHEN num IS NOT NULL THEN trim(regexp_extract(x, '^\s*(\d{1,2})[.)]\s+(\S.*)$', 2)) ELSE bare END, ' ' ORDER BY i) FILTER (num IS NOT NULL OR bare <> '')
    ELSE regexp_replace(regexp_replace(string_agg(bare, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS raw FROM y GROUP BY doc_id, part, grp),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\s*\(\s*(?:pages?\s+[\d,\s&–-]+|section:\s*[^)]+)\)', '', 'gi'), '\s+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM t),
s AS (SELECT doc_id, part, grp, CASE WHEN part = 1 THEN grp ELSE 0 END AS n, part <> 1 AS note, text, part = 1 AND regexp_matches(raw, '(?i)^(warning|caution|danger|safety)\b') AS warns, part = 2 AND doc_id % 2 = 0 AS with_sources FROM c WHERE part = 1 OR (part = 0 AND raw <> '') OR (part = 2 AND (text <> '' OR doc_id % 2 = 0))
  UNION ALL SELECT doc_id, 2, 0, 0, true, '', false, true FROM g WHERE good AND doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM t WHERE part = 2)
  UNION ALL SELECT doc_id, 1, 1, 1, false, string_agg(x, chr(10) ORDER BY i), false, any_value(doc_id % 2 = 0) FROM m JOIN g USING (doc_id) WHERE NOT good GROUP BY doc_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, grp) - 1)::INT AS pos, n::INT AS n, note, md5(text) AS text_md5, warns, with_sources FROM s"""


def reading_order(spark, sf_dir):
    """Regions of pages of forty lines of orders or so, in columns and bands, with what each holds."""
    line = table(spark, sf_dir, "lineitem")
    x = F.col("l_suppkey") % 3 * 150.0 + F.col("l_partkey") % 5 * 4.0
    y = 700.0 - F.col("l_partkey") % 41 * 15.0 - F.when(F.col("l_partkey") % 41 > 20, 45.0).otherwise(0.0)
    items = line.select(F.floor(F.col("l_orderkey") / 10).alias("page"), x.alias("x"), y.alias("y"), (F.col("l_quantity") * 2 + F.when(F.col("l_discount") > 0.09, 150.0).otherwise(20.0)).alias("width"), (8.0 + F.col("l_linenumber")).alias("size"))
    return regions(items).groupBy("page", "region").agg(F.count("*").alias("items"), F.min("x").alias("left"), F.max("y").alias("top"), F.round(F.sum("width"), 4).alias("widths"))


READING_SQL = """WITH RECURSIVE t AS (
  SELECT l_orderkey // 10 AS page, l_suppkey % 3 * 150.0::DOUBLE + l_partkey % 5 * 4.0::DOUBLE AS x, 700.0::DOUBLE - l_partkey % 41 * 15.0::DOUBLE - CASE WHEN l_partkey % 41 > 20 THEN 45.0 ELSE 0.0 END::DOUBLE AS y,
    l_quantity * 2 + CASE WHEN l_discount > 0.09 THEN 150.0 ELSE 20.0 END::DOUBLE AS width, 8.0::DOUBLE + l_linenumber AS size FROM lineitem
), r AS (
  SELECT page, '' AS region, x, y, width, size, max(x + width) OVER (PARTITION BY page) - min(x) OVER (PARTITION BY page) AS wide, true AS open FROM t
  UNION ALL (
  WITH o AS (SELECT * FROM r WHERE open),
  s AS (SELECT page, region, count(*) AS n, list_sort(list(size))[(count(*) // 2 + 1)::INT] AS mid FROM o GROUP BY ALL HAVING count(*) >= 6),
  gx AS (SELECT DISTINCT page, region, wide, (reach + x) / 2 AS mark, x - reach AS gap FROM (SELECT *, max(x + width) OVER (PARTITION BY page, region ORDER BY x, width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o) WHERE x - reach >= greatest(12.0, wide * 0.04)),
  cx AS (SELECT gx.page, gx.region, mark, gap FROM gx JOIN s USING (page, region) JOIN o ON o.page = gx.page AND o.region = gx.region GROUP BY gx.page, gx.region, mark, gap, n HAVING count(*) FILTER (o.x + o.width / 2 < mark) >= 3 AND n - count(*) FILTER (o.x + o.width / 2 < mark) >= 3),
  bx AS (SELECT page, region, arg_max(mark, (gap, -mark)) AS ax FROM cx GROUP BY ALL),
  gy AS (SELECT page, region, (reach + low) / 2 AS mark, low - reach AS gap FROM (SELECT *, y - size * 0.25 AS low, max(y - size * 0.25 + size * 1.25) OVER (PARTITION BY page, region ORDER BY y - size * 0.25, size * 1.25 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)),
  yy AS (SELECT page, region, arg_max(mark, (gap, -mark)) AS ay FROM gy JOIN s USING (page, region) WHERE gap >= greatest(4.0, mid * 1.5) GROUP BY ALL),
  c AS (SELECT s.page, s.region, ax, ay FROM s LEFT JOIN bx ON bx.page = s.page AND bx.region = s.region LEFT JOIN yy ON yy.page = s.page AND yy.region = s.region)
  SELECT o.page, o.region || CASE WHEN ax IS NOT NULL THEN (x + width / 2 >= ax)::INT::VARCHAR WHEN ay IS NOT NULL THEN (y < ay)::INT::VARCHAR ELSE '' END, x, y, width, size, wide, ax IS NOT NULL OR ay IS NOT NULL
  FROM o LEFT JOIN c ON c.page = o.page AND c.region = o.region)
)
SELECT page, region, count(*)::BIGINT AS items, min(x) AS left, max(y) AS top, round(sum(width), 4) AS widths FROM r WHERE NOT open GROUP BY ALL"""

PAIRS = {
    "crawl_marks": (crawl_marks, MARKS_SQL),
    "crawl_vehicles": (crawl_vehicles, VEHICLES_SQL),
    "picture_sources": (picture_sources, PICTURES_SQL),
    "stored_pictures": (stored_pictures, STORED_SQL),
    "tracker_rows": (tracker_rows, TRACKER_SQL),
    "catalog_levels": (catalog_levels, CATALOG_SQL),
    "folder_listing": (folder_listing, LISTING_SQL),
    "folder_skips": (folder_skips, SKIPS_SQL),
    "answer_procedures": (answer_procedures, PROCEDURE_SQL),
    "reading_order": (reading_order, READING_SQL),
}
