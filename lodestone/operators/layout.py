"""Positioned text on pages to regions, lines and blocks, all by windows over a page or a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import save

#: How lines begin. Fixed values.
CALLOUT = r"^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|ATTENTION|NOTE)\b\s*[!:.\-–—]*\s*|^(Warning|Caution|Danger|Notice|Important|Attention|Note)\s*[!:]\s*"
CAPTION = r"(?i)^(FIGURE|FIG\.?|TABLE|DIAGRAM|PHOTO|IMAGE)\s*[A-Z]?\d+"
NUMBERED = r"^(\d{1,3})[.)]\s+(?=\S)"
STEP = r"(?i)^Step\s+(\d{1,3})\s*[:.)\-–]\s*"
BULLET = r"^[•●▪■◦‣▸►]\s*(?=\S)|^[-–—]\s+(?=[A-Za-z]{2,})"
DOTTED = r"^(\d+(?:\.\d+)+)[.)]?\s+[A-Z][A-Za-z]"
MEASURE = r"(?i)^\d+(?:\.\d+)+\s*(?:watts?|amps?|volts?|vdc|vac|v|a|mm|cm|in|inch|lbs?|kg|hz|ohms?|awg|ft|nm|psi|mph|fpm)\b"
PAGE_NUMBER = r"(?i)^(page\s*)?\d+(\s*(of|/)\s*\d+)?$"
ICON = r"^[^A-Za-z0-9•●▪■◦‣▸►\-–—]+"
#: A line so much larger than the body is a heading; bold ones are, if bold is rarer than that. Fixed values.
HEADING_RATIO, BOLD_SHARE = 1.3, 0.35
#: Parts of a page's height that hold running heads and feet, and of its pages that must repeat one. Fixed values.
BAND, REPEATS = 0.07, 0.3


def displayed(items: DataFrame) -> DataFrame:
    """Texts as a page shows them: ``items`` with str, x, y, width and size for those that read from left to right on screen.

    ``items`` has str, a to f (the text's matrix), va to vf (the page's, which turns a rotated one), page_height, and the
    measured w and h. Both matrices are multiplied, so a landscape page keeps its text; what is turned as displayed and what
    is blank goes. A symbol font's bullet, which comes as NUL, is one. y grows upward.
    """
    m0, m1 = F.col("va") * F.col("a") + F.col("vc") * F.col("b"), F.col("vb") * F.col("a") + F.col("vd") * F.col("b")
    m3 = F.col("vb") * F.col("c") + F.col("vd") * F.col("d")
    m4, m5 = F.col("va") * F.col("e") + F.col("vc") * F.col("f") + F.col("ve"), F.col("vb") * F.col("e") + F.col("vd") * F.col("f") + F.col("vf")
    size = F.coalesce(F.nullif("h", F.lit(0.0)), F.nullif(F.abs(m3), F.lit(0.0)), F.lit(1.0))
    kept = items.where((F.abs(m1) < 0.01) & (m0 > 0) & (F.trim("str") != ""))
    return kept.withColumns({"str": F.translate("str", "\x00", "•"), "x": m4, "y": F.col("page_height") - m5, "width": F.coalesce("w", F.lit(0.0)), "size": size})


def gaps(items: DataFrame, keys: list[str], start: str, size: str) -> DataFrame:
    """Empty stretches between the items of each key along one axis: keys, gap_from, gap_to, before (items that end before it)."""
    w = Window.partitionBy(*keys).orderBy(start, size)
    reach = F.max(F.col(start) + F.col(size)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = items.withColumns({"gap_from": reach, "before": F.row_number().over(w) - 1})
    return out.where(F.col("gap_from") < F.col(start)).select(*keys, "gap_from", F.col(start).alias("gap_to"), "before")


#: A gutter in points and as a share of the page's width, a band in points and in median sizes, and items of a region that is cut. Fixed values.
GUTTER, GUTTER_SHARE, BAND_POINTS, BAND_SIZES, FEWEST, FEWEST_BESIDE = 12.0, 0.04, 4.0, 1.5, 6, 3


def _cuts(items: DataFrame, key: list[str]) -> DataFrame:
    """``items`` with at_x and at_y, where each one's region is cut, if it is.

    All is told by windows over a region, so its items are dealt once.
    """
    whole = Window.partitionBy(*key)
    named = F.lit(True)
    for k in key:
        named = named & F.col(k).isNotNull()
    # The size in the middle.
    by_size = whole.orderBy(F.asc_nulls_last("size"))
    out = items.withColumns({"_n": F.when(named, F.count("*").over(whole)), "_place": F.row_number().over(by_size)})
    out = out.withColumn("_mid", F.max(F.when(F.col("_place") == F.floor(F.col("_n") / 2) + 1, F.col("size"))).over(whole)).drop("_place")

    def gap(start: Column, size: Column) -> tuple[Column, Column]:
        reach = F.max(start + size).over(whole.orderBy(start, size).rowsBetween(Window.unboundedPreceding, -1))
        return (reach + start) / 2, F.when(reach < start, start - reach)

    def widest(fits: Column) -> Column:
        """The cut of the widest gap, the first of equal ones."""
        return -F.max(F.when(fits & (F.col("_n") >= FEWEST), F.struct("_gap", (-F.col("_at")).alias("at")))).over(whole)["at"]

    at, wide = gap(F.col("x"), F.col("width"))
    centre = F.col("x") + F.col("width") / 2
    out = out.withColumns({"_at": at, "_gap": wide, "_centres": F.collect_list(centre).over(whole)})
    gutter = F.col("_gap") >= F.greatest(F.lit(GUTTER), F.col("_wide") * GUTTER_SHARE)
    # A page is so wide that it has few gutters, each of which meets the page's items.
    out = out.withColumn("_before", F.when(gutter, F.size(F.filter("_centres", lambda c: c < F.col("_at"))))).drop("_centres")
    out = out.withColumn("at_x", widest(gutter & (F.col("_before") >= FEWEST_BESIDE) & (F.col("_n") - F.col("_before") >= FEWEST_BESIDE)))
    at, wide = gap(F.col("y") - F.col("size") * 0.25, F.col("size") * 1.25)
    out = out.withColumns({"_at": at, "_gap": wide})
    out = out.withColumn("at_y", widest(F.col("_gap") >= F.greatest(F.lit(BAND_POINTS), F.col("_mid") * BAND_SIZES)))
    return out.drop("_n", "_mid", "_at", "_gap", "_before")


def regions(items: DataFrame, keys: list[str] | None = None, page_width: Column | None = None) -> DataFrame:
    """``items`` (x, y, width, size, and ``keys``, by default the page; y grows upward) with ``region``, whose order is the reading order.

    A region of six items or more is cut at its widest gutter, of 12 points and 4 percent of the page's width, with
    three items' centres at either side; without one at its widest band, of 4 points and 1.5 median
    sizes, between lines. The left or upper part comes first, and each part is cut again until none
    can be. Every round cuts all regions of all pages that are still open and is written; there are as many
    rounds as the deepest page has cuts inside each other. ``page_width`` is by default that of the page's items.
    """
    keys = keys or ["page"]
    whole = Window.partitionBy(*keys)
    wide = page_width if page_width is not None else F.max(F.col("x") + F.col("width")).over(whole) - F.min("x").over(whole)
    key = [*keys, "region"]
    open_items, closed = items.withColumns({"region": F.lit(""), "_wide": wide}), []
    while True:
        met = _cuts(open_items, key)
        later = F.when(F.col("at_x").isNotNull(), F.col("x") + F.col("width") / 2 >= F.col("at_x")).when(F.col("at_y").isNotNull(), F.col("y") < F.col("at_y"))
        met = save(met.withColumn("_later", later).drop("at_x", "at_y"), "regions")
        closed.append(met.where("_later IS NULL").drop("_later", "_wide"))
        open_items = met.where("_later IS NOT NULL")
        if open_items.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        open_items = open_items.withColumn("region", F.concat("region", F.col("_later").cast("int").cast("string"))).drop("_later")


def lines(items: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each key: keys, line, text, x, y, size, chars, bold.

    ``items``: text, x, y, width, size, bold. An item goes on the line of the one before it (from the top, then
    the left) while their heights differ by no more than 1 or 0.35 of its size. A gap of over twice the size
    is a cell border, one of over 0.12 a space. The size is that of most characters.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "text")
    items = items.withColumn("_new", F.when(F.lag("y").over(down) - F.col("y") <= F.greatest(F.lit(1.0), F.col("size") * 0.35), 0).otherwise(1))
    items = items.withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # The items of a line are few, so what a line says of them is told from one array, and a page's items are put in order once.
    held = F.sort_array(F.collect_list(F.struct("x", "y", "text", "width", "size")))
    out = items.groupBy(*keys, "line").agg(held.alias("_held"), F.min("x").alias("x"), F.max("y").alias("y"), F.sum(F.length("text")).alias("chars"), F.min("bold").alias("bold"))

    def said(item: Column, i: Column) -> Column:
        before = F.get("_held", i - 1)
        gap, size = item["x"] - (before["x"] + before["width"]), F.greatest(item["size"], before["size"])
        return F.concat(F.when(gap > size * 2, " | ").when(gap > size * 0.12, " ").otherwise(""), item["text"])

    sizes = F.array_distinct(F.transform("_held", lambda i: F.round(i["size"], 1)))
    chars = lambda s: F.aggregate(F.filter("_held", lambda i: F.round(i["size"], 1).eqNullSafe(s)), F.lit(None).cast("long"), lambda n, i: F.coalesce(n + F.length(i["text"]), n, F.length(i["text"])))
    most = F.array_max(F.transform(sizes, lambda s: F.struct(chars(s).alias("w"), s.alias("size"))))["size"]
    text = F.array_join(F.transform("_held", said), "")
    return out.select(*keys, "line", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), "x", "y", "chars", "bold", most.alias("size"))


def without_running_heads(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``found`` (doc_id, page, text, y) without page numbers, heads and feet in the bands at the top and bottom.

    ``pages``: doc_id, page, height. A text repeats if, digits aside, as many pages have it in a band as 2 and
    0.3 of the document's pages, rounded up; documents of under three pages keep all but page numbers.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    rows = found.join(pages, ["doc_id", "page"]).join(n, "doc_id")
    key = F.trim(F.regexp_replace(F.lower("text"), r"\d+", "#"))
    banded = (F.col("y") > F.col("height") * (1 - BAND)) | (F.col("y") < F.col("height") * BAND)
    rows = rows.withColumns({"_band": banded, "_key": key})
    often = rows.where("_band").groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("_pages"))
    rows = rows.join(often, ["doc_id", "_key"], "left")
    repeats = (F.col("n_pages") >= 3) & (F.col("_pages") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * REPEATS)))
    return rows.where(~F.col("_band") | (~F.trim("text").rlike(PAGE_NUMBER) & ~F.coalesce(repeats, F.lit(False)))).select(*found.columns)


def classify(found: DataFrame, body_size: Column, bold_share: Column) -> DataFrame:
    """Lines with ``type`` (callout, caption, heading, item, text), ``basis``, ``number`` and ``rest``; the first rule that fits decides."""
    text = F.regexp_replace("text", ICON, "")
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    ends = F.regexp_replace(text, ":$", "").rlike("[.!?]$")
    short = (F.length(text) <= 90) & ~ends
    cell = F.contains(text, F.lit(" | "))
    number = F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, NUMBERED, 1), F.lit("")), F.regexp_extract(text, STEP, 1)), F.lit(""))
    rules = [
        ("callout", None, text.rlike(CALLOUT)),
        ("caption", None, text.rlike(CAPTION)),
        ("heading", "size", (F.col("size") >= body_size * HEADING_RATIO) & short & (F.length(letters) >= 3)),
        ("heading", "numbered", text.rlike(DOTTED) & ~text.rlike(MEASURE) & (F.length(text) <= 100) & ~ends),
        ("item", "num", number.isNotNull() & ~cell),
        ("item", "bullet", text.rlike(BULLET) & ~cell),
        ("heading", "caps", (F.length(letters) >= 4) & (F.length(text) <= 60) & (letters == F.upper(letters)) & ~ends),
        ("heading", "bold", F.col("bold") & (bold_share < BOLD_SHARE) & short & (F.length(letters) >= 3)),
    ]
    kind, basis = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, why, test in rules:
        kind, basis = kind.when(test, name), basis.when(test, F.lit(why))
    out = found.withColumns({"type": kind.otherwise("text"), "basis": basis.otherwise(F.lit(None).cast("string"))})
    start = F.when(F.col("type") == "callout", F.regexp_replace(text, CALLOUT, "")).when(F.col("basis") == "num", F.regexp_replace(F.regexp_replace(text, NUMBERED, ""), STEP, "")).when(F.col("basis") == "bullet", F.regexp_replace(text, BULLET, "")).otherwise(F.col("text"))
    said = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, CALLOUT, 1), F.lit("")), F.regexp_extract(text, CALLOUT, 2)))
    return out.withColumns({"rest": start, "number": F.when(F.col("basis") == "num", number.cast("int")), "callout_kind": F.when(F.col("type") == "callout", said)})


def demote(found: DataFrame, pitch: float) -> DataFrame:
    """Classified lines (doc_id, pos, page, region, y, size, text, type, basis) of which some headings are text after all.

    One in capitals or bold needs prose below it within 2.5 pitches; three or more of one size in a row are text.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = (F.lead("page").over(w) == F.col("page")) & (F.lead("region").over(w) == F.col("region")) & (F.col("y") - F.lead("y").over(w) <= pitch * 2.5)
    text = F.lead("text").over(w)
    prose = near & F.lead("type").over(w).isin("text", "item", "callout") & (F.length(text) >= 20) & text.rlike("[a-z]")
    weak = (F.col("type") == "heading") & F.col("basis").isin("caps", "bold") & ~F.coalesce(prose, F.lit(False))
    out = found.withColumn("type", F.when(weak, "text").otherwise(F.col("type")))
    same = (F.lag("type").over(w) == "heading") & (F.lag("page").over(w) == F.col("page")) & (F.lag("region").over(w) == F.col("region")) & (F.abs(F.lag("size").over(w) - F.col("size")) < 0.05) & (F.col("type") == "heading")
    # A row is one of three or more if two rows side by side, among it and its neighbours, go on with those before them.
    out = out.withColumn("_same", F.coalesce(same, F.lit(False)))
    at = lambda n: F.coalesce(F.lead("_same", n).over(w), F.lit(False))
    long = (F.col("_same") & F.coalesce(F.lag("_same").over(w), F.lit(False))) | (F.col("_same") & at(1)) | (at(1) & at(2))
    return out.withColumn("type", F.when((F.col("type") == "heading") & long, "text").otherwise(F.col("type"))).drop("_same")


def blocks(found: DataFrame, pitch: float) -> DataFrame:
    """Blocks of demoted lines: doc_id, pos, type, text, level, items, ordered, callout_kind, page, page_end.

    A plain line goes on with what is open while nothing broke the layout (another page or region, or a gap of over
    1.55 pitches). A numbered list goes on wherever the next number follows, a bullet list only side by side.
    Paragraphs of two lines or more of which half have cells are tables. A paragraph that a layout break
    cut, without an end and with a small letter behind it, is put together. Headings are levelled by dots, or else by
    the rank of their size, 4 at most.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broke = ~F.coalesce((F.lag("page").over(w) == F.col("page")) & (F.lag("region").over(w) == F.col("region")) & (F.lag("y").over(w) - F.col("y") <= pitch * 1.55), F.lit(False))
    out = found.withColumn("broke", broke)
    # A callout holds whatever comes before the next break, but for captions and callouts.
    opens = F.col("broke") | F.col("type").isin("callout", "caption")
    inside = (F.last(F.when(opens, F.col("type")), ignorenulls=True).over(upto) == "callout") & ~F.col("type").isin("callout", "caption")
    out = out.withColumn("role", F.when(inside, "text").otherwise(F.col("type")))
    # The number of the last item, captions aside, tells whether a list goes on.
    other = F.when(F.col("role") != "caption", F.struct("role", "number", "basis", "pos"))
    last_other = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_item = F.last(F.when(F.col("role") == "item", F.struct("number", "basis", "pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_stop = F.last(F.when(F.col("role").isin("heading", "callout") | ((F.col("role") == "text") & F.col("broke")), F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumns({"_other": last_other, "_item": last_item, "_stop": F.coalesce(last_stop, F.lit(-1))})
    listed = F.col("_item.pos") > F.col("_stop")
    goes_on = (F.col("role") == "item") & listed & (F.col("_item.basis") == F.col("basis")) & F.when(F.col("basis") == "num", F.col("number") == F.col("_item.number") + 1).otherwise(~F.col("broke"))
    plain = (F.col("role") == "text") & ~F.col("broke") & ~F.coalesce(F.col("_other.role").isin("heading"), F.lit(True)) & (F.lag("role").over(w) != "caption")
    same_head = (F.col("role") == "heading") & (F.lag("role").over(w) == "heading") & ~F.col("broke") & (F.abs(F.lag("size").over(w) - F.col("size")) < 0.05)
    starts = ~F.coalesce(goes_on, F.lit(False)) & ~F.coalesce(plain, F.lit(False)) & ~F.coalesce(same_head, F.lit(False))
    out = out.withColumn("_starts", starts)
    # A resumed list may have captions between, so its rows take the block where it began.
    out = out.withColumn("_block", F.last(F.when(F.col("_starts") & (F.col("role") != "caption"), F.col("pos")), ignorenulls=True).over(upto))
    out = out.withColumn("block", F.when(F.col("role") == "caption", F.col("pos")).otherwise(F.coalesce("_block", "pos")))
    of_block = Window.partitionBy("doc_id", "block").orderBy("pos")
    out = out.withColumn("item", F.sum(F.when(F.col("role") == "item", 1).otherwise(0)).over(of_block))
    glued = F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rest"))), lambda x: x["rest"]), F.lit(""), _glue)
    of_items = out.groupBy("doc_id", "block", "item").agg(F.min_by("role", "pos").alias("role"), F.min_by("basis", "pos").alias("basis"), F.min_by("number", "pos").alias("number"), glued.alias("text"), F.count("*").alias("n"), F.count(F.when(F.contains("text", F.lit(" | ")), 1)).alias("cells"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("raw"), F.min_by("callout_kind", "pos").alias("callout_kind"), F.max("size").alias("size"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.min_by("region", "pos").alias("region"))
    marker = F.when(F.col("basis") == "num", F.concat(F.col("number").cast("string"), F.lit("."))).otherwise("•")
    items = F.sort_array(F.collect_list(F.when(F.col("role") == "item", F.struct("item", F.struct(marker.alias("marker"), "text").alias("i")))))
    first = F.struct("item")
    made = of_items.groupBy("doc_id", F.col("block").alias("pos")).agg(F.min_by("role", first).alias("role"), F.min_by("text", first).alias("text"), F.min_by("raw", first).alias("raw"), F.min_by(F.struct("n", "cells"), first).alias("c"), F.transform(items, lambda x: x["i"]).alias("items"), (F.min_by("basis", first) == "num").alias("ordered"), F.min_by("callout_kind", first).alias("callout_kind"), F.max("size").alias("size"), F.min("page").alias("page"), F.max("page_end").alias("page_end"), F.min_by("region", first).alias("region"))
    table = (F.col("role") == "text") & (F.col("c.n") >= 2) & (F.col("c.cells") * 2 >= F.col("c.n"))
    kind = F.when(table, "table").when(F.col("role") == "text", "paragraph").when(F.col("role") == "item", "list").otherwise(F.col("role"))
    text = F.when(table, F.col("raw")).when(F.col("role") == "heading", F.trim(F.regexp_replace("text", r"[:\s]+$", ""))).when(F.col("role") != "item", F.trim("text"))
    made = made.withColumns({"type": kind, "text": text})
    cut = (F.lag("type").over(w) == "paragraph") & (F.col("type") == "paragraph") & ((F.col("page") != F.lag("page_end").over(w)) | (F.col("region") != F.lag("region").over(w))) & ~F.lag("text").over(w).rlike(r'[.!?:;)”"]$') & F.col("text").rlike("^[a-z0-9(]")
    made = made.withColumn("_cut", F.coalesce(cut, F.lit(False))).withColumn("_whole", F.last(F.when(~F.col("_cut"), F.col("pos")), ignorenulls=True).over(upto))
    whole = made.groupBy("doc_id", "_whole").agg(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), F.lit(""), _glue).alias("text"), *[F.min_by(c, "pos").alias(c) for c in ("type", "items", "ordered", "callout_kind", "size")], F.min("page").alias("page"), F.max("page_end").alias("page_end"))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "type").orderBy(F.desc(F.round("size", 1))))
    dots = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)[.)]?\s", 1)
    level = F.when(F.col("type") == "heading", F.least(F.lit(4), F.when(dots != "", F.size(F.split(dots, r"\."))).otherwise(rank)))
    return whole.select("doc_id", F.col("_whole").alias("pos"), "type", F.when(F.col("type") != "list", F.col("text")).alias("text"), level.alias("level"), F.when(F.col("type") == "list", F.col("items")).alias("items"), (F.col("type") == "list") & F.col("ordered"), "callout_kind", "page", "page_end").withColumnRenamed("((type = list) AND ordered)", "ordered")


def _glue(held: Column, part: Column) -> Column:
    """Two lines as one; a hyphen at the end joins without a space."""
    return F.when(held == "", F.coalesce(part, F.lit(""))).when(held.endswith("-"), F.concat(held, F.coalesce(part, F.lit("")))).otherwise(F.concat(held, F.lit(" "), F.coalesce(part, F.lit(""))))
