"""Wire tables in vehicle pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = r'(?is)<tr[^>]*class="[^"]*\b(?:row[0-9]+|title|wirenote)\b[^"]*"[^>]*>.*?</tr>'


def plain(html: Column) -> Column:
    """Text of a cell: tags out, common entities read, white space squeezed."""
    t = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def page_heads(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``title`` (tags out, white space squeezed; empty without one) and ``links``, the targets in order."""
    title = F.regexp_replace(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]*>", " ")
    links = F.regexp_extract_all(html_col, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.withColumns({"title": F.trim(F.regexp_replace(title, r"\s+", " ")), "links": links})


def parse_wires(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each wire: page, ordinal, section, function, color, polarity, location, notes, image_url.

    A section is the last title row before; a note row belongs to the wire before it.
    """
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(ROW), F.lit(0))).alias("pos", "tr"))
    kind = F.regexp_extract("tr", r'(?i)class="[^"]*\b(row|title|wirenote)', 1)
    rows = rows.withColumn("kind", F.lower(kind))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r'(?is)<td[^>]*class="[^"]*\bwires\b[^"]*"[^>]*>(.*?)</td>'), F.lit(1)), plain)
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("section", F.last(F.when(F.col("kind") == "title", plain(F.col("tr"))), ignorenulls=True).over(w))
    rows = rows.withColumns({"cells": cells, "next_kind": F.lead("kind").over(w), "next_text": F.lead(plain(F.col("tr"))).over(w)})
    wires = rows.where((F.col("kind") == "row") & (F.size("cells") >= 4))
    cell = lambda i: F.get("cells", F.lit(i))
    return wires.select(
        id_col,
        F.row_number().over(w).alias("ordinal"),
        F.coalesce("section", F.lit("")).alias("section"),
        cell(0).alias("function"),
        cell(1).alias("color"),
        cell(2).alias("polarity"),
        cell(3).alias("location"),
        F.when(F.col("next_kind") == "wirenote", F.col("next_text")).alias("notes"),
        F.nullif(F.regexp_extract("tr", r'(?i)(?:data-image|href)="([^"]+\.(?:jpe?g|png|gif))"', 1), F.lit("")).alias("image_url"),
    )


def circuit(function: Column) -> Column:
    """12v, ignition or other, by the wire's function."""
    f = F.lower(function)
    return F.when(f.rlike(r"(?:constant )?\+? ?12 ?v"), "12v").when(f.rlike(r"^ignition(?! interrupt)"), "ignition").otherwise("other")
