"""Documents' blocks to parent and child chunks.

Everything but greedy filling is windows, explodes and joins of rows. Filling depends on what was
filled before, so a small function numbers the groups from arrays of sizes: of a list's items, a
table's rows, a document's blocks (numbers alone) or the units of one parent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from lodestone.functions.text import token_estimate
from lodestone.shared import save

#: Stands before every description of a picture. Fixed value.
FIGURE_MARK = "[FIGURE — machine-generated description, unverified]"
#: Between a title and a section path, and between headings. Fixed values.
TITLE_MARK, PATH_MARK = " › ", " > "


@dataclass(frozen=True)
class Sizes:
    """Tokens. Defaults are fixed values; ``of`` reads settings and says which it couldn't use."""

    child_target: int = 250
    child_max: int = 380
    overlap: int = 30
    procedure_max: int = 800
    parent_min: int = 150
    parent_max: int = 1200
    tail_min: int = 40

    @classmethod
    def of(cls, settings: dict[str, object]) -> tuple[Sizes, list[str]]:
        good, bad = {}, []
        for name in cls.__dataclass_fields__:
            if name in settings:
                try:
                    value = int(str(settings[name]))
                except ValueError:
                    value = -1
                if value >= 0:
                    good[name] = value
                else:
                    bad.append(name)
        return cls(**good), bad


def estimate(text: str) -> int:
    return math.ceil(len(text) / 4)


def fill(sizes: list[int], room: int, head: int = 0) -> list[int]:
    """Group numbers: a group takes what comes next while it has ``room``, and one item at least."""
    out, group, held = [], 0, head
    for k, size in enumerate(sizes):
        if k and held + size > room:
            group, held = group + 1, head
        out.append(group)
        held += size
    return out


def parents(sizes: list[int], opens: list[bool], least: int, most: int) -> list[int]:
    """Group numbers of a document's blocks: a group ends before it would pass ``most``, and where a section opens once it has ``least``."""
    out, group, held, empty = [], 0, 0, True
    for size, new in zip(sizes, opens, strict=True):
        if not empty and ((new and held >= least) or held + size > most):
            group, held = group + 1, 0
        out.append(group)
        held += size
        empty = False
    return out


def pieces(kinds: list[str], sizes: list[int], s: Sizes) -> list[int]:
    """Piece numbers of a parent's units: short paragraphs (``fill``) run together up to the target, all others (``part`` of a long
    paragraph, or what is no prose) stand alone; a prose piece under ``tail_min`` joins the prose before it if both fit ``child_max``."""
    runs: list[list] = []  # prose, tokens, units
    for i, (kind, size) in enumerate(zip(kinds, sizes, strict=True)):
        if kind == "fill" and runs and runs[-1][3] and runs[-1][1] + size <= s.child_target:
            runs[-1][1] += size
            runs[-1][2].append(i)
        else:
            runs.append([kind in ("fill", "part"), size, [i], kind == "fill"])
    out, number, last = [0] * len(kinds), -1, None
    for prose, size, units, _ in runs:
        if last and last[0] and prose and size < s.tail_min and last[1] + size <= s.child_max:
            last[1] += size
        else:
            number += 1
            last = [prose, size]
        for i in units:
            out[i] = number
    return out


def split_prose(text: str, most: int = Sizes.child_max, overlap: int = Sizes.overlap) -> list[str]:
    """Cut at the coarsest mark that gives parts of ``most`` tokens or fewer; a part begins with up to ``overlap`` tokens of the one before."""
    if estimate(text) <= most:
        return [text]
    room = (most - overlap) * 4
    for mark in ("\n\n", "\n", ". ", "; ", ", ", " ", ""):
        units = [u for u in re.split(f"(?<={re.escape(mark)})", text) if u] if mark else list(text)
        if len(units) > 1:
            break
    parts, now = [], ""
    for unit in units:
        for sub in split_prose(unit, most - overlap, 0) if len(unit) > room and mark else [unit]:
            if now and len(now) + len(sub) > room:
                parts.append(now)
                now = ""
            now += sub
    parts += [now] if now.strip() else []
    out = parts[:1]
    for before, part in zip(parts, parts[1:], strict=False):
        tail = before[-overlap * 4 :] if overlap else ""
        tail = tail[tail.find(" ") + 1 :] if " " in tail else ""
        out.append(tail + part)
    return [p.strip() for p in out]


def _numbers(make: Callable[..., list]) -> Callable[..., Column]:
    """``make`` over lists, as a column of int arrays."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([make(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>", ArrowUDFType.SCALAR)


def _levels(blocks: DataFrame) -> list[int]:
    """The levels of headings that occur, a few numbers, which come to the driver."""
    return sorted(r["level"] for r in blocks.where((F.col("type") == "heading") & F.col("level").isNotNull()).select("level").distinct().collect())


def section_paths(blocks: DataFrame, levels: list[int] | None = None, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``blocks`` (doc_id, pos, type, text, level, title) with ``section_path``, the headings that hold at each block, or else the title, and ``opens``.

    A heading ends those of its level and below. For each level that occurs, the last heading counts if none above came
    after it. ``levels`` are by default those that occur; ``order`` is any order of columns in which ``pos`` ascends.
    """
    heading = F.col("type") == "heading"
    levels = _levels(blocks) if levels is None else levels
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    heads = {f"_h{i}": F.last(F.when(heading & (F.col("level") == k), F.struct("pos", "text")), ignorenulls=True).over(w) for i, k in enumerate(levels)}
    out = blocks.withColumns(heads)
    path, above = [F.lit(None).cast("string")], F.lit(-1).cast("long")
    for c in heads:
        path.append(F.when(F.col(f"{c}.pos") > above, F.col(f"{c}.text")))
        above = F.greatest(above, F.coalesce(F.col(f"{c}.pos").cast("long"), F.lit(-1)))
    joined = F.nullif(F.concat_ws(PATH_MARK, *path), F.lit(""))
    return out.withColumns({"section_path": F.coalesce(joined, "title"), "opens": heading}).drop(*heads)


def rendered() -> Column:
    """A block as its parent shows it."""
    items = F.array_join(F.transform("items", lambda i: F.concat_ws(" ", i["marker"], i["text"])), "\n")
    text = F.coalesce("text", F.lit(""))
    named = F.concat(F.upper(F.coalesce("callout_kind", F.lit("note"))), F.lit(": "), text)
    return F.when(F.col("type") == "list", items).when(F.col("type") == "callout", named).when(F.col("type") == "figure", F.concat(F.lit(FIGURE_MARK + "\n"), text)).otherwise(text)


def _split_tables(blocks: DataFrame, s: Sizes) -> DataFrame:
    """Tables of over ``procedure_max`` tokens as several, cut between rows, each with the header; ``sub`` numbers them."""
    large = F.coalesce((F.col("type") == "table") & (token_estimate(F.col("text")) > s.procedure_max), F.lit(False))
    rows = F.when(large, F.split("text", "\n"))
    group = _numbers(lambda own: fill(own[1:], s.procedure_max, own[0]) if own else [])
    cut = blocks.withColumn("_rows", rows).withColumn("_g", group(F.transform("_rows", lambda r: F.ceil(F.length(r) / 4).cast("int"))))
    # A table of one row has no part; the numbers of what isn't cut are one 0.
    cut = cut.withColumn("sub", F.explode(F.when(F.col("_rows").isNull(), F.array(F.lit(0))).otherwise(F.array_distinct("_g"))))
    own = F.transform(F.filter(F.arrays_zip("_g", F.slice("_rows", F.lit(2), F.size("_rows") - 1).alias("_own")), lambda x: x["_g"] == F.col("sub")), lambda x: x["_own"])
    text = F.when(F.col("_rows").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.array(F.element_at("_rows", 1)), own), "\n"))
    return cut.withColumn("text", text).drop("_g", "_rows")


def chunk_blocks(blocks: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Chunks of all documents: doc_id, chunk_index, parent_index, is_parent, section_path, text, page_from, page_to, kind, has_warning, step_count, part.

    ``blocks``: doc_id, title, pos, type (heading, paragraph, caption, list, table, callout, figure, or any other, which is
    prose), text, level, items (marker, text), ordered, callout_kind, page, page_end. A parent is followed by its children
    under one running index. Figures without a text are left out; pages are null where no block has one.

    All steps keep a document's rows together, so texts are dealt by document once for the parents and once for the children.
    """
    s = sizes or Sizes()
    usable = blocks.where((F.col("type") != "figure") | (F.coalesce("text", F.lit("")) != ""))
    opens = F.col("type") == "heading"

    def parts(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_prose(t, s.child_max, s.overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    # What Python does with single blocks comes before they are dealt, since its results don't keep what is known of the rows' places.
    split = F.arrow_udf(parts, "array<string>", ArrowUDFType.SCALAR)
    long = (token_estimate(F.coalesce("text", F.lit(""))) > s.child_max) & ~F.col("type").isin("list", "table", "callout")
    item_sizes = F.transform("items", lambda i: F.ceil(F.length(F.concat_ws(" ", i["marker"], i["text"])) / 4).cast("int"))
    number = _numbers(lambda own: fill(own or [], s.procedure_max))(F.when(F.col("type") == "list", item_sizes))
    # Only the few long texts pass the splitter. Read many times below, so written once.
    saved = _split_tables(usable, s).withColumns({"tokens": token_estimate(rendered()).cast("int"), "_filled": number, "_parts": split(F.when(long, F.col("text")))})
    saved = save(saved, "blocks")

    # A document's sizes in order, as numbers, to the number of each block's parent.
    order = F.sort_array(F.collect_list(F.struct("pos", "sub", "tokens", opens.alias("opens"))))
    flat = saved.select("doc_id", "pos", "sub", "tokens", "type").groupBy("doc_id").agg(order.alias("b"))
    groups = flat.select("doc_id", _numbers(lambda own, opens: parents(own, opens, s.parent_min, s.parent_max))(F.col("b.tokens"), F.col("b.opens")).alias("_parents"))
    # Parts of a table are blocks of their own: the document's blocks are numbered anew.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sub", "tokens", opens))
    rows = saved.withColumn("pos", place).drop("sub").join(groups, "doc_id").withColumn("parent", F.element_at("_parents", F.col("pos"))).drop("_parents")
    # Parents ascend with the blocks, so one order serves the document's windows and the parents'.
    rows = section_paths(rows, _levels(saved), ("parent", "pos")).withColumn("shown", rendered())
    page_end = F.coalesce("page_end", "page")
    rows = rows.withColumns({"page_from": F.least("page", page_end), "page_to": F.greatest("page", page_end)})

    of_parent = Window.partitionBy("doc_id", "parent").orderBy("pos")
    before, after = of_parent.rowsBetween(Window.unboundedPreceding, -1), of_parent.rowsBetween(1, Window.unboundedFollowing)
    other = F.when(F.col("type") != "callout", F.struct("pos", "type"))
    base = rows.withColumns({"_next": F.first(other, ignorenulls=True).over(after), "_last": F.last(other, ignorenulls=True).over(before)})
    goes_before = (F.col("type") == "callout") & (F.col("_next.type") == "list")
    goes_after = (F.col("type") == "callout") & F.col("_next").isNull() & (F.col("_last.type") == "list")
    base = base.withColumns({"list_before": F.when(goes_before, F.col("_next.pos")), "list_after": F.when(goes_after, F.col("_last.pos"))}).where("type != 'heading'")

    # Callouts that belong to a list are told to it.
    base = base.withColumn("_of", F.coalesce("list_before", "list_after", "pos"))
    together = Window.partitionBy("doc_id", "parent", "_of")
    said = F.struct("pos", "shown", "section_path")
    bound = {"heads": F.sort_array(F.collect_list(F.when(F.col("list_before").isNotNull(), said)).over(together)), "tails": F.sort_array(F.collect_list(F.when(F.col("list_after").isNotNull(), said)).over(together))}
    base = base.withColumns(bound | {"page_from": F.min("page_from").over(together), "page_to": F.max("page_to").over(together)}).where("_of = pos")
    base = base.withColumns({"first_path": F.coalesce(F.get(F.col("heads.section_path"), F.lit(0)), "section_path"), "heads": F.col("heads.shown"), "tails": F.col("tails.shown")})

    # Units: a block, or a part of a long one.
    listed = F.col("type") == "list"
    long_list = listed & (token_estimate(F.array_join(F.concat("heads", F.array("shown"), "tails"), "\n\n")) > s.procedure_max)
    base = base.withColumn("_g", F.when(long_list, F.col("_filled")).otherwise(F.transform("items", lambda i: F.lit(0))))
    whole_body = F.when(F.col("type") == "figure", F.col("text")).otherwise(F.col("shown"))
    n = F.when(listed, F.greatest(F.array_max("_g") + 1, F.lit(1))).when(F.col("_parts").isNotNull(), F.size("_parts")).otherwise(1)
    units = base.withColumn("_n", n).where("_n > 0").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = F.transform(F.filter(F.arrays_zip("_g", "items"), lambda x: x["_g"] == F.col("unit")), lambda x: F.concat_ws(" ", x["items"]["marker"], x["items"]["text"]))
    units = units.withColumn("_own", F.when(listed, own)).withColumn("_body", F.when(F.col("_parts").isNotNull(), F.get("_parts", F.col("unit"))).otherwise(whole_body))
    body = F.when(listed, F.array_join(F.concat("heads", F.array(F.array_join("_own", "\n")), "tails"), "\n\n")).when(F.col("type") == "figure", F.concat(F.lit(FIGURE_MARK + "\n"), "_body")).otherwise(F.col("_body"))
    kind = F.when(listed, F.when(F.coalesce("ordered", F.lit(False)), "procedure").otherwise("list")).when(F.col("type").isin("table", "callout", "figure"), F.col("type")).when(F.col("_parts").isNotNull(), "part").otherwise("fill")
    warning = F.when(listed, F.size("heads") + F.size("tails") > 0).otherwise(F.col("type") == "callout")
    part = F.when(listed & (F.col("_n") > 1), F.concat_ws("/", F.col("unit") + 1, "_n"))
    path = F.when(listed, F.col("first_path")).otherwise(F.col("section_path"))
    units = units.select("doc_id", "title", "parent", "pos", "unit", body.alias("body"), kind.alias("kind"), path.alias("section_path"), "page_from", "page_to", warning.alias("has_warning"), F.when(listed, F.size("_own")).alias("step_count"), part.alias("part"))
    units = units.withColumn("tokens", token_estimate(F.col("body")).cast("int"))

    # A parent's units in order, to the number of each one's piece; a parent is of a bounded size, or one block.
    every = F.sort_array(F.collect_list(F.struct("pos", "unit", "kind", "tokens", "body", "section_path", "page_from", "page_to", "has_warning", "step_count", "part")))
    held = units.groupBy("doc_id", "parent").agg(every.alias("u"), F.first("title").alias("title"))
    piece = _numbers(lambda kinds, own: pieces(kinds, own, s))(F.col("u.kind"), F.col("u.tokens"))
    units = held.withColumn("_piece", piece).repartition("doc_id").select("doc_id", "parent", "title", F.explode(F.arrays_zip("u", "_piece")).alias("x")).select("doc_id", "parent", "title", F.col("x._piece").alias("piece"), "x.u.*")
    place = F.struct("pos", "unit")
    children = units.groupBy("doc_id", "parent", "piece").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit", "body"))), lambda x: x["body"]), "\n\n").alias("body"), F.min_by("section_path", place).alias("section_path"), F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"),
        F.min_by(F.when(F.col("kind").isin("fill", "part"), "prose").otherwise(F.col("kind")), place).alias("kind"), F.bool_or("has_warning").alias("has_warning"), F.max("step_count").alias("step_count"), F.max("part").alias("part"), F.first("title").alias("title"),
    )
    whole = rows.groupBy("doc_id", "parent").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), "\n\n").alias("body"), F.min_by("section_path", "pos").alias("section_path"), F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"), F.lit("parent").alias("kind"), F.lit(False).alias("has_warning"), F.lit(None).cast("int").alias("step_count"), F.lit(None).cast("string").alias("part"), F.first("title").alias("title")
    )
    both = whole.withColumn("piece", F.lit(-1)).unionByName(children)
    text = F.concat("title", F.lit(TITLE_MARK), "section_path", F.when(F.col("piece") < 0, "\n\n").otherwise("\n"), "body")
    by_place = Window.partitionBy("doc_id").orderBy("parent", "piece")
    out = both.withColumns({"text": text, "chunk_index": F.row_number().over(by_place) - 1, "is_parent": F.col("piece") < 0})
    out = out.withColumn("parent_index", F.when(~F.col("is_parent"), F.max(F.when(F.col("is_parent"), F.col("chunk_index"))).over(by_place)))
    return out.select("doc_id", "chunk_index", "parent_index", "is_parent", "section_path", "text", "page_from", "page_to", "kind", "has_warning", "step_count", "part")
