"""Everything under a folder, by pointer doubling: paths, types, shortcuts, and what is skipped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.files import kind_of
from lodestone.shared import drop_saved, save

#: Kinds of items by their media type; what an exported one becomes; endings of media types. Fixed values.
FOLDER, SHORTCUT = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"
EXPORTED = {"application/vnd.google-apps.document": "Google Doc", "application/vnd.google-apps.spreadsheet": "Google Sheet"}
ENDINGS = {"application/pdf": ".pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "image/jpeg": ".jpg", "image/png": ".png"}
PATH_MARK = " / "
TO_FOLDER, LISTED = "Shortcut to a folder", "Shortcut to a file already listed"


def _pick(table: dict[str, str], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(key))


def file_name() -> Column:
    """The title a document gets: the name, with ``.pdf`` behind an exported one and an ending behind one that has none known."""
    exported = F.when(F.lower("name").endswith(".pdf"), F.col("name")).otherwise(F.concat("name", F.lit(".pdf")))
    return F.when(_pick(EXPORTED, "mime").isNotNull(), exported).when(kind_of(F.col("name")).isNotNull(), F.col("name")).otherwise(F.concat("name", F.coalesce(_pick(ENDINGS, "mime"), F.lit(""))))


def classified(items: DataFrame) -> DataFrame:
    """``items`` (name, mime) with ``file_name``, ``type`` and ``supported``; the first rule that fits decides."""
    out = items.withColumn("file_name", file_name())
    kind, name, mime = kind_of(F.col("file_name")), F.lower("name"), F.col("mime")
    rules = [
        (_pick(EXPORTED, "mime").isNotNull(), _pick(EXPORTED, "mime"), True),
        (mime == SHORTCUT, F.lit("Shortcut"), False),
        (mime == "application/vnd.google-apps.presentation", F.lit("Slides"), False),
        (F.startswith(mime, F.lit("application/vnd.google-apps.")), F.lit("Other Google file"), False),
        (kind == "pdf", F.lit("PDF"), True),
        (kind == "docx", F.lit("Word"), True),
        (kind == "image", F.lit("Image"), True),
        (name.endswith(".doc"), F.lit("Old Word (.doc)"), False),
        (name.rlike(r"\.(xlsx|xls|xlsm|csv)$"), F.lit("Excel file"), False),
        (name.rlike(r"\.(pptx|ppt)$"), F.lit("Slides"), False),
        (F.startswith(mime, F.lit("video/")), F.lit("Video"), False),
        (F.startswith(mime, F.lit("image/")), F.lit("Other image"), False),
    ]
    kinds, takes = F.when(F.lit(False), ""), F.when(F.lit(False), False)
    for test, value, good in rules:
        kinds, takes = kinds.when(test, value), takes.when(test, good)
    return out.withColumns({"type": kinds.otherwise("Other"), "supported": takes.otherwise(False)})


def folder_paths(folders: DataFrame, root: str) -> DataFrame:
    """The folders (id, parent, name) that ``root`` leads to: id, path (array of name and id from below the root; its own is empty).

    Each round a folder's pointer jumps as far again as its target's does, so the rounds are the
    logarithm of the depth. Folders of a cycle, and those below one, never reach the root; they stop
    counting after as many rounds as all folders in one line would need. Names follow
    only the folders that reach the root. A folder with several parents is listed where its smallest parent id is.
    """
    own = folders.groupBy("id").agg(F.min(F.struct("parent", "name")).alias("p")).select("id", F.col("p.parent").alias("up"), F.col("p.name").alias("name"))
    own = own.where((F.col("id") != root) & F.col("up").isNotNull())
    state = save(own.select("id", F.when(F.col("up") == root, F.lit(None)).otherwise(F.col("up")).alias("up"), (F.col("up") == root).alias("in")), "folders")
    n = state.count()
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        beyond = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("in").alias("_in"))
        moved = state.where("up IS NOT NULL").join(beyond, "up", "left").select("id", F.col("_up").alias("up"), F.coalesce("_in", F.lit(False)).alias("in"))
        new = save(state.where("up IS NULL").unionByName(moved), "folders")
        drop_saved(state)
        state = new
        if state.where("up IS NOT NULL").isEmpty():
            break
    reached = own.join(state.where("in").select("id"), "id", "left_semi")
    step = F.array(F.struct("name", "id"))
    line = save(reached.select("id", F.when(F.col("up") != root, F.col("up")).alias("up"), step.alias("path")), "paths")
    while not line.where("up IS NOT NULL").isEmpty():
        above = line.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        moved = line.where("up IS NOT NULL").join(above, "up").select("id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        new = save(line.where("up IS NULL").unionByName(moved), "paths")
        drop_saved(line)
        line = new
    top = line.sparkSession.range(1).select(F.lit(root).cast(line.schema["id"].dataType).alias("id"), F.lit(None).cast(line.schema["path"].dataType).alias("path"))
    return line.select("id", "path").unionByName(top.withColumn("path", F.coalesce("path", F.array().cast(line.schema["path"].dataType))))


def resolved(items: DataFrame) -> DataFrame:
    """``items`` (id, name, mime, parent, target_id, target_mime) where a shortcut to a file stands for it under the shortcut's name; ``_folder``: one that leads to a folder."""
    leads = (F.col("mime") == SHORTCUT) & F.col("target_id").isNotNull()
    folder = leads & F.coalesce(F.col("target_mime") == FOLDER, F.lit(False))
    stands = leads & ~folder
    return items.withColumns({"_folder": folder, "id": F.when(stands, F.col("target_id")).otherwise(F.col("id")), "mime": F.when(stands, F.col("target_mime")).otherwise(F.col("mime"))})


def listing(items: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """All files under ``root``, (id, file_name, type, folder, ord), and how many items were skipped, (type, n).

    ``items``: id, name, mime, parent, target_id, target_mime. A folder's own files come by name, then
    its folders by name, each with what is below it; ``ord`` has that order, and ``folder`` the names of the
    folders on the way. Of items that mean one file the first counts. Unsupported kinds are skipped by their
    type. What a cycle of folders cuts off from the root isn't listed at all. Names that tie go by id.
    """
    folders = items.where(F.col("mime") == FOLDER).select("id", "parent", "name")
    paths = folder_paths(folders, root).withColumnRenamed("id", "parent")
    here = resolved(items.where(F.coalesce(F.col("mime") != FOLDER, F.lit(True)))).join(paths, "parent")
    sorted_out = classified(here)
    skipped = sorted_out.where("_folder OR NOT supported").select(F.when(F.col("_folder"), F.lit(TO_FOLDER)).otherwise(F.col("type")).alias("type"))
    taken = sorted_out.where("NOT _folder AND supported").withColumn("ord", F.struct("path", "name", "id"))
    first = taken.groupBy("id").agg(F.min("ord").alias("ord"), F.min_by(F.struct("file_name", "type", "path"), "ord").alias("f"), F.count("*").alias("n"))
    again = first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).where("n > 0").select(F.lit(LISTED).alias("type"), "n")
    files = first.select("id", "f.file_name", "f.type", F.array_join(F.transform("f.path", lambda p: p["name"]), PATH_MARK).alias("folder"), "ord")
    return files, skipped.groupBy("type").agg(F.count("*").alias("n")).unionByName(again)


def position(files: DataFrame) -> DataFrame:
    """``files`` of :func:`listing` with ``rank`` from 1 in its order, for a listing that one page shows."""
    return files.withColumn("rank", F.row_number().over(Window.orderBy("ord")))
