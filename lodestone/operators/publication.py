"""Publication: versions go live and out again, whole or not at all, as new snapshots of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.merging import keep_smallest


def publish_version(chunks: DataFrame, documents: DataFrame, doc_id, version: int, as_of: Column) -> DataFrame:
    """``chunks`` with ``version`` of the document live and lower versions superseded.

    Raises if the version is missing, is not the current one, has no child chunk, or has one
    without a vector; then nothing changes.
    """
    mine = (F.col("doc_id") == doc_id) & (F.col("version") == version)
    current = documents.where(F.col("doc_id") == doc_id).select("version").first()
    if current is None or current[0] != version:
        raise ValueError("the version is missing or isn't the current one")
    n, bare = chunks.where(mine & ~F.col("is_parent") & F.col("deleted_at").isNull()).agg(F.count("*"), F.count(F.when(F.col("embedding").isNull(), 1))).first()
    if not n or bare:
        raise ValueError("the version has no chunks" if not n else "a chunk has no vector")
    lower = (F.col("doc_id") == doc_id) & (F.col("version") < version)
    live = F.when(mine & F.col("deleted_at").isNull(), ~F.col("is_parent")).when(lower, F.lit(False)).otherwise(F.col("is_live"))
    gone = F.when(lower & F.col("deleted_at").isNull(), as_of).otherwise(F.col("deleted_at"))
    return chunks.withColumns({"is_live": live, "deleted_at": gone})


def retire(documents: DataFrame, chunks: DataFrame, images: DataFrame, doc_id, status: str, superseded_by=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with a document out of the index: its rows are not live any more, but not deleted, so old citations resolve.

    ``superseded_by`` names the document that gets ``supersedes_doc_id``.
    """
    if status not in ("superseded", "archived"):
        raise ValueError(f"status must be superseded or archived, not {status}")
    own = F.col("doc_id") == doc_id
    documents = documents.withColumn("status", F.when(own, status).otherwise(F.col("status")))
    if superseded_by is not None:
        documents = documents.withColumn("supersedes_doc_id", F.when(F.col("doc_id") == superseded_by, F.lit(doc_id)).otherwise(F.col("supersedes_doc_id")))
    chunks, images = (t.withColumn("is_live", F.when(own, False).otherwise(F.col("is_live"))) for t in (chunks, images))
    return documents, chunks, images


def publish_sheet(entries: DataFrame, org: str, sheet_version: int, as_of: Column) -> DataFrame:
    """``entries`` with this sheet version live and lower ones out and deleted. Raises if it has no rows."""
    own = (F.col("org_id") == org) & F.col("deleted_at").isNull()
    if entries.where(own & (F.col("sheet_version") == sheet_version)).limit(1).count() == 0:
        raise ValueError(f"no rows for sheet version {sheet_version}")
    now, before = own & (F.col("sheet_version") == sheet_version), own & (F.col("sheet_version") < sheet_version)
    live = F.when(now, True).when(before, False).otherwise(F.col("is_live"))
    return entries.withColumns({"is_live": live, "deleted_at": F.when(before, as_of).otherwise(F.col("deleted_at"))})


def approve_cards(old: DataFrame, new: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards that may be as ``new`` says, and those that may not (card_id, why).

    A card that turns live needs ``approve`` or ``edit`` as its latest action and both vectors; it
    then is ``indexed``. Other changes pass.
    """
    of_cards = actions.where("entity_type = 'call_card'")
    latest = of_cards.groupBy(F.col("entity_id").alias("card_id")).agg(F.max_by("action", F.struct("created_at", "action_id")).alias("latest"))
    was = old.select("card_id", F.col("is_live").alias("was_live"))
    cards = new.join(was, "card_id", "left").join(latest, "card_id", "left")
    turns = F.col("is_live") & ~F.coalesce("was_live", F.lit(False))
    why = F.when(turns & ~F.coalesce("latest", F.lit("")).isin("approve", "edit"), "no approval").when(turns & (F.col("symptom_vec").isNull() | F.col("resolution_vec").isNull()), "no vectors")
    cards = cards.withColumn("why", why)
    status = F.when(turns, "indexed").otherwise(F.col("review_status"))
    return cards.where("why IS NULL").withColumn("review_status", status).select(*new.columns), cards.where("why IS NOT NULL").select("card_id", "why")


def final_status(n_chunks: Column, failed_pages: Column, archived: Column) -> Column:
    """What a document's ingestion ends as."""
    return F.when(n_chunks == 0, "failed").when(failed_pages > 0, "completed_with_errors").when(archived, "completed").otherwise("rag_completed")


def publishable(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, version, n_chunks, failed_pages, publishes: a version goes out whole, with chunks that all have vectors and no failed page, or not at all."""
    key = ["doc_id", "version"]
    failed = pages.groupBy(*key).agg(F.count(F.when(F.col("status") == "failed", 1)).alias("failed_pages"))
    made = chunks.where("NOT is_parent").groupBy(*key).agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("bare"))
    out = documents.select(*key).join(failed, key, "left").join(made, key, "left").na.fill(0, ["failed_pages", "n_chunks", "bare"])
    return out.withColumn("publishes", (F.col("n_chunks") > 0) & (F.col("bare") == 0) & (F.col("failed_pages") == 0)).drop("bare")


def clear_unpublished(chunks: DataFrame, doc_id, version: int) -> DataFrame:
    """``chunks`` without the rows of a version that are not live; what was published stays."""
    own = (F.col("doc_id") == doc_id) & (F.col("version") == version)
    return chunks.where(~F.coalesce(own & ~F.col("is_live"), F.lit(False)))


def new_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads whose bytes no completed document has; of equal ones, that with the smallest id."""
    done = documents.where(F.col("status").isin("completed", "rag_completed", "completed_with_errors")).select("hash")
    return keep_smallest(uploads.join(done, "hash", "left_anti"), ["hash"], "upload_id")
