"""Expressions over files, ids and replies of services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of documents by the extension of their names, and how their bytes begin, in hexadecimal. Fixed values.
KINDS = {"pdf": "pdf", "docx": "docx", "jpg": "image", "jpeg": "image", "png": "image"}
MAGIC = {"pdf": "25504446", "docx": "504B0304", "jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E47"}
#: The largest document and recording, in bytes. Fixed values.
MOST_DOCUMENT, MOST_AUDIO = 500 * 1024 * 1024, 25 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def kind_of(name: Column) -> Column:
    """pdf, docx or image; null for other names."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), extension(name))


def matches_kind(name: Column, content: Column) -> Column:
    """Whether the bytes begin as the name says."""
    begins = F.hex(F.substring(content, 1, 4))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in MAGIC.items() for x in pair]), extension(name))
    return F.coalesce(F.startswith(begins, wanted), F.lit(False))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


#: Codes of a network that failed for the moment, and the name of a call that ran out of time. Fixed values.
NETWORK, ABORTED = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "EAI_AGAIN"), "AbortError"


def retries(status: Column, code: Column, always_without_status: bool = False) -> Column:
    """Whether a failed call is worth another try: 408, 429 and 500 to 599; without a status by the network's code or the error's name, or always for a worker."""
    none = F.lit(True) if always_without_status else F.coalesce(code.isin(*NETWORK, ABORTED), F.lit(False))
    return F.when(status.isNull(), none).otherwise(status.isin(408, 429) | status.between(500, 599))


def contains_escaped(column: Column, part: str) -> Column:
    """Whether the text holds ``part``, whatever its case; wildcards in it stand for themselves."""
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.ilike(column, F.lit(f"%{escaped}%"))
