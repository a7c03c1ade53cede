"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from lodestone.shared import drop_saved, save, shared_dir  # noqa: F401  the operators' tables

#: ASCII white space that separates words: space, \t, \n, \v, \f, \r. ``bytes.split()`` uses just these.
WHITESPACE = " \t\n\x0b\x0c\r"


def inner(docs: DataFrame, column: str) -> str:
    """The name that :func:`packed` gives a column of the caller."""
    return f"in{docs.columns.index(column)}"


def packed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The input's columns as ``in0``, ``in1``, ..., beside ``id``, ``fp`` and the columns named in ``more`` as ``c0``, ``c1``, ...

    The renaming keeps the caller's columns apart from the operators' own, whatever their names.
    ``(id, fp)`` stands for a document: rows that repeat an id with the same text are one document.
    """
    return docs.select(
        *[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(docs.columns)],
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("fp"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)],
    )


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The caller's columns under their own names; those of ``new`` replace columns of the same name."""
    return df.select(
        *[F.col(f"in{i}").alias(c) for i, c in enumerate(columns) if c not in new],
        *[v.alias(k) for k, v in new.items()],
    )


def same_document(left: DataFrame, right: DataFrame, *more: str) -> Column:
    """Join condition on ``(id, fp)`` and ``more``, nulls equal."""
    on = left["id"].eqNullSafe(right["id"]) & (left["fp"] == right["fp"])
    for c in more:
        on = on & left[c].eqNullSafe(right[c])
    return on


def text_bytes(column: str | Column) -> Column:
    """A text as UTF-8 bytes; null reads as the empty text."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


#: Rows, and bytes of text, of an Arrow batch that are Python objects at once.
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 22


def cuts(column: pa.Array | None, rows: int, n: int) -> Iterator[tuple[int, int]]:
    """Start and number of the rows to take at once: up to ``rows``, and BYTES_AT_ONCE where a row is no longer by itself."""
    size = np.zeros(n, np.int64)
    if column is not None and (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, more in enumerate(size.tolist()):
        if i > at and (i - at == rows or held + more > BYTES_AT_ONCE):
            yield at, i - at
            at, held = i, 0
        held += more
    if n > at:
        yield at, n - at


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2 * ROWS_AT_ONCE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller ones, so that few rows are Python objects or result arrays at once."""
    for batch in batches:
        texts = batch.column(column) if column in batch.schema.names else None
        for at, n in cuts(texts, rows, len(batch)):
            yield batch.slice(at, n)
        pa.default_memory_pool().release_unused()


def row_udf(make: Callable[..., pa.Array], returns: str) -> Callable[..., Column]:
    """An Arrow UDF that ``make`` answers for a few rows at once; the first column is the one whose bytes count.

    It counts as nondeterministic, so that Spark neither runs it again for a filter on its result
    nor starts a second Python worker for that.
    """

    def run(*columns: pa.Array) -> pa.Array:
        made = [make(*(c.slice(at, n) for c in columns)) for at, n in cuts(columns[0], ROWS_AT_ONCE, len(columns[0]))]
        made = pa.concat_arrays(made) if made else make(*columns)
        pa.default_memory_pool().release_unused()
        return made

    return F.arrow_udf(run, returns, ArrowUDFType.SCALAR).asNondeterministic()


def parts(text: str, border: re.Pattern, most: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces of ``most`` characters and up to the next one that ``border`` matches, which is left out."""
    at = 0
    while len(text) - at > most and (found := border.search(text, at + most)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


#: A table of up to so many rows of a few dozen bytes is sent to all tasks; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Tasks over which the rows of one key are dealt then.
SALTS = 32


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, a saved table that has each value of ``on`` once at most; nulls are equal.

    A short table is broadcast. Beyond BROADCAST_ROWS it is joined by shuffle; the rows of one
    value may be any share of all, so they are dealt over SALTS tasks by a hash of ``spread``.
    """
    other = keys.withColumnsRenamed({c: f"on_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(f"on_{c}"))
    if keys.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(other), met, how)
    else:
        # The estimate of its size leaves the salts out, so it is said that it must not be broadcast.
        other = other.withColumn("on_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
        out = rows.join(other, met & (F.col("salt") == F.col("on_salt")), how).drop("salt")
    return out.drop(*[f"on_{c}" for c in on], "on_salt") if how not in ("left_semi", "left_anti") else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
