"""Merges of keyed snapshots, in place of in-place updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in or put over it. ``rules`` gives, for a column, its value
    from (old, new) where both have the key. Null keys never match."""
    rules = rules or {}
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.withColumn("_old", F.lit(1)).alias("o").join(n.withColumn("_new", F.lit(1)).alias("n"), on, "full")
    picked = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        over = rules[c](a, b) if c in rules else b
        picked.append(F.when(F.col("_new").isNull(), a).when(F.col("_old").isNull(), b).otherwise(over).alias(c))
    return both.select(*picked)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; of rows of ``new`` that share one, one goes in."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def kept_unless_changed(column: str, changes: str) -> Callable[[Column, Column], Column]:
    """A rule for :func:`upsert`: the old value of ``column`` while ``changes`` is the same in both (nulls equal), else null."""
    return lambda a, b: F.when(F.col(f"o.{changes}").eqNullSafe(F.col(f"n.{changes}")), F.col(f"o.{column}"))


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str, cleared: dict[str, str], busy: DataFrame, audit: str, as_of: Column) -> dict[str, DataFrame]:
    """``tables`` without the rows of the keys in ``gone``.

    Keys that ``busy`` has stay. In the tables named in ``cleared`` the given column is set to null
    instead. One row for each purged key (key, action, at) is appended to the table ``audit``.
    """
    free = gone.select(key).distinct().join(busy.select(key), key, "left_anti")
    out = {}
    for name, table in tables.items():
        if name == audit:
            out[name] = table.unionByName(free.select(key, F.lit("purged").alias("action"), as_of.alias("at")))
        elif name in cleared:
            c = cleared[name]
            marked = table.join(free.select(F.col(key).alias("_gone")), F.col(c) == F.col("_gone"), "left")
            out[name] = marked.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
        else:
            out[name] = table.join(free, key, "left_anti")
    return out


def outbox(old: DataFrame, events: DataFrame) -> DataFrame:
    """``old`` (id, status, attempts, body) after ``events`` (id, event, body): append, sent, failed, discarded; one for each id.

    Sent and discarded entries leave; a failed one counts an attempt; an append of a known id changes nothing.
    """
    o, e = old.alias("o"), events.alias("e")
    both = o.join(e, F.col("o.id") == F.col("e.id"), "full")
    event, new = F.coalesce("e.event", F.lit("")), F.col("o.id").isNull()
    out = both.where(F.when(new, event == "append").otherwise(~event.isin("sent", "discarded")))
    failed = event == "failed"
    return out.select(
        F.coalesce("o.id", "e.id").alias("id"),
        F.when(failed, "failed").otherwise(F.coalesce("o.status", F.lit("queued"))).alias("status"),
        (F.coalesce("o.attempts", F.lit(0)) + failed.cast("int")).alias("attempts"),
        F.coalesce("o.body", "e.body").alias("body"),
    )


def orphans(files: DataFrame, references: DataFrame, key: str, as_of: Column, minutes: int = 10) -> DataFrame:
    """The files that nothing refers to and that are older than ``minutes``."""
    old = files.where(F.col("modified") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return old.join(references.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``new`` has are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``changes`` has, for each column c, ``set_c`` (boolean) and c; only set columns change, to null too."""
    renamed = changes.select(key, *[F.col(f"set_{c}") for c in columns], *[F.col(c).alias(f"_to_{c}") for c in columns])
    out = old.join(renamed, key, "left")
    values = {c: F.when(F.coalesce(F.col(f"set_{c}"), F.lit(False)), F.col(f"_to_{c}")).otherwise(F.col(c)) for c in columns}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in old.columns])


def keep_smallest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest ``order``; partial minima, so no key's rows meet in one task."""
    least = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(order))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(least.alias("_r")).select("_r.*")
