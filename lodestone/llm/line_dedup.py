"""Line dedup: sharded cuckoo filters in front of exact reference counts.

State is two tables. ``counts`` holds, for every line key, the number of documents that have
it (exact). ``filters`` holds one cuckoo filter per shard of the key space with the keys whose
count has reached the limit. Inserting or deleting documents changes the counts, and the keys
that cross the limit are put into or taken out of their shard's filter; a shard that grows too
full is rebuilt from its counts. Texts are never altered in the state, so taking documents out
again gives lines back to the others.

Looking up: every line meets its shard's filter first; only lines that the filter knows are
joined with the exact counts, which decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import inner, join_keys, packed, row_udf, same_document, save, slices, table, text_bytes, unpacked

SLOTS = 4
#: Keys to a shard of the reference counts; bounds what one task holds of a filter.
KEYS_PER_SHARD = 500_000
#: Lines of one shard that a task looks up; shards with more lines are dealt over several tasks.
LINES_PER_TASK = 250_000
#: A layout table of up to so many shards (16 bytes each) is broadcast.
BROADCAST_SHARDS = 1_000_000


class CuckooFilter:
    """Buckets of four 16-bit fingerprints over 64-bit keys; supports deletion.

    ``insert`` returns False when no place is found; the caller then builds a larger filter
    from the exact counts. ``contains`` never misses a key that was inserted.
    """

    def __init__(self, n_keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1
            while n * SLOTS * 0.85 < max(n_keys, 1):
                n *= 2
            table = np.zeros((n, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = np.atleast_1d(x)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self._mix(np.asarray(keys, np.int64).view(np.uint64))
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return (bucket ^ self._mix(np.asarray(mark).astype(np.uint64))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        mark, a, b = self._places(keys)
        left = self._fill(mark, a, np.arange(len(mark)))
        left = self._fill(mark, b, left)
        return all(self._evict(mark[i], int(a[i])) for i in left.tolist())

    def _fill(self, mark: np.ndarray, bucket: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Put keys into free slots of their buckets, all at once; those for which no slot is left."""
        order = which[np.argsort(bucket[which], kind="stable")]
        if not len(order):
            return order
        own = bucket[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        turn = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        used = self.table[own] != 0
        fits = turn < SLOTS - used.sum(1)
        slot = np.argsort(used, axis=1, kind="stable")[np.arange(len(own)), np.minimum(turn, SLOTS - 1)]
        self.table[own[fits], slot[fits]] = mark[order[fits]]
        return order[~fits]

    def _evict(self, mark, at: int) -> bool:
        """Make room by moving marks to their other buckets."""
        for turn in range(500):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
            slot = turn % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int(self._other(np.uint64(at), mark)[0])
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Only for keys that were inserted."""
        mark, a, b = self._places(keys)
        left = np.arange(len(mark))
        for bucket in (a, b):
            # Of keys with the same mark in a bucket, each takes one of the slots that hold it.
            order = left[np.lexsort((mark[left], bucket[left]))]
            if not len(order):
                return
            own, m = bucket[order], mark[order]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (m[1:] != m[:-1])])
            turn = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            held = self.table[own] == m[:, None]
            there = turn < held.sum(1)
            slot = np.argsort(~held, axis=1, kind="stable")[np.arange(len(own)), np.minimum(turn, SLOTS - 1)]
            self.table[own[there], slot[there]] = 0
            left = order[~there]

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        n = len(keys)
        while True:
            made = cls(n)
            if made.insert(keys):
                return made
            n = max(2 * n, 8)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())


@dataclass
class LineState:
    """``counts``: k1 long, k2 long, shard int, n_docs long. ``filters``: shard int, filter binary."""

    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int
    min_chars: int


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lower-cased; b'' if it has under ``min_chars`` code points."""
    keys = [x.strip() for x in text.lower().split(b"\n")]
    if min_chars > 1:
        keys = [k if len(k.decode(errors="replace")) >= min_chars else b"" for k in keys]
    return keys


def _distinct_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each document and different key: id, fp, k1, k2 (a 128-bit hash of the key)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, hashes = [], []
            for i, text in enumerate(batch.column("text")):
                own = set(line_keys(text.as_py(), min_chars))
                own.discard(b"")
                at += [i] * len(own)
                hashes += [xxhash.xxh3_128_digest(k) for k in own]
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("fp").take(take), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=["id", "fp", "k1", "k2"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), text_bytes(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(keys, f"id {id_type}, fp long, k1 long, k2 long")


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("k2"), F.lit(n_shards)).cast("int")


def _count(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = _distinct_lines(docs, id_col, text_col, min_chars)
    # Rows that repeat a document count once; then partial sums before the shuffle by key.
    return lines.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_docs"))


def _filters(counts: DataFrame, min_docs: int) -> DataFrame:
    def build(key, rows):
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.build(rows["k1"].to_numpy()).to_bytes()]})

    hot = counts.where(F.col("n_docs") >= min_docs).select("shard", "k1")
    return hot.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def build_state(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> LineState:
    """Reference counts and filters of all lines of ``docs``."""
    counts = save(_count(docs, id_col, text_col, min_chars), "line-counts")
    n_shards = max(8, -(-counts.count() // KEYS_PER_SHARD))
    counts = counts.withColumn("shard", _shard(n_shards))
    return LineState(counts, save(_filters(counts, min_docs), "line-filters"), n_shards, min_docs, min_chars)


def update_state(state: LineState, docs: DataFrame, sign: int, id_col: str = "doc_id", text_col: str = "text") -> LineState:
    """``state`` after inserting (``sign`` 1) or deleting (-1) ``docs``; deleted documents must have been inserted.

    Where the keys have outgrown the shards (twice KEYS_PER_SHARD), they are dealt over more, with new filters.
    """
    change = _count(docs, id_col, text_col, state.min_chars).withColumn("d", F.col("n_docs") * sign).drop("n_docs")
    merged = (
        state.counts.select("k1", "k2", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("d"))
        .unionByName(change.withColumn("was", F.lit(0).cast("long")))
        .groupBy("k1", "k2")
        .agg(F.sum("was").alias("was"), F.sum("d").alias("d"))
        .select("k1", "k2", "was", (F.col("was") + F.col("d")).alias("n_docs"))
    )
    merged = save(merged, "line-counts")
    low, needed = state.min_docs, -(-merged.count() // KEYS_PER_SHARD)
    if needed > 2 * state.n_shards:
        counts = merged.where("n_docs > 0").drop("was").withColumn("shard", _shard(needed))
        return LineState(counts, save(_filters(counts, low), "line-filters"), needed, low, state.min_chars)
    merged = merged.withColumn("shard", _shard(state.n_shards))
    crossed = merged.where((F.col("was") >= low) != (F.col("n_docs") >= low)).select("shard", "k1", (F.col("n_docs") >= low).alias("enters"))

    def change_filter(key, old, rows):
        import pandas as pd

        held = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(rows))
        held.remove(rows.loc[~rows["enters"], "k1"].to_numpy())
        full = not held.insert(rows.loc[rows["enters"], "k1"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "filter": [None if full else held.to_bytes()]})

    changed = save(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(change_filter, "shard int, filter binary"), "line-filters")
    counts = merged.where("n_docs > 0").drop("was")
    full = changed.where("filter IS NULL").select("shard")
    rebuilt = _filters(counts.join(full, "shard", "left_semi"), low)
    return LineState(counts, save(changed.where("filter IS NOT NULL").unionByName(rebuilt), "line-filters"), state.n_shards, low, state.min_chars)


def _screen(lines: DataFrame, state: LineState) -> DataFrame:
    """The lines that their shard's filter knows.

    Filters and lines of a shard meet in one partition, the filter first, and lines pass it in
    batches: a task holds one filter and one batch, however many lines a key has. Shards with
    many lines are dealt over several tasks, each with a copy of the filter.
    """
    layout = state.counts.groupBy("shard").agg(F.ceil(F.sum("n_docs") / LINES_PER_TASK).cast("int").alias("salts"))
    layout = F.broadcast(layout) if state.n_shards <= BROADCAST_SHARDS else layout
    id_type = lines.schema["id"].dataType.simpleString()
    # Lines of unknown shards can't be repeated ones.
    lined = lines.withColumn("shard", _shard(state.n_shards)).join(layout, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "fp"), F.col("salts")).cast("int"))
    lined = lined.select("shard", "salt", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "id", "fp", "k1", "k2")
    filters = state.filters.join(layout, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    filters = filters.select("shard", "salt", F.lit(0).alias("kind"), "filter", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("long").alias("fp"), F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
            k1 = batch.column("k1").fill_null(0).to_numpy()
            known = np.zeros(len(kind), bool)
            starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])][: len(kind)])
            for lo, hi in zip(starts, np.r_[starts[1:], len(kind)], strict=True):
                if (shard[lo], salt[lo]) != place:
                    place, held = (shard[lo], salt[lo]), None
                if kind[lo] == 0:
                    held = CuckooFilter.from_bytes(batch.column("filter")[int(lo)].as_py())
                    lo += 1
                if held is not None and hi > lo:
                    known[lo:hi] = held.contains(k1[lo:hi])
            yield batch.select(["id", "fp", "k1", "k2"]).filter(pa.array(known))

    met = lined.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return met.mapInArrow(look_up, f"id {id_type}, fp long, k1 long, k2 long")


def dedup_lines(docs: DataFrame, state: LineState | None = None, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` freed of the lines whose key ``min_docs`` or more documents have, and ``n_lines``, ``n_dropped``.

    A document is an id with its text; rows that repeat both count once and get the same result.
    Null ids are allowed. A null or empty text is one empty line, which is never dropped, and
    comes back as the empty text; an empty table gives an empty result. Columns of the input
    named ``n_lines`` or ``n_dropped`` are replaced, others kept. Without ``state`` it is built
    from ``docs``.
    """
    state = state or build_state(docs, id_col, text_col, min_docs, min_chars)
    lines = _distinct_lines(docs, id_col, text_col, state.min_chars)
    repeated = state.counts.where(F.col("n_docs") >= state.min_docs).select("k1", "k2")
    found = join_keys(_screen(lines, state), repeated, ["k1", "k2"], ["id", "fp"])
    # At most a document's own lines meet in one list.
    gone = found.groupBy("id", "fp").agg(F.collect_set("k1").alias("gone"))
    least = state.min_chars

    def strip(text: pa.Array, gone: pa.Array) -> pa.Array:
        counts, dropped, kept = [], [], []
        for t, g in zip(text, gone, strict=True):
            t, g = t.as_py(), g.as_py()
            lines = t.split(b"\n")
            if g:
                g = set(g)
                hashed = {k: int.from_bytes(xxhash.xxh3_128_digest(k)[:8], "little", signed=True) for k in set(line_keys(t, least)) if k}
                keys = line_keys(t, least)
                left = [x for x, k in zip(lines, keys, strict=True) if not k or hashed[k] not in g]
            else:
                left = lines
            counts.append(len(lines))
            dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_lines", "n_dropped", "text"])

    rows = packed(docs, id_col, text_col)
    out = rows.join(gone, same_document(rows, gone), "left").withColumn("done", row_udf(strip, "n_lines long, n_dropped long, text string")(text_bytes(inner(docs, text_col)), F.col("gone")))
    return unpacked(out, docs.columns, **{"n_lines": F.col("done.n_lines"), "n_dropped": F.col("done.n_dropped"), text_col: F.col("done.text")})


def op10_line_dedup(spark, sf_dir):
    """Every document, with lines of 10 or more documents dropped everywhere."""
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)
), hot AS (
  SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT l.*, hot.k IS NOT NULL AS gone FROM l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
