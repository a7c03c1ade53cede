"""Links between vectors that share a bucket, by exact cosines in blocks.

Whatever deals vectors into buckets so that similar ones meet (filters, hash codes) is the caller's.
Buckets with the same vectors are one; a bucket of any size is cut into blocks that meet pair by
pair; a pair that shares several buckets counts in the first one alone. A task hands on a row or
two for each vector that it compares, never a row for each pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import drop_saved, save

#: Vectors of a bucket that are compared at once; larger buckets are cut into blocks.
BLOCK = 2048
#: Rows of small buckets, about, that one call of the comparison takes.
BUNDLE = 4096
#: Buckets up to which their table is sent to all tasks; beyond it rows meet theirs over SALTS tasks a bucket.
BROADCAST_BUCKETS = 200_000
SALTS = 32


def _linked(v: np.ndarray, w: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``v`` and ``w`` have a cosine of ``cosine`` or more."""
    with np.errstate(over="ignore", invalid="ignore"):
        return v @ w.T / np.sqrt((v**2).sum(1)[:, None] * (w**2).sum(1)[None, :]) >= cosine


def _first_shared(buckets: list[np.ndarray], own: int, n: int) -> np.ndarray:
    """Which of the first ``n`` vectors and the others, or all if ``n`` is 0, share no bucket before ``own``."""
    size = [int(np.searchsorted(f, own)) for f in buckets]
    names, number, count = np.unique(np.concatenate([f[:s] for f, s in zip(buckets, size, strict=True)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(buckets)), size)
    many = count[number] > 1
    row, number = row[many], np.unique(number[many], return_inverse=True)[1]
    shared = np.zeros((n or len(buckets), len(buckets) - n), np.float32)
    for at in range(0, int(number.max(initial=-1)) + 1, 4096):
        inside = (number >= at) & (number < at + 4096)
        held = np.zeros((len(buckets), 4096), np.float32)
        held[row[inside], number[inside] - at] = 1
        shared += held[: n or None] @ held[n:].T
    return shared == 0


def _one(v: np.ndarray, weight: np.ndarray, buckets: list[np.ndarray], own: int, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links, their links, and the row that stands for their component. ``n``: of the first block, 0 if there is one."""
    met = _linked(v[: n or None], v[n:], cosine)
    if not n:
        np.fill_diagonal(met, False)
    rows = np.unique(np.r_[np.flatnonzero(met.any(1)), n + np.flatnonzero(met.any(0))])
    if not len(rows):
        return rows, rows, rows
    left, right = rows[rows < n] if n else rows, rows[rows >= n] - n
    met = met[np.ix_(left, right)]
    k = len(left) if n else 0
    counted = met & _first_shared([buckets[i] for i in rows], own, k)
    w = weight[rows]
    links = np.r_[counted @ w[k:], w[:k] @ counted] if n else counted @ w
    root = np.arange(len(rows))
    while True:
        if n:
            low = np.minimum(root[:k], np.where(met, root[None, k:], len(rows)).min(1))
            new = np.r_[low, np.minimum(root[k:], np.where(met, low[:, None], len(rows)).min(0))]
        else:
            new = np.minimum(root, np.where(met, root[None, :], len(rows)).min(1))
        if (new == root).all():
            return rows, links, rows[root]
        root = new


FIELDS = ["id", "h", "dim", "v", "weight", "buckets", "bucket", "group", "second"]


def _compare(cosine: float):
    """Of the vectors of some buckets: for each one with links how many it has there, and the first one that it is connected with."""

    def run(found: pa.Table) -> pa.Table:
        found = found.select(FIELDS).combine_chunks().sort_by([(c, "ascending") for c in ("dim", "group", "bucket", "second", "id", "h")])
        dims, groups, names, second = (found[c].to_numpy() for c in ("dim", "group", "bucket", "second"))
        weight, lists = found["weight"].to_numpy(), found["buckets"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        edge = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (groups[1:] != groups[:-1]) | (names[1:] != names[:-1]), True])
        who, links, root = [], [], []
        for at, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            v = found["v"].slice(at, end - at).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(end - at, -1)
            own = [flat[ends[i] : ends[i + 1]] for i in range(at, end)]
            n = int((~second[at:end]).sum()) if second[at:end].any() else 0
            rows, count, stands = _one(v, weight[at:end], own, names[at], n, cosine)
            who.append(rows + at), links.append(count), root.append(stands + at)
        take, lead = (pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (who, root))
        count = np.concatenate(links) if links else np.empty(0, np.int64)
        return pa.table([found["id"].take(take), found["h"].take(take), pa.array(count, pa.int64()), found["id"].take(lead), found["h"].take(lead)], names=["id", "h", "links", "rid", "rh"])

    return run


def links(nodes: DataFrame, posts: DataFrame, cosine: float) -> DataFrame:
    """For vectors with links, a saved row for each bucket and block: id, h, links (counted there), rid, rh (a vector it is connected with).

    ``nodes``: id, h (together unique), label, dim, v (array of doubles), weight; ``posts``: label, dim,
    bucket, id, h, once each, saved. Only vectors of one label and length meet. The sum of a vector's
    ``links`` is the weight of all that it links with.
    """
    on = ["label", "dim", "bucket"]
    # A bucket of one vector tells nothing; those that have the same vectors tell the same.
    sums = [F.sum(F.xxhash64(F.lit(k), "id", "h").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    buckets = posts.groupBy(*on).agg(F.count("*").alias("c"), *sums).where("c > 1")
    buckets = save(buckets.groupBy("label", "dim", "c", "s1", "s2").agg(F.min("bucket").alias("bucket")).select(*on, "c"), "buckets")
    known, small = buckets.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))), F.lit(0))).first()
    if known <= BROADCAST_BUCKETS:
        shared = posts.join(F.broadcast(buckets), on)
    else:
        # A bucket may hold any share of all vectors.
        salted = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # The estimate of its size leaves the salts out, so it is said that it must not be broadcast.
        shared = posts.withColumn("salt", F.pmod(F.xxhash64("id", "h"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*on, "salt"])
    member = shared.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("in")).withColumnsRenamed({"id": "mid", "h": "mh"})
    member = member.join(nodes, (F.col("mid") == F.col("id")) & (F.col("mh") == F.col("h")))
    each = member.select("id", "h", "label", "dim", "v", "weight", F.transform("in", lambda x: x["bucket"]).alias("buckets"), F.explode("in").alias("own"))
    each = each.select("*", F.col("own.bucket").alias("bucket"), F.ceil(F.col("own.c") / BLOCK).cast("int").alias("parts")).drop("own")
    each = each.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id", "h"), "parts").cast("int"))
    # A block meets itself, those before it as the second one, and those after it as the first one.
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    each = each.withColumns({"second": F.col("part") > F.col("other"), "group": F.xxhash64("label", lo, hi)})
    bundles = max(1, math.ceil(small / BUNDLE))
    bundle = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label", "dim", "bucket"), F.lit(bundles)).cast("long")).otherwise(F.lit(-1).cast("long"))
    whole = F.when(F.col("parts") > 1, F.struct(*on, lo.alias("lo"), hi.alias("hi")))
    kind = nodes.schema["id"].dataType.simpleString()
    found = each.select(*FIELDS, bundle.alias("bundle"), whole.alias("whole")).groupBy("bundle", "whole").applyInArrow(_compare(cosine), f"id {kind}, h long, links long, rid {kind}, rh long")
    found = save(found, "bucket-links")
    drop_saved(buckets)
    return found


def edges(found: DataFrame) -> DataFrame:
    """The pairs (a, b) of (id, h) that :func:`links` connects, enough of them for the components."""
    return found.select(F.struct("id", "h").alias("a"), F.struct(F.col("rid").alias("id"), F.col("rh").alias("h")).alias("b")).distinct()
