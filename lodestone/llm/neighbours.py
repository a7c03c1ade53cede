"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files
of its first ``posts`` pivots; a query looks into the files of its first ``probes`` pivots,
ranks what it finds there by the footrule distance of the orders, and the nearest part of each
file is ranked again by the exact inner product.

Pivots that post stand apart from each other, so a dense group takes few of them and leaves its
neighbours' files alone. As they tell little apart inside such a group, orders of further pivots,
drawn in proportion to the vectors, rank each file a second time.

Vectors that are equal are indexed once, with the smallest ids that a result could name, so a
vector with very many copies costs no more than another one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import save, table

#: Different vectors of one file that a task ranks; longer files are dealt over several tasks.
VECTORS_PER_TASK = 20_000
#: Different vectors, about, that come to the driver as the choice of pivots.
SAMPLE = 4096


def orders(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The pivots of each vector from nearest to farthest, and each pivot's place in that order, cut at ``depth``."""
    near = np.concatenate([vectors, extra[:, None]], 1) @ pivots.T
    order = np.argsort(-near, axis=1, kind="stable")
    places = np.full(order.shape, depth, np.uint8)
    np.put_along_axis(places, order[:, :depth], np.arange(min(depth, order.shape[1]), dtype=np.uint8)[None, :].repeat(len(order), 0), 1)
    return order, places


def standing_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of ``points``: the first, then each time the one farthest from those taken."""
    taken, away = [0], np.full(len(points), np.inf)
    while len(taken) < min(n, len(points)):
        away = np.minimum(away, ((points - points[taken[-1]]) ** 2).sum(1))
        away[taken[-1]] = -1.0
        taken.append(int(away.argmax()))
    return points[taken]


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    n_pivots: int = 128,
    n_drawn: int = 64,
    depth: int = 64,
    posts: int = 8,
    probes: int = 20,
    rerank_share: float = 0.25,
    rerank_least: int = 200,
) -> DataFrame:
    """For each row that ``is_query`` selects, its ``k`` nearest other rows: query_id, rank from 1, vec_id, score.

    Nearness is the inner product in double precision, ties to the smaller id. The only sample
    taken, by hash, has some ``SAMPLE`` different vectors: ``n_pivots`` of them that stand far
    apart post and rank, ``n_drawn`` others rank; every row is indexed. Of a file,
    ``rerank_share`` by each ranking is ranked exactly, but ``rerank_least`` vectors by each
    at least. For inner products of vectors that differ in length, each indexed vector
    gets one more component that brings it to the greatest length; queries get 0 there.

    Rows whose id or vector is null, and vectors that are empty, zero, hold a null or a component
    that isn't finite, take no part. Vectors of one length are searched among their own, each length
    with an index of its own. Rows that repeat an id with its vector are one row; fewer than ``k``
    candidates are all returned; an empty table gives an empty result. Other columns are not carried.
    """
    c = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), c.alias("v"), is_query.alias("asks"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(usable)
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths:
        found = _of_length(rows.where(F.size("v") == dim), dim, k, n_pivots, n_drawn, depth, posts, probes, rerank_share, rerank_least)
        out = found if len(lengths) == 1 else out.unionByName(found)
    return out


def _of_length(rows: DataFrame, dim: int, k: int, n_pivots: int, n_drawn: int, depth: int, posts: int, probes: int, rerank_share: float, rerank_least: int) -> DataFrame:
    """:func:`nearest` among usable vectors (id, v, asks) of one length."""
    spark = rows.sparkSession
    # + 0.0 makes a negative zero equal to zero.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})

    ids = Window.partitionBy("h1", "h2").orderBy("id")
    first = rows.select("id", "h1", "h2").distinct().withColumn("n", F.row_number().over(ids)).where(F.col("n") <= k + 1)
    first = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    different = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.bool_or("asks").alias("asks"))
    different = save(different.join(first, ["h1", "h2"]), "ann-vectors")

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    greatest, n_different = different.agg(F.max(length), F.count("*")).first()
    # Bounded: some SAMPLE vectors come to the driver, n_pivots + n_drawn go to the tasks.
    share = math.ceil(n_different / SAMPLE)
    sample = different.where(F.pmod("h1", F.lit(share)) == 0).select("h1", "h2", "v").toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
    points = np.array(sample["v"].to_pylist())
    points = np.concatenate([points, np.sqrt(np.maximum(greatest - (points**2).sum(1), 0))[:, None]], 1)
    held = spark.sparkContext.broadcast((standing_apart(points, n_pivots), points[:n_drawn]))
    apart = min(n_pivots, len(points))

    def index(asks: bool, files: int):
        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
                extra = np.zeros(len(v)) if asks else np.sqrt(np.maximum(greatest - (v**2).sum(1), 0))
                order, places = orders(v, extra, held.value[0], depth)
                places = np.concatenate([places, orders(v, extra, held.value[1], depth)[1]], 1)
                n = min(files, order.shape[1])
                take = pa.array(np.arange(len(v)).repeat(n))
                out = [pa.array(order[:, :n].astype(np.int32).ravel()), *(batch.column(c).take(take) for c in ("h1", "h2"))]
                for m in (v, places):
                    out.append(pa.array([row.tobytes() for row in np.ascontiguousarray(m)], pa.binary()).take(take))
                names = ["pivot", "h1", "h2", "v", "places"]
                if not asks:
                    out.append(batch.column("ids").take(take))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

        return run

    entry = "pivot int, h1 long, h2 long, v binary, places binary"
    posted = different.select("h1", "h2", "v", "ids").mapInArrow(index(False, posts), entry + ", ids array<long>")
    asked = different.where("asks").select("h1", "h2", "v").mapInArrow(index(True, probes), entry)
    posted = save(posted, "ann-files")
    # One row for each pivot.
    layout = posted.groupBy("pivot").agg(F.ceil(F.count("*") / VECTORS_PER_TASK).cast("int").alias("parts"))
    posted = posted.join(F.broadcast(layout), "pivot").withColumn("part", F.pmod("h2", "parts").cast("int")).drop("parts")
    asked = asked.join(F.broadcast(layout), "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    most = k + 1

    def search(files: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(files) and len(asking):
            v, places = _matrix(files["v"], np.float64), _matrix(files["places"], np.uint8).astype(np.int16)
            ids = files["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            by_id = np.argsort(least, kind="stable")
            v, places, ids = v[by_id], places[by_id], [ids[i] for i in by_id]
            n = min(len(v), max(rerank_least, math.ceil(rerank_share * len(v))))
            at = zip(asking["h1"].to_pylist(), asking["h2"].to_pylist(), _matrix(asking["v"], np.float64), _matrix(asking["places"], np.uint8).astype(np.int16), strict=True)
            for h1, h2, q, own in at:
                if n < len(v):
                    off = np.abs(places - own)
                    chosen = np.zeros(len(v), bool)
                    for part in (off[:, :apart], off[:, apart:]):
                        # Equal distances go by id, which is the order of the rows.
                        footrule = part.sum(1, dtype=np.int64) * len(v) + np.arange(len(v))
                        chosen[np.argpartition(footrule, n - 1)[:n]] = True
                    near = np.flatnonzero(chosen)
                else:
                    near = np.arange(len(v))
                # Row by row, so that equal vectors have equal scores.
                score = (v[near] * q).sum(1)
                cut = np.partition(score, len(score) - most)[len(score) - most] if len(score) > most else -np.inf
                best = [(-score[i], x) for i in np.flatnonzero(score >= cut) for x in ids[near[i]]]
                out += [(h1, h2, -s, x) for s, x in sorted(best)[:most]]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["h1", "h2", "score", "found"])

    found = posted.groupBy("pivot", "part").cogroup(asked.groupBy("pivot", "part")).applyInArrow(search, "h1 long, h2 long, score double, found long")
    by_score = [F.desc("score"), F.asc("found")]
    best = found.dropDuplicates(["h1", "h2", "found"]).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*by_score)))
    best = best.where(F.col("n") <= most).drop("n")
    queries = rows.where("asks").select("h1", "h2", F.col("id").alias("query_id")).distinct()
    out = queries.join(best, ["h1", "h2"]).where("found != query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("found").alias("vec_id"), "score")


def op4_neighbours(spark, sf_dir):
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
