"""Approximate nearest neighbours over navigable small-world graphs, and exact ones for sets of questions.

The index deals vectors into shards; each shard is one graph, built and packed by one task. A vector
is linked with near vectors among those that came before it, chosen apart from each other, and back;
early vectors are few and far apart, so their links are long, and a search that starts there
comes near in few steps. Questions go to the tasks in blocks of a bounded size; each shard is
searched with a beam for a whole block at once, and the shards' results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import drop_saved, save

#: Links of a vector, candidates for them, and the beam of a search. Fixed values.
LINKS, BREADTH, BEAM = 16, 200, 100
#: Vectors of a shard, about.
SHARD_ROWS = 8192
#: Questions, about, that go to all tasks at once, and of those the ones that a search steps through together.
QUESTIONS_AT_ONCE, TOGETHER = 4096, 256
#: Vectors that are compared with others at once.
ROWS_AT_ONCE = 512
#: Vectors where searches start.
ENTRIES = 16


def _near(u: np.ndarray, lo: int, hi: int, breadth: int) -> np.ndarray:
    """For each of the rows ``lo`` to ``hi`` its nearest among the first ``hi``, itself left out, nearest first."""
    n = min(breadth, hi - 1)
    out = np.empty((hi - lo, n), np.int64)
    for at in range(lo, hi, ROWS_AT_ONCE):
        end = min(hi, at + ROWS_AT_ONCE)
        s = u[at:end] @ u[:hi].T
        s[np.arange(end - at), np.arange(at, end)] = -np.inf
        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable")
        out[at - lo : end - lo] = np.take_along_axis(best, order, 1)
    return out


def _apart(u: np.ndarray, own: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates those that are nearer to it than to any one taken before, up to ``links``; -1 behind them."""
    out = np.full((len(own), links), -1, np.int64)
    for at in range(0, len(own), ROWS_AT_ONCE):
        x, cand = u[own[at : at + ROWS_AT_ONCE]], near[at : at + ROWS_AT_ONCE]
        taken, n, row = np.full((len(x), links), -1, np.int64), np.zeros(len(x), np.int64), np.arange(len(x))
        for j in range(cand.shape[1]):
            # Rows with all their links are over; most are long before the last candidate.
            row = row[n[row] < links]
            if not len(row):
                break
            c, most = u[cand[row, j]], max(1, n[row].max())
            held = taken[row, :most]
            between = np.where(held >= 0, np.einsum("rd,rkd->rk", c, u[held]), -np.inf).max(1)
            good = row[(c * x[row]).sum(1) > between]
            taken[good, n[good]] = cand[good, j]
            n[good] += 1
        out[at : at + ROWS_AT_ONCE] = taken
    return out


def graph(u: np.ndarray, links: int = LINKS, breadth: int = BREADTH) -> np.ndarray:
    """The links of vectors of length one, 3 * ``links`` at most each, -1 behind them. Batches double, each linked among all that came so far."""
    n = len(u)
    own = np.full((n, links), -1, np.int64)
    hi = min(n, 2 * links + 1)
    lo = 0
    while lo < hi and hi > 1:
        near = _near(u, lo, hi, breadth)
        own[lo:hi] = _apart(u, np.arange(lo, hi), near, links)
        lo, hi = hi, min(n, 2 * hi)
    # Links back: the nearest of those that point at a vector.
    source, target = np.repeat(np.arange(n), links), own.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-(u[source] * u[target]).sum(1), target)) if len(source) else np.empty(0, np.int64)
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, 2 * links), -1, np.int64)
    kept = place < 2 * links
    back[target[kept], place[kept]] = source[kept]
    repeated = (back[:, :, None] == own[:, None, :]).any(2)
    return np.concatenate([own, np.where(repeated, -1, back)], 1).astype(np.int32)


def search(u: np.ndarray, neighbours: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest that a beam finds for each of ``q``: rows of ``u`` (-1 behind them) and their products."""
    n, m = len(u), len(q)
    start = np.arange(min(ENTRIES, n))
    ids, score = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf)
    width = min(beam, len(start))
    ids[:, :width], score[:, :width] = start[:width], q @ u[start[:width]].T
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    done = ids < 0
    row = np.arange(m)
    while len(row):
        open_score = np.where(done[row], -np.inf, score[row])
        pick = open_score.argmax(1)
        row, pick = row[np.isfinite(open_score.max(1))], pick[np.isfinite(open_score.max(1))]
        if not len(row):
            break
        done[row, pick] = True
        found = neighbours[ids[row, pick]]
        new = (found >= 0) & ~seen[row[:, None], found]
        seen[row[:, None], np.where(new, found, ids[row, pick][:, None])] = True
        s = np.where(new, np.einsum("rd,rkd->rk", q[row], u[found]), -np.inf)
        all_ids, all_score = np.concatenate([ids[row], found], 1), np.concatenate([score[row], s], 1)
        all_done = np.concatenate([done[row], ~new], 1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[row], score[row], done[row] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_score, all_done))
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    return np.where(np.isfinite(score), ids, -1), score


def _units(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def _usable(vectors: DataFrame, *more: str) -> DataFrame:
    """Rows with an id and a vector of finite components, not all zero."""
    v = F.col("vector").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("id", v.alias("v"), *more).where(F.col("id").isNotNull() & (F.size("v") > 0) & fine)


def build(vectors: DataFrame, links: int = LINKS, breadth: int = BREADTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of ``vectors`` (id, vector): a saved row for each shard with its number, dim, ids, units and links packed.

    Vectors of each length have shards of their own; null ids and vectors that are null, empty, zero or
    not finite are left out. Rows that repeat an id with its vector are one. Each shard has a task and a file of its
    own, as its graph takes long and is few bytes, of which Spark would put many in one task.
    """
    usable = save(_usable(vectors).withColumn("id", F.col("id").cast("long")).distinct().withColumn("dim", F.size("v")), "graph-vectors")
    n = usable.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    # As many rows as there are lengths.
    n = save(n.withColumn("before", F.sum("shards").over(Window.orderBy("dim")) - F.col("shards")), "graph-shards")
    total = n.agg(F.sum("shards")).first()[0] or 1
    rows = usable.join(n, "dim").withColumn("shard", (F.col("before") + F.pmod(F.xxhash64("id", "v"), "shards")).cast("int"))

    def pack(found: pa.Table) -> pa.Table:
        # The order of arrival is a hash of the id, so early vectors are spread over all.
        found = found.sort_by([("arrival", "ascending"), ("id", "ascending")])
        dim = found["dim"][0].as_py()
        u = _units(found["v"], dim)
        made = graph(u, links, breadth)
        return pa.table({"shard": pa.array([found["shard"][0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([found["id"].to_pylist()], pa.list_(pa.int64())), "units": pa.array([u.astype("<f8").tobytes()], pa.large_binary()).cast(pa.binary()), "links": pa.array([made.astype("<i4").tobytes()], pa.binary())})

    shards = rows.select("dim", "shard", "id", "v", F.xxhash64(F.lit(5), "id").alias("arrival")).repartitionById(total, "shard").groupBy("shard")
    made = save(shards.applyInArrow(pack, "shard int, dim int, ids array<long>, units binary, links binary"), "graph-index")
    for used in (usable, n):
        drop_saved(used)
    return made


def _for_blocks(questions: DataFrame, k: int, find: Callable[[dict], DataFrame]) -> DataFrame:
    """The merged results of ``find`` for blocks of ``questions`` (id, vector): query_id, id, similarity, rank."""
    spark = questions.sparkSession
    asked = save(_usable(questions).withColumn("id", F.col("id").cast("long")).distinct(), "questions")
    blocks = math.ceil(asked.count() / QUESTIONS_AT_ONCE)
    out = None
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    for b in range(blocks):
        # Bounded by QUESTIONS_AT_ONCE, about.
        own = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).toArrow().sort_by("id")
        size = pa.compute.list_value_length(own["v"]).to_numpy()
        held = spark.sparkContext.broadcast({int(d): (own["id"].to_numpy()[size == d], _units(own["v"].filter(pa.array(size == d)), int(d))) for d in np.unique(size)})
        found = find(held).dropDuplicates(["query_id", "id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found if blocks == 1 else save(found, "nearest")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, similarity double, rank int")


RESULT = "query_id long, id long, similarity double"


def _rows(names: list[np.ndarray], ids: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((names, np.int64), (ids, np.int64), (scores, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], names=["query_id", "id", "similarity"])


def nearest(index: DataFrame, questions: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, id, similarity (cosine, six places), rank of about the ``k`` nearest to each of ``questions`` (id, vector), in an index of :func:`build`.

    Ties go by id. A question meets the vectors of its own length. More shards or a wider beam find more. Where shards are
    few, several tasks search each, in turns of TOGETHER questions.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    turns = min(QUESTIONS_AT_ONCE // TOGETHER, math.ceil(2 * index.sparkSession.sparkContext.defaultParallelism / shards))
    turns = max(1, min(turns, math.ceil(questions.count() / TOGETHER)))
    dealt = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    dealt = dealt.repartitionById(shards * turns, (F.col("shard") * turns + F.col("turn")).cast("int"))

    def find(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    dim, ids = batch.column("dim")[i].as_py(), batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                    u = np.frombuffer(batch.column("units")[i].as_buffer(), "<f8").reshape(-1, dim)
                    made = np.frombuffer(batch.column("links")[i].as_buffer(), "<i4").reshape(len(u), -1)
                    names, q = held.value.get(dim, (np.empty(0, np.int64), np.empty((0, dim))))
                    for at in range(batch.column("turn")[i].as_py() * TOGETHER, len(q), turns * TOGETHER):
                        found, score = search(u, made, q[at : at + TOGETHER], k, max(beam, k))
                        who, place = np.nonzero(found >= 0)
                        yield _rows([names[at + who]], [ids[found[who, place]]], [np.round(score[who, place], 6)])

        return dealt.mapInArrow(run, RESULT)

    return _for_blocks(questions, k, find)


def _merge(best: tuple[np.ndarray, np.ndarray], q: np.ndarray, u: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best scores (six places) and ids of each of ``q`` among those it had and the rows of ``u``, ties by id; the lowest score and -1 behind them."""
    product = q @ u.T
    floor = best[0][:, -1]
    if len(ids) > k:
        # Of many rows only those that reach the k-th of them can count. Products below a millionth can't round up to it.
        first = np.isneginf(floor)
        if first.any():
            floor = floor.copy()
            floor[first] = np.partition(product[first], len(ids) - k, axis=1)[:, len(ids) - k]
    row, at = np.nonzero(product >= floor[:, None] - 1e-6)
    if not len(row):
        return best
    changed, place = np.unique(row, return_inverse=True)
    score = np.r_[best[0][changed].ravel(), np.round(product[row, at], 6)]
    found = np.r_[best[1][changed].ravel(), ids[at]]
    place = np.r_[np.arange(len(changed)).repeat(k), place]
    order = np.lexsort((found, -score, place))
    place = place[order]
    rank = np.arange(len(place)) - np.searchsorted(place, np.arange(len(changed)))[place]
    kept = order[rank < k]
    best[0][changed], best[1][changed] = score[kept].reshape(-1, k), found[kept].reshape(-1, k)
    return best


def nearest_exactly(vectors: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """As :func:`nearest` gives it, by comparing each question with every one of ``vectors`` (id, vector), in blocks.

    A task hands on the ``k`` best of each question, whatever it read. Blocks of ROWS_AT_ONCE questions meet four times
    as many rows, and only products that reach a question's ``k`` best so far are sorted.
    """
    rows = _usable(vectors).select(F.col("id").cast("long").alias("id"), "v")

    def find(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                size = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
                for dim in np.unique(size).tolist():
                    names, q = held.value.get(dim, (np.empty(0, np.int64), None))
                    own = batch.filter(pa.array(size == dim))
                    if len(names) and dim not in best:
                        best[dim] = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
                    for at in range(0, len(own) if len(names) else 0, 4 * ROWS_AT_ONCE):
                        part = own.slice(at, 4 * ROWS_AT_ONCE)
                        u, ids = _units(part.column("v"), dim), part.column("id").to_numpy()
                        for lo in range(0, len(q), ROWS_AT_ONCE):
                            block = slice(lo, lo + ROWS_AT_ONCE)
                            _merge((best[dim][0][block], best[dim][1][block]), q[block], u, ids, k)
            for dim, (score, found) in best.items():
                who, place = np.nonzero(~np.isneginf(score))
                yield _rows([held.value[dim][0][who]], [found[who, place]], [score[who, place]])

        return rows.mapInArrow(run, RESULT)

    return _for_blocks(questions, k, find)


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """For each question of ``exact``, both as :func:`nearest` gives them: query_id, hits, recall (three places)."""
    met = exact.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg(F.count("hit").alias("hits"), F.round(F.count("hit") / F.least(F.lit(k), F.count("*")), 3).alias("recall"))
