"""Hard negatives by blocked dense products.

Anchors go to the tasks in blocks of a bounded size; each task multiplies them with the blocks of
candidates that it reads, in float64, which is exact as long as no product of two vectors' lengths
reaches 2 ** 53. A first pass keeps the best positives of each anchor in each task and merges them
by a window; a second pass does so for the negatives whose scores lie in a window below each
positive. What a task hands on is bounded by the block and not by what it read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import drop_saved, save, table

#: Anchors, about, and bytes of their vectors, that come to the driver and go to all tasks at once.
ANCHORS_AT_ONCE = 8192
ANCHOR_BYTES = 1 << 26
#: Anchors and candidates whose products are in memory at once.
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 4096


class Best:
    """The ``k`` best (score, id) of each slot: higher scores first, ties to smaller ids, each pair once."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), -np.inf)
        self.id = np.full((slots, k), np.iinfo(np.int64).max)

    def least(self, slots: slice | np.ndarray) -> np.ndarray:
        """The score that a slot's next entry must reach."""
        return self.score[slots, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k = self.score.shape[1]
        touched = np.unique(slot)
        slot = np.concatenate([slot, touched.repeat(k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < k
        self.score[touched], self.id[touched] = -np.inf, np.iinfo(np.int64).max
        self.score[slot[kept], place[kept]] = score[kept]
        self.id[slot[kept], place[kept]] = ids[kept]

    def rows(self) -> pa.RecordBatch:
        slot, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(self.score[slot, place].astype(np.int64)), pa.array(self.id[slot, place])], names=["slot", "score", "found"])


ENTRY = "slot long, score long, found long"


class Block:
    """A block of anchors: ids, labels, and for each length of vectors the anchors' numbers with their vectors."""

    def __init__(self, anchors: pa.Table, scale: float):
        self.id = anchors["id"].to_numpy()
        self.labels = pc.unique(anchors["label"].combine_chunks())
        self.code = pc.index_in(anchors["label"], self.labels).to_numpy()
        self.vectors = {n: (at, m) for n, at, m in by_length(anchors["v"].combine_chunks(), scale)}


def by_length(vectors: pa.ListArray, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of each length: the length, their rows, and the floors of their components times ``scale``."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(size)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield n, at, np.floor(flat[(ends[at] - n)[:, None] + np.arange(n)] * scale)


def products(batches: Iterator[pa.RecordBatch], block: Block, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of anchors (rows) and candidates (columns), with the anchors' numbers, the candidates' ids, and whether labels are equal."""
    for batch in batches:
        for first in range(0, len(batch), CANDIDATE_ROWS):
            part = batch.slice(first, CANDIDATE_ROWS)
            ids, code = part.column("id").to_numpy(), pc.index_in(part.column("label"), block.labels).fill_null(-1).to_numpy(zero_copy_only=False)
            for n, at, found in by_length(part.column("v"), scale):
                numbers, anchors = block.vectors.get(n, (np.empty(0, np.int64), None))
                for i in range(0, len(numbers), ANCHOR_ROWS):
                    who, own = numbers[i : i + ANCHOR_ROWS], anchors[i : i + ANCHOR_ROWS]
                    if math.sqrt((own**2).sum(1).max() * (found**2).sum(1).max()) >= 2.0**53:
                        raise ValueError("scores of 2 ** 53 or more aren't exact in float64: take a smaller scale")
                    yield own @ found.T, who, ids[at], block.code[who][:, None] == code[at][None, :]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each slot over all tasks, with their rank."""
    best = Window.partitionBy("slot").orderBy(F.desc("score"), "found")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, held, scale: float, k: int) -> DataFrame:
    def run(batches):
        block = held.value[0]
        best = Best(len(block.id), k)
        for score, who, ids, same in products(batches, block, scale):
            a, c = np.nonzero(same & (score >= best.least(who)[:, None]) & (block.id[who][:, None] != ids[None, :]))
            best.add(who[a], score[a, c], ids[c])
        yield best.rows()

    return _merged(rows.mapInArrow(run, ENTRY), k)


def _negatives(rows: DataFrame, held, scale: float, k: int, percent: int) -> DataFrame:
    """Slots are the anchors' positives, as ``held`` has them: anchor number, score."""

    def run(batches):
        block, anchor, top = held.value
        best = Best(len(anchor), k)
        # An anchor's slots stand together, best positive first.
        first, last = np.searchsorted(anchor, np.arange(len(block.id))), np.searchsorted(anchor, np.arange(len(block.id)), "right")
        n = last - first
        high, low = np.full(len(n), -np.inf), np.full(len(n), np.inf)
        high[n > 0], low[n > 0] = top[first[n > 0]], top[last[n > 0] - 1]
        for score, who, ids, same in products(batches, block, scale):
            a, c = np.nonzero(~same & (score <= high[who][:, None]) & (100.0 * score >= percent * low[who][:, None] - 100.0))
            s, own = score[a, c].astype(np.int64), who[a]
            for j in range(int(n.max(initial=0))):
                has = j < n[own]
                slot = np.where(has, first[own] + j, 0)
                fits = has & (s <= top[slot]) & (100 * s >= percent * top[slot]) & (s >= best.least(slot))
                best.add(slot[fits], s[fits].astype(np.float64), ids[c[fits]])
        yield best.rows()

    return _merged(rows.mapInArrow(run, ENTRY), k)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives: anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    A score is the inner product of the vectors' integers floor(scale * x). An anchor's positives
    are its best ``positives`` other rows of the same label, all if fewer; the negatives of a
    positive are the best ``negatives`` rows of other labels with ``percent`` * positive score <=
    100 * score <= 100 * positive score, all if fewer. Higher scores come first, ties to smaller ids.

    Rows whose id, label or vector is null, and vectors with a null or a component that isn't
    finite, take no part. Vectors score with those of their own length alone; empty ones score 0. Rows
    that repeat an id with its label and vector are one row; "other" rows have another id. An anchor
    without positives, or a positive without negatives, has no rows; an empty table gives none.
    Scores that could reach 2 ** 53 raise a ValueError. Other columns play no part.
    """
    spark = vectors.sparkSession
    name = lambda c: F.col(f"`{c}`")
    rows = vectors.select(name(id_col).cast("long").alias("id"), name(label_col).alias("label"), name(vector_col).cast("array<double>").alias("v"), is_anchor.alias("asks"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(usable)
    anchors = save(rows.where("asks").select("id", "label", "v").distinct(), "anchors")
    n, parts = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(math.ceil(n / ANCHORS_AT_ONCE), math.ceil(8 * parts / ANCHOR_BYTES))
    candidates = rows.select("id", "label", "v")
    out = []
    for b in range(blocks):
        # Bounded by ANCHORS_AT_ONCE and ANCHOR_BYTES, about: the block, and its positives' scores.
        own = anchors.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).toArrow().sort_by("id")
        if not len(own):
            continue
        block = Block(own, scale)
        held = spark.sparkContext.broadcast((block,))
        top = save(_positives(candidates, held, scale, positives), "positives")
        held.unpersist()
        chosen = top.select("slot", "rank", "score", "found").toArrow().sort_by([("slot", "ascending"), ("rank", "ascending")])
        drop_saved(top)
        anchor = chosen["slot"].to_numpy()
        held = spark.sparkContext.broadcast((block, anchor, chosen["score"].to_numpy()))
        pairs = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(len(anchor))), "anchor_id": pa.array(block.id[anchor]), "positive_id": chosen["found"], "positive_score": chosen["score"]}))
        found = _negatives(candidates, held, scale, negatives, percent).join(F.broadcast(pairs), "slot")
        out.append(save(found.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        held.unpersist()
    drop_saved(anchors)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)


def op13_hard_negatives(spark, sf_dir):
    """Every hundredth row is an anchor; where 7 divides the id, the label is moved on."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON len(a.v) = len(b.v) WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
