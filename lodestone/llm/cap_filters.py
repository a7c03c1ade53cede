"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector falls into it when their cosine exceeds ``alpha``. Directions are
product codes: after a fast random rotation a vector is cut into two halves, each with a codebook
of its own, and every pair of codewords is a direction. So the ``width`` ** 2 filters of a code are
list-decoded from 2 * width products: a codeword of the first half is followed only if the best of
the second half can bring it over ``alpha``. Several codes, each with its own rotation, make sure
that two similar vectors share a filter; how many follows from a trial on random pairs that are just similar.

Vectors that share a filter (and the label) are compared, in blocks, by exact cosines. Filters with
the same vectors are one; a pair that shares several counts in the first one alone.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import join_keys, packed, table, unpacked
from lodestone.operators.bucket_links import edges, links
from lodestone.operators.components import components
from lodestone.shared import drop_saved, save

#: Filters of a code that a random vector falls into, about: few, as then those of similar vectors agree most.
PER_CODE = 0.8
#: Pairs in the trial that sets ``alpha`` and the number of codes.
TRIAL = 2000
#: Vectors that are decoded at once.
AT_ONCE = 512


def rotated(v: np.ndarray, code: int) -> np.ndarray:
    """``v`` (its width a power of two) under the rotation of ``code``: thrice random signs and a Hadamard transform."""
    signs = np.random.default_rng((11, code)).choice([-1.0, 1.0], (3, v.shape[1])) / math.sqrt(v.shape[1])
    for s in signs:
        v, half = v * s, 1
        while half < v.shape[1]:
            x = v.reshape(len(v), -1, 2, half)
            v = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(v.shape)
            half *= 2
    return v


@functools.lru_cache(4)
def codebooks(dim: int, width: int) -> np.ndarray:
    """Two books of ``width`` codewords for halves of a vector; a pair of them is a direction of length one."""
    words = np.random.default_rng((12, dim, width)).standard_normal((2, width, dim // 2))
    return words / np.linalg.norm(words, axis=2, keepdims=True) / math.sqrt(2)


def halves(v: np.ndarray, code: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The products of both halves of ``v`` with their codewords."""
    books, x = codebooks(v.shape[1], width), rotated(v, code)
    return x[:, : v.shape[1] // 2] @ books[0].T, x[:, v.shape[1] // 2 :] @ books[1].T


def decoded(v: np.ndarray, code: int, width: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """All filters of ``code`` that rows of ``v`` fall into: (row, filter)."""
    a, b = halves(v, code, width)
    row, first = np.nonzero(a + b.max(1, keepdims=True) >= alpha)
    at, second = np.nonzero(a[row, first][:, None] + b[row] >= alpha)
    return row[at], first[at] * width + second


@functools.lru_cache(16)
def tuned(dim: int, width: int, cosine: float, recall: float) -> tuple[float, int]:
    """``alpha``, and the number of codes by which pairs of just ``cosine`` share a filter with probability ``recall``."""
    r = np.random.default_rng(13)
    n = max(200, TRIAL * 64 // max(64, width))
    x, y = r.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * y
    a, b = halves(x, 0, width)
    b.sort(1)
    low, high = 0.0, 1.0
    for _ in range(30):
        alpha = (low + high) / 2
        inside = sum(int((width - np.searchsorted(t, alpha - s)).sum()) for s, t in zip(a, b, strict=True))
        low, high = (alpha, high) if inside > PER_CODE * n else (low, alpha)
    # Several codes, so that the trial doesn't hang on one draw.
    hits = 0
    for code in range(4):
        (i, f), (j, g) = decoded(x, code, width, low), decoded(y, code, width, low)
        hits += len(np.unique(np.intersect1d(i * width**2 + f, j * width**2 + g) // width**2))
    missed = 1 - max(hits, 1) / (4 * n)
    return low, max(1, math.ceil(math.log(1 - recall) / math.log(missed))) if missed > 0 else 1


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length at length one, with zeros up to a power of two, 64 at least."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)
    v /= np.sqrt((v**2).sum(1, keepdims=True))
    return np.pad(v, ((0, 0), (0, max(64, 1 << (dim - 1).bit_length()) - dim)))


def _posts(nodes: DataFrame, width: int, cosine: float, recall: float) -> DataFrame:
    """A row for each vector and filter that it falls into: label, dim, bucket, id, h."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("label", "id")}

    def run(batches):
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for dim in np.unique(size).tolist():
                own = batch.take(pa.array(np.flatnonzero(size == dim)))
                for first in range(0, len(own), AT_ONCE):
                    part = own.slice(first, AT_ONCE)
                    v = _units(part.column("v"), dim)
                    alpha, codes = tuned(v.shape[1], width, cosine, recall)
                    for code in range(codes):
                        row, found = decoded(v, code, width, alpha)
                        take = pa.array(row)
                        columns = [part.column(c).take(take) for c in ("label", "dim", "id", "h")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(found + code * width**2)], names=["label", "dim", "id", "h", "bucket"])

    return nodes.select("label", "dim", "id", "h", "v").mapInArrow(run, f"label {kinds['label']}, dim int, id {kinds['id']}, h long, bucket long")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    recall: float = 0.9999,
) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Two vectors of one label link when their cosine, in double precision, is ``cosine`` or more; a
    pair that is just similar is found with probability ``recall``, a closer one more surely, and
    none below is linked. ``n_links`` is the number of other ids that a vector links with,
    ``component_id`` the smallest id that links reach, and ``kept`` whether it is the row's own.

    Rows whose id or label is null, and vectors that are null, empty, zero, hold a null or a component that
    isn't finite, link with nothing: each is its own component and kept. Vectors of different length
    don't link. Rows that repeat an id with its label and vector are one vector; an id on different
    vectors stands for each of them. Equal vectors are compared once, however many they are. An
    empty table gives an empty result; columns of the input with the three names are replaced.
    """
    rows = packed(vectors, id_col, vector_col, label_col, vector_col).drop("fp").withColumnsRenamed({"c0": "label", "c1": "v"})
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite, F.lit(False))
    # + 0 makes a negative zero equal to zero; what takes no part has no hash.
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x.cast("double") + F.lit(0.0))))
    rows = rows.withColumns({f"h{k}": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "label", "v")) for k in (1, 2)})

    part = rows.where("v IS NOT NULL")
    nodes = part.groupBy("h1", "h2").agg(F.count_distinct("id").alias("weight"), F.min("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = save(nodes.withColumns({"dim": F.size("v"), "h": F.col("h1")}), "cap-nodes")
    # A filter should hold few vectors that are not alike: as many filters as the largest label has vectors, and more.
    most = nodes.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    width = min(4096, max(64, 1 << math.ceil(math.log2(4 * most) / 2)))

    posts = save(_posts(nodes, width, cosine, recall), "cap-posts")
    found = links(nodes, posts, cosine)

    counts = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    roots = save(components(edges(found)), "cap-roots").select(F.col("node.id").alias("id"), F.col("node.h").alias("h"), F.col("root.id").alias("least"))
    known = nodes.select("h1", "h2", "id", "h", "weight").join(counts, ["id", "h"], "left").join(roots, ["id", "h"], "left")
    known = known.where("weight > 1 OR links IS NOT NULL").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "id").alias("least"))
    known = save(known, "cap-known")
    for saved in (posts, found):
        drop_saved(saved)
    # All rows without a hash, or of one vector, may be any share of all.
    out = join_keys(rows.drop("v", "label"), known, ["h1", "h2"], ["id"], "left")
    component = F.coalesce("least", "id")
    return unpacked(out, vectors.columns, n_links=F.coalesce("n", F.lit(0)).cast("long"), component_id=component, kept=component.eqNullSafe(F.col("id")))


def op11_cap_filters(spark, sf_dir):
    """All vectors against those of their label."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.98
), r(x, y) AS (
  SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) ON a = vec_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) ON x = vec_id
"""
