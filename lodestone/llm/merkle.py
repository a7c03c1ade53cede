"""A Merkle manifest of a dataset: one digest for all rows, and for each row the proof that leads there.

Each source's rows are the leaves of a tree. Levels are DataFrames: a row's index comes from a sort
dealt out by ranges, ``fanout`` neighbours are grouped by index // fanout, and the digests of the
sorted children are hashed into the parent. The trees' roots are the leaves of one more tree. Then
the levels are joined from the root down, each appending its children's siblings to what is above.

Digests are lower-case hex of SHA-256; inputs are concatenated, digests as hex text. Every level has
a ``fanout``-th of the rows of the one below, so all levels together shuffle little more than the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import join_keys, save, table

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; null as ``-``. No two lists of values have one encoding."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row of ``values``."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def indexed(rows: DataFrame, by: list[str], order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``idx``, from 0 in each group of ``by`` by ``order`` (nulls first); and the groups with ``n``, their number of rows.

    A group may hold any share of all rows, so no window orders it. Rows are dealt by ranges of
    (by, order) and written; a row's number in its partition less that of the group's first row
    there, plus the group's rows in the partitions before, is its index. The windows see one row for
    each partition and group in it. Rows that are equal in all of ``order`` are told apart by their
    place in the input.
    """
    keys = [*by, *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The upper bits of the number are the partition's.
    dealt = save(dealt.drop("tie").withColumn("no", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("no", 33)), label)
    blocks = dealt.groupBy("pid", *by).agg(F.count("*").alias("c"), F.min("no").alias("first"))
    whole = Window.partitionBy(*by)
    before = F.sum("c").over(whole.orderBy("pid")) - F.col("c")
    blocks = save(blocks.select("pid", *by, "c", (before - F.col("first")).alias("shift")), f"{label}-blocks")
    out = join_keys(dealt, blocks.drop("c"), ["pid", *by], ["no"])
    groups = blocks.groupBy(*by).agg(F.sum("c").alias("n"))
    return out.withColumn("idx", F.col("no") + F.col("shift")).drop("no", "pid", "shift"), groups


def levels(leaves: DataFrame, most: int, fanout: int, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, idx, n, h): saved rows of tree, idx, n, h and children, a sorted array of pos and h.

    ``n`` is the number of nodes of the tree at that level; ``most`` is the largest one among
    ``leaves``. A tree of one node at some level is not carried further. Children on the first level
    bring the columns ``carry`` of the leaves with them.
    """
    out, below = [], leaves
    while most > 1:
        child = F.struct((F.col("idx") % fanout).cast("int").alias("pos"), "h", *(() if out else carry))
        runs = below.where("n > 1").groupBy("tree", F.floor(F.col("idx") / F.lit(fanout)).cast("long").alias("up"))
        grouped = runs.agg(F.ceil(F.first("n") / F.lit(fanout)).cast("long").alias("n"), F.sort_array(F.collect_list(child)).alias("children"))
        below = grouped.select("tree", F.col("up").alias("idx"), "n", "children", F.sha2(_digests(F.col("children")), 256).alias("h"))
        below = save(below, "merkle-level")
        out.append(below)
        most = -(-most // fanout)
    return out


def _digests(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["h"]), "")


def paths(upward: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The children on the lowest of ``upward``, with what stands beside each of them and of its ancestors: tree, idx, own, path.

    ``above``: tree and path of the trees' roots. A path is an array of (left, right): the digests
    before and after a node in its run, from its own level up. From the top, each level joins what
    the one above has found and appends its children's siblings.
    """
    found = None
    for nodes in reversed(upward):
        inner = nodes.where("n = 1").join(above, "tree")
        if found is not None:
            inner = inner.unionByName(nodes.where("n > 1").join(found.drop("own"), ["tree", "idx"]))
        each = inner.select("tree", "idx", "children", "path", F.explode("children").alias("own"))
        own = F.col("own.pos")
        step = F.struct(*[_digests(F.filter("children", test)).alias(side) for side, test in (("left", lambda c: c["pos"] < own), ("right", lambda c: c["pos"] > own))])
        found = each.select("tree", (F.col("idx") * fanout + own).alias("idx"), "own", F.concat(F.array(step), "path").alias("path"))
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings on its path."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def manifest(docs: DataFrame, fields: list[str] | None = None, by: str = "source", order: str = "doc_id", fanout: int = FANOUT, **carry: Column) -> DataFrame:
    """A row for each row of ``docs``: ``order``, ``by``, leaf, subroot, root, path, and the columns of ``carry``.

    The leaf is the digest of ``fields``. The rows of each value of ``by`` are a tree, ascending by
    ``order``; its root is the row's subroot. The subroots, ascending by ``by`` in bytewise order,
    are the leaves of the tree whose root all rows share. A run that ends short, even with one
    child, is hashed like the others; a tree of one leaf is that leaf. ``path`` has the siblings up
    to the root as (left, right); :func:`folded` goes the same way.

    Nulls come first in both orders, and are values like others: null ids, sources and texts have
    leaves, and the rows without a source are a tree. Rows that tie in ``order`` go by their digest;
    equal rows have places of their own, and so different paths. An empty table gives no rows.
    Further columns play no part unless ``fields`` names them.
    """
    name = lambda c: F.col(f"`{c}`")
    extra = {f"c{i}": v for i, v in enumerate(carry.values())}
    rows = docs.select(name(by).alias("g"), name(order).alias("o"), leaf([name(c) for c in fields or FIELDS]).alias("h"), *[v.alias(k) for k, v in extra.items()])
    rows, groups = indexed(rows, ["g"], ["o", "h"], "merkle-leaves")
    trees, _ = indexed(groups, [], ["g"], "merkle-trees")
    trees = save(trees.select("g", F.col("idx").alias("tree"), "n"), "merkle-sources")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    leaves = join_keys(rows, trees, ["g"], ["idx"])
    payload = ("o", *extra)
    upward = levels(leaves, most, fanout, payload)
    alone = leaves.where("n = 1")
    # A tree's root is the last that is left of it.
    subroots = [x.where("n = 1").select("tree", "h") for x in (alone, *upward)]
    tops = subroots[0]
    for x in subroots[1:]:
        tops = tops.unionByName(x)
    tops = save(tops, "merkle-subroots")
    forest = levels(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "h"), n_trees, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    if forest:
        root = forest[-1].select(F.col("h").alias("root"))
        up = paths(forest, forest[-1].select("tree", none.alias("path")), fanout).select(F.col("idx").alias("tree"), "path")
        above = tops.join(up, "tree")
    else:
        root = tops.select(F.col("h").alias("root"))
        above = tops.withColumn("path", none)
    above = above.join(trees.select("tree", "g"), "tree").crossJoin(F.broadcast(root))
    above = save(above.select("tree", "path", F.col("h").alias("subroot"), "root", "g"), "merkle-above")

    lone = alone.select("tree", F.col("h").alias("leaf"), *payload).join(above.select("tree", "path"), "tree")
    out = lone
    if upward:
        out = lone.unionByName(paths(upward, above.select("tree", "path"), fanout).select("tree", F.col("own.h").alias("leaf"), *[F.col(f"own.{c}").alias(c) for c in payload], "path"))
    # What rows of one tree share comes last; a tree may be any share of all rows.
    out = join_keys(out, above.drop("path"), ["tree"], ["leaf"])
    return out.select(F.col("o").alias(order), F.col("g").alias(by), "leaf", "subroot", "root", "path", *[F.col(k).alias(v) for k, v in zip(extra, carry, strict=True)])


def op12_merkle(spark, sf_dir):
    """All documents; where 2 divides the crc32 of the id, the proof is tried with a text that lost its line ends."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    out = manifest(docs, shown=F.when(hit, changed))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 bit by bit, then both kinds of trees level by level, then each leaf up its path.
OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END AS e1, coalesce(strlen(source) || ':' || source, '-') AS e2,
    coalesce(strlen(lang) || ':' || lang, '-') AS e3, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS e4, replace(text, chr(10), '') AS cut,
    coalesce(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i: i::UBIGINT)),
      lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::UBIGINT ELSE 0::UBIGINT END) >> 1,
        CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::UBIGINT ELSE 0::UBIGINT END) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) & 1 = 1, false) AS hit
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM (
    SELECT doc_id, source, sha256(e1 || e2 || e3 || e4 || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      CASE WHEN hit THEN sha256(e1 || e2 || e3 || e4 || coalesce(strlen(cut) || ':' || cut, '-')) END AS shown FROM d)
), t AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l GROUP BY source
), v AS (
  SELECT tree, 0 AS lev, idx, n, leaf AS h FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT tree, any_value(lev) + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM v WHERE n > 1 GROUP BY tree, idx // 3
), s AS (
  SELECT tree, h FROM v WHERE n = 1
), f AS (
  SELECT 0 AS lev, tree AS idx, (SELECT count(*) FROM s) AS n, h FROM s
  UNION ALL
  SELECT any_value(lev) + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM f WHERE n > 1 GROUP BY idx // 3
), runs AS (
  SELECT tree, lev, idx // 3 AS up, list(h ORDER BY idx) AS hs FROM v WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, lev, idx // 3, list(h ORDER BY idx) FROM f WHERE n > 1 GROUP BY ALL
), climb(doc_id, leaf, own, tree, lev, idx, acc, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0, idx, coalesce(shown, leaf), '' FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  UNION ALL
  (WITH c AS (
    SELECT c.*, hs FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.lev = c.lev AND r.up = c.idx // 3
  ) SELECT doc_id, leaf, own, CASE WHEN hs IS NULL THEN -1 ELSE tree END, CASE WHEN hs IS NULL THEN 0 ELSE lev + 1 END, CASE WHEN hs IS NULL THEN own ELSE idx // 3 END,
      CASE WHEN hs IS NULL THEN acc ELSE sha256(array_to_string(list_concat(hs[: (idx % 3)::INT], [acc], hs[(idx % 3 + 2)::INT :]), '')) END,
      CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(list_concat(hs[: (idx % 3)::INT], hs[(idx % 3 + 2)::INT :]), '') END
    FROM c WHERE tree >= 0 OR hs IS NOT NULL)
), ends AS (
  SELECT * FROM climb WHERE tree = -1 QUALIFY lev = max(lev) OVER ()
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified
FROM ends JOIN s ON s.tree = own, (SELECT h FROM f WHERE n = 1) r
"""
