"""N-gram Jaccard join by vertical partitioning.

All documents' word n-grams have one global order: frequent ones last, and among the others
long ones first. Similar documents must share an n-gram in the first part of their sets in that
order, which gives candidate pairs. The order of n-grams is cut into fragments; the overlap of a
candidate pair is counted in each fragment by itself, and the counts are summed per pair. All
documents' n-grams tell where the order is cut; frequent ones are the last fragment.

Documents with the same set are one node. Where many nodes share an n-gram, one of them is its
hub. Every node is compared with one hub first, then with the hubs of its other n-grams that are
not in its component yet, and last nodes that are still apart with each other. So a large group of
near copies costs about one comparison for each member, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import drop_saved, packed, save, slices, table, text_bytes, unpacked
from lodestone.operators.components import components
from lodestone.llm.shingles import shingles

#: Documents that may share an n-gram at the front of the order before it goes to the end.
FREQUENT = 16
#: A front with such a share of frequent n-grams tells that the whole set may be frequent.
FULL_SHARE = 0.25
#: The order's end has so many n-grams at most, the most frequent ones; a bound of what is
#: broadcast (8 bytes each). It changes what is compared, never what is found.
MOST_FREQUENT = 1_000_000
#: Up to so many nodes are sent to all tasks to fetch texts (about 50 bytes each); beyond that texts are joined by shuffle.
BROADCAST_NODES = 200_000


def _least(n: int, percent: int) -> int:
    """The smallest overlap that a set of n can have with a similar one."""
    return -(-n * percent // 100)


def _front(found: np.ndarray, percent: int, hot: np.ndarray | None) -> np.ndarray:
    """The part of a set, in the global order, of which a similar set must have an n-gram."""
    n = len(found)
    size = n - _least(n, percent) + 1
    if n * (100 - percent) < percent:
        return found[:0]  # only an equal set is similar, and equal sets are one node
    if hot is not None and len(hot) and _in(hot, found[:size]).any():
        last = _in(hot, found)
        found = np.concatenate([found[~last], found[last]])
    return found[:size]


def _in(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of the set's members by hash, four bits a member at least; two bitmaps differ in no more bits than two sets in members."""
    bits = 128
    while bits < 4 * len(found):
        bits *= 2
    odd = np.bincount((found & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _frequent(docs: DataFrame, width: int, pick: Callable[[np.ndarray], np.ndarray | None], fragments: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that ``pick`` names in more than FREQUENT documents, sorted; and where the order of all n-grams is cut into equal fragments."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingles(batch.column("text").to_pylist(), width))
            picked = [p for s in sets if (p := pick(s)) is not None]
            grams, n = np.unique(np.concatenate(picked), return_counts=True) if picked else (np.empty(0, np.int64), np.empty(0, np.int64))
            # The order's upper 12 bits tell where its parts are.
            part, m = np.unique(np.concatenate(sets) >> 52, return_counts=True) if fragments > 1 and sets else (np.empty(0, np.int64), np.empty(0, np.int64))
            kind = np.repeat([True, False], [len(grams), len(part)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[grams, part]), pa.array(np.r_[n, m].astype(np.int64))], names=["gram", "g", "n"])

    counts = docs.mapInArrow(counted, "gram boolean, g long, n long").groupBy("gram", "g").agg(F.sum("n").alias("n"))
    counts = save(counts.where(~F.col("gram") | (F.col("n") > FREQUENT)), "frequent")
    hot = counts.where("gram").orderBy(F.desc("n"), "g").limit(MOST_FREQUENT).select("g").toArrow()
    parts = counts.where("NOT gram").orderBy("g").select("g", "n").toArrow()  # 4096 rows at most
    drop_saved(counts)
    size = np.cumsum(parts["n"].to_numpy())
    at = np.searchsorted(size, size[-1] * np.arange(1, fragments) / fragments) if len(size) else np.empty(0, np.int64)
    return np.sort(hot["g"].to_numpy()), (parts["g"].to_numpy()[at] + 1) << 52


def _sets(docs: DataFrame, width: int, percent: int, hot: np.ndarray) -> DataFrame:
    """For each document: n, sig (of the whole set), front and bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sig, front, bits = [], [], [], []
            for s in shingles(batch.column("text").to_pylist(), width):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                front.append(_front(s, percent, held.value) if len(s) else s)
                bits.append(bitmap(s))
            lists = [_lists(x) for x in (front, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), *lists], names=["id", "fp", "n", "sig", "front", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(described, f"id {kind}, fp long, n long, sig binary, front array<long>, bits array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64)))


def _may_link(percent: int) -> Column:
    """Of a pair that shares an n-gram at places ``pos`` and ``pos2`` of its fronts: can it still be similar?

    The first one that a pair shares bounds its overlap by what is left of both sets; a similar
    pair passes there, so it may fail at its others.
    """
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return rest * (100 + percent) >= (F.col("n") + F.col("n2")) * percent


def _unlike(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ; the larger one is folded to the size of the other."""

    def fold(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a)
    y = F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _most_unlike(total: Column, percent: int) -> Column:
    """Members in which two similar sets of ``total`` members together differ at most: all but twice the overlap."""
    return total - 2 * F.ceil(total * percent / (100 + percent))


def _links(pairs: DataFrame, percent: int, fetch: Callable[[DataFrame], DataFrame], bits: DataFrame | None) -> DataFrame:
    """The pairs (sig, n, sig2, n2) that are similar, as (a, b): bitmaps first, if there are any, then exact overlaps by fragment."""
    swap = F.col("sig") > F.col("sig2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(pick("sig", "sig2").alias("a"), pick("sig2", "sig").alias("b"), pick("n", "n2").alias("na"), pick("n2", "n").alias("nb")).distinct()
    total = F.col("na") + F.col("nb")
    if bits is not None:
        left, right = (bits.select(F.col("sig").alias(c), F.col("bits").alias(f"bits{c}")) for c in "ab")
        pairs = pairs.join(left, "a").join(right, "b")
        pairs = pairs.where(_unlike(F.col("bitsa"), F.col("bitsb")) <= _most_unlike(total, percent))
    pairs = save(pairs.select("a", "b", "na", "nb"), "pairs")
    segments = fetch(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct())
    left = pairs.join(segments.withColumnsRenamed({"sig": "a", "part": "part_a"}), "a")
    met = left.join(segments.withColumnsRenamed({"sig": "b", "part": "part_b"}), ["b", "fragment"])
    shared = met.select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("s"))
    summed = shared.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("overlap"))
    links = save(summed.where(F.col("overlap") * (100 + percent) >= total * percent).select("a", "b"), "links")
    drop_saved(pairs)
    return links


def segments_of(texts: DataFrame, width: int, hot: np.ndarray, edges: np.ndarray) -> DataFrame:
    """The sets of ``texts`` (sig, text) cut by the fragments of the global order: sig, fragment, part.

    ``edges``: where the order of the n-grams that aren't frequent is cut. Frequent ones, which
    come last in the order, are a fragment of their own.
    """
    held = texts.sparkSession.sparkContext.broadcast((hot, edges))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, edges = held.value
        for batch in slices(batches):
            pieces, where, who = [], [], []
            for i, s in enumerate(shingles(batch.column("text").to_pylist(), width)):
                last = _in(hot, s)
                own = s[~last]
                for k, part in enumerate([*np.split(own, np.searchsorted(own, edges)), s[last]]):
                    if len(part):
                        pieces.append(part)
                        where.append(k)
                        who.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("sig").take(pa.array(who, pa.int64())), pa.array(where, pa.int32()), _lists(pieces)], names=["sig", "fragment", "part"])

    # A row that repeats the representative gives its parts again.
    return save(texts.mapInArrow(cut, "sig binary, fragment int, part array<long>").dropDuplicates(["sig", "fragment"]), "segments")


def shared_posts(posts: DataFrame) -> DataFrame:
    """The posts whose gram several nodes have, with the node that has it nearest to its front (sig2, n2, pos2); one shuffle for both. Bitmaps in ``bits`` stay beside them."""
    of = Window.partitionBy("gram")
    hub = F.min(F.struct("pos", "n", "sig")).over(of)
    met = posts.withColumns({"hub": hub, "c": F.count("*").over(of)}).where("c > 1")
    return save(met.select("gram", "sig", "n", "pos", *[F.col(f"hub.{c}").alias(f"{c}2") for c in ("sig", "n", "pos")], *_own_bits(posts)), "posts")


def _own_bits(posts: DataFrame) -> list[str]:
    return [c for c in posts.columns if c == "bits"]


def linked_components(posts: DataFrame, percent: int, fetch: Callable[[DataFrame], DataFrame], bits: DataFrame | None = None) -> DataFrame:
    """``node``, ``root`` for the nodes (sig) that links reach; ``posts`` as :func:`shared_posts` gives them propose the pairs.

    ``fetch`` gives the segments of nodes (sig) that it is asked for. ``bits``: sig and bitmap of all nodes. Where sets are
    small, posts may have bitmaps themselves (``bits``): then unlike nodes that share a gram are told apart where they
    meet, and their pairs, which can be the square of a gram's nodes, are never rows.
    """
    # Every node against one of its n-grams' hubs, which is enough for most of a group of near copies;
    # then against the others, where that left the two apart.
    near = posts.where((F.col("sig") != F.col("sig2")) & _may_link(percent)).groupBy("sig", "n", "sig2", "n2").agg(F.count("*").alias("shared"))
    near = save(near, "hub-pairs")
    # The hub that shares most of a node's front is the one that it most likely links with.
    one = near.groupBy("sig", "n").agg(F.max(F.struct("shared", "sig2", "n2")).alias("hub")).select("sig", "n", "hub.sig2", "hub.n2")
    near = near.drop("shared")
    links = _links(one, percent, fetch, bits)
    roots = save(components(links), "roots")
    rest = _apart(near, roots)
    others = _links(rest.join(one.select("sig", F.col("sig2").alias("tried")), "sig").where("sig2 != tried").drop("tried"), percent, fetch, bits)
    if not others.isEmpty():
        links = links.unionByName(others)
        drop_saved(roots)
        roots = save(components(links), "roots")

    # Then whatever is still apart: nodes outside the hub's component against all nodes outside their own.
    placed = posts.drop("sig2", "n2", "pos2").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    of = Window.partitionBy("gram")
    main = F.min(F.struct("pos", "n", "sig", "root")).over(of)
    placed = placed.withColumns({"main": main, "lo": F.min("root").over(of), "hi": F.max("root").over(of), "c": F.count("*").over(of)}).where("lo != hi")
    own = _own_bits(posts)
    open_posts = save(placed.select("gram", F.lit(0).cast("long").alias("front"), "sig", "n", "pos", "root", F.col("main.root").alias("main"), *own, "c"), "open-posts")
    if own:
        open_posts = _by_fronts(open_posts, percent, fetch)
    open_posts = open_posts.drop("c")
    strays = open_posts.where("root != main").select("gram", "front", *[F.col(c).alias(f"{c}2") for c in ("sig", "n", "pos", "root", *own)])
    apart = (F.col("root") != F.col("root2")) & ((F.col("root") == F.col("main")) | (F.col("sig") < F.col("sig2")))
    alike = _unlike(F.col("bits"), F.col("bits2")) <= _most_unlike(F.col("n") + F.col("n2"), percent) if own else F.lit(True)
    more = _links(open_posts.join(strays, ["gram", "front"]).where(apart & _may_link(percent) & alike), percent, fetch, bits)
    drop_saved(open_posts)
    if more.isEmpty():
        return roots
    drop_saved(roots)
    return save(components(links.unionByName(more)), "roots")


def _by_fronts(open_posts: DataFrame, percent: int, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``open_posts`` with a row for each n-gram of a node's front where more than FREQUENT nodes share the gram, for sets of one fragment.

    Similar sets share an n-gram of their fronts, whatever the order is. So nodes that share a gram by chance, whose pairs
    grow with the square of the table, need not all meet. The order here is by how many nodes have an n-gram, then by hash.
    """
    many = open_posts.where(F.col("c") > FREQUENT)
    parts = fetch(many.select("sig").distinct()).join(many.select("sig").distinct(), "sig", "left_semi")
    each = save(parts.select("sig", F.size("part").alias("size"), F.explode("part").alias("front")), "front-grams")
    counted = each.groupBy("front").count()
    order = F.row_number().over(Window.partitionBy("sig").orderBy("count", "front"))
    front = each.join(counted, "front").withColumn("place", order).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1)
    front = save(front.select("sig", "front"), "fronts")
    drop_saved(each)
    few = open_posts.where(F.col("c") <= FREQUENT)
    out = save(few.unionByName(many.drop("front").join(front, "sig").select(*open_posts.columns)), "open-fronts")
    for used in (open_posts, front):
        drop_saved(used)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (sig, sig2, ...) that are of two components, ``roots`` of which has those of two nodes or more."""
    for c in ("sig", "sig2"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    met = pairs.where(~F.coalesce("sig_root", "sig").eqNullSafe(F.coalesce("sig2_root", "sig2")))
    return met.drop("sig_root", "sig2_root")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """The packed rows of ``docs``, and for each document (i, f): n, root (of its component; null without words) and component_id."""
    rows = packed(docs, id_col, text_col)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), text_bytes(text_col).alias("text"))
    texts = source.select("text")

    # What is frequent among the fronts; then among the whole sets of documents whose fronts are
    # full of it, as those of copies and of short texts around a common passage are.
    first, edges = _frequent(texts, width, lambda s: _front(s, percent, None) if len(s) else None, fragments)

    def full(s: np.ndarray) -> np.ndarray | None:
        front = _front(s, percent, None)
        return s if len(front) and _in(first, front).mean() >= FULL_SHARE else None

    hot = np.union1d(first, _frequent(texts, width, full)[0])
    sets = save(_sets(source, width, percent, hot), "sets")

    nodes = sets.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.min("id").alias("least_id"), F.min(F.struct("id", "fp")).alias("rep"), F.first("front").alias("front"), F.first("bits").alias("bits"))
    nodes = save(nodes, "nodes")
    narrow = save(sets.select("id", "fp", "n", "sig"), "set-names")
    drop_saved(sets)

    def fetch(needed: DataFrame) -> DataFrame:
        needed = save(needed.join(nodes, "sig").select("sig", F.col("rep.id").alias("rid"), F.col("rep.fp").alias("rfp")), "pair-nodes")
        wanted = F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed
        found = source.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("fp") == F.col("rfp"))).select("sig", "text")
        segments = segments_of(found, width, hot, edges)
        drop_saved(needed)
        return segments

    posts = shared_posts(nodes.select("sig", "n", F.posexplode("front").alias("pos", "gram")))
    roots = linked_components(posts, percent, fetch, nodes.select("sig", "bits"))
    drop_saved(posts)

    named = nodes.select("sig", "least_id").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = save(named.join(least, "root").select("sig", "root", "component_id"), "named")
    drop_saved(nodes)
    drop_saved(roots)
    found = narrow.dropDuplicates(["id", "fp"]).join(named, "sig", "left")
    return rows, found.select(F.col("id").alias("i"), F.col("fp").alias("f"), "n", "root", "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, fragments: int = 8) -> DataFrame:
    """``docs`` with ``n_shingles`` (size of the document's set) and ``component_id``.

    Two documents link when their sets of ``width``-word shingles (A-Z lower-cased, words between
    ASCII white space) have 100 * overlap >= ``percent`` * union. ``component_id`` is the smallest
    id that links reach. A text with fewer words is one shingle; one without words, or null, has
    none and links with nothing, so its component is its own id. Null ids count in no minimum: a
    component of null ids alone has a null id. Rows that repeat a document get its result; an
    empty table gives an empty result. Columns of the input with the two names are replaced.
    """
    rows, found = _grouped(docs, id_col, text_col, width, percent, fragments)
    out = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f")))
    return unpacked(out, docs.columns, n_shingles=F.col("n"), component_id=F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, fragments: int = 8) -> DataFrame:
    """One row of ``docs`` for each component of :func:`similar_groups`: of its document with the smallest id, nulls last.

    Rows that repeat that document leave one. Documents without words are components of their own:
    each stays once, those with a null id too.
    """
    rows, found = _grouped(docs, id_col, text_col, width, percent, fragments)
    place = F.struct(F.isnull("i").alias("late"), "i", "f")
    # Ids are enough to choose; texts follow for the chosen ones alone.
    chosen = found.where("n > 0").groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.i").alias("i"), F.col("p.f").alias("f"))
    chosen = chosen.unionByName(found.where("n = 0").select("i", "f"))
    out = rows.join(chosen, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f"))).drop("i", "f")
    return unpacked(out.dropDuplicates(["id", "fp"]), docs.columns)


def op3_jaccard_join(spark, sf_dir):
    """All documents by 3-word shingles at 90 percent."""
    out = similar_groups(table(spark, sf_dir, "documents"), width=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


#: Fine on small tables, where pairs that share any n-gram are few.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), r(x, y) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.x, CASE WHEN e.a = r.y THEN e.b ELSE e.a END FROM r JOIN e ON r.y = e.a OR r.y = e.b
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) ON x = w.doc_id
"""
