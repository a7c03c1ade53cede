"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a piece of a line, or of a run of short lines, cut where the words themselves say so: at the start of a
three-word run whose hash is the least for some words around. So a passage has the same
paragraphs inside, whatever stands before and after it. Paragraphs with the same set of word
shingles are one node; a node's MinHash values are cut into bands, so many that a pair at the
similarity limit shares one with the wanted recall. Colliding nodes are joined, their exact
Jaccard similarity is computed from their texts, and of each component of links only the first
paragraph stays. Paragraphs with no band of another are told by a filter first, and go no further.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import BROADCAST_ROWS, drop_saved, inner, packed, row_udf, same_document, save, slices, table, text_bytes, unpacked
from lodestone.llm._release import release
from lodestone.llm.jaccard import bitmap, linked_components, shared_posts
from lodestone.llm.shingles import Words, mix, pieces

#: MinHash values to a band; with more, fewer unlike pairs collide, but more bands are needed. Paragraphs are
#: short, so unlike ones seldom share a shingle, while every band is a row to shuffle for each paragraph.
ROWS = 1
#: Bits for each key of the filter of bands, and of the whole filter at most (64 MB).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29


def tune_bands(similarity: float, recall: float, rows: int = ROWS) -> int:
    """The bands that let a pair of this similarity collide with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def bands_of(sets: list[np.ndarray], n_bands: int, rows: int = ROWS) -> np.ndarray:
    """For each set of shingles (none empty) one hash for each band; the band's number is part of it."""
    return _bands(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), n_bands, rows)


def _bands(flat: np.ndarray, at: np.ndarray, n_bands: int, rows: int = ROWS) -> np.ndarray:
    """:func:`bands_of` of sets that stand in ``flat`` one behind another, each from its place in ``at``."""
    flat = flat.view(np.uint64)
    out = np.tile(np.arange(n_bands, dtype=np.uint64), (len(at), 1))
    k = np.arange(1, n_bands * rows + 1, dtype=np.uint64)
    turn, odd = mix(k), mix(k + np.uint64(1 << 32)) | np.uint64(1)
    for r in range(rows):
        for band in range(n_bands):
            i = band * rows + r
            least = np.minimum.reduceat((flat ^ turn[i]) * odd[i], at)
            out[:, band] = mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out.view(np.int64)


def _cut(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last one (not included) and following byte of each paragraph of some texts, as :func:`paragraphs` tells them."""
    n, reach, starts = len(words.starts), min_words - 1, words.starts
    if not n:
        return (np.empty(0, np.int64),) * 3
    line = np.searchsorted(words.lines, starts)
    new = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(new)
    short = np.diff(np.append(first, n)) < min_words
    text = words.text[first]
    new[first[1:][short[1:] & short[:-1] & (text[1:] == text[:-1])]] = False
    first = np.flatnonzero(new)
    rank = np.cumsum(new) - 1
    begin, end = first[rank], np.append(first[1:], n)[rank]
    word, most = np.arange(n), np.uint64((1 << 64) - 1)
    own = np.full(n, most)
    hashes = words.runs(3)
    own[: len(hashes)] = hashes
    own[word + 3 > end] = most
    cut = np.zeros(n, bool)
    if reach:
        # Lines stand so far apart that no window reaches another.
        slot = word + reach * (rank + 1)
        spread = np.full(n + reach * (len(first) + 2), most)
        spread[slot] = own
        least = _least_of(spread, reach)
        cut = (own < least[slot - reach]) & (own <= least[slot + 1])
    else:
        cut[:] = True
    cut &= (word - begin >= min_words) & (end - word >= min_words)
    at = np.flatnonzero(cut | new)
    to = np.append(at[1:], n)
    inside = np.append(~new[at[1:]], False)
    follow = np.where(inside, starts[np.minimum(to, n - 1)], words.stops[to - 1])
    long = to - at >= min_words
    return at[long], to[long], follow[long]


def _least_of(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` values in a row."""
    n, have = len(values) - reach + 1, 1
    while have < reach:
        step = min(have, reach - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values[:n]


def paragraphs(text: bytes, min_words: int) -> list[tuple[int, int, int]]:
    """Start, stop and following start in bytes of each paragraph; the last one of a line is followed by its own stop.

    Consecutive lines of fewer than ``min_words`` words each, blank ones between them aside, are one line here. A line is cut at a word where the hash of it and the next two is less than at the
    ``min_words`` - 1 words before and not more than at as many after, all in the line, and both
    parts keep ``min_words`` words. A line of fewer words has no paragraph.
    """
    return paragraphs_of([text], min_words)[0]


def paragraphs_of(texts: list[bytes], min_words: int) -> list[list[tuple[int, int, int]]]:
    """:func:`paragraphs` of several texts, which are cut at once."""
    out = []
    for lo, hi in pieces(texts):
        words = Words(texts[lo:hi])
        at, to, follow = _cut(words, min_words)
        of = words.text[at]
        base = words.places[of]
        found = list(zip((words.starts[at] - base).tolist(), (words.stops[to - 1] - base).tolist(), (follow - base).tolist(), strict=True))
        ends = np.searchsorted(of, np.arange(hi - lo + 1)).tolist()
        out += [found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _each(make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], min_words: int, width: int) -> Callable:
    """For mapInArrow over rows with ``text``: ``make`` gets a few rows; and of their paragraphs the rows, the numbers, all shingles, and where each one's start."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for lo, hi in pieces(texts):
                words = Words(texts[lo:hi])
                at, to, _ = _cut(words, min_words)
                if len(at):
                    of = words.text[at]
                    yield make(batch.slice(lo, hi - lo), of, np.arange(len(of)) - np.searchsorted(of, of), *words.sets(at, to, width))

    return mapped


def dedup_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 8,
    width: int = 5,
    percent: int = 80,
    recall: float = 0.99,
) -> DataFrame:
    """``docs`` with ``text`` freed of repeated paragraphs, and ``n_bytes``, ``n_paragraphs``, ``n_dropped``, ``spans``.

    Two paragraphs (see :func:`paragraphs`; words between ASCII white space) link when their sets
    of ``width``-word shingles, A-Z lower-cased, have 100 * overlap >= ``percent`` * union. A pair
    at that limit is found with probability ``recall``, more alike ones almost surely, equal sets
    always. Of the paragraphs that links connect, the one of the smallest id, then the first in
    its text, stays; the others go with the white space up to the next paragraph of their line.
    ``spans`` (array of start, stop) has the bytes that went, in maximal runs; ``n_bytes`` is the
    input's size.

    Null ids come last. A null or empty text has no paragraphs and comes back as the empty text;
    rows that repeat a document get the same result, and don't repeat each other; an empty table
    gives an empty result. Columns of the input with the result's names are replaced.
    """
    spark = docs.sparkSession
    n_bands = tune_bands(percent / 100, recall)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), text_bytes(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def describe(batch: pa.RecordBatch, of: np.ndarray, pos: np.ndarray, flat: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ends = np.append(at, len(flat))
        held, ends = memoryview(flat.tobytes()), ends.tolist()
        sig = [xxhash.xxh3_128_digest(held[8 * a : 8 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n_bands), pa.array(_bands(flat, at, n_bands).ravel()))
        take = pa.array(of)
        columns = [batch.column("id").take(take), batch.column("fp").take(take), pa.array(pos.astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), pa.array(sig, pa.binary()), bands]
        return pa.RecordBatch.from_arrays(columns, names=["id", "fp", "pos", "n", "sig", "bands"])

    # Equal sets are one node, which the first paragraph with it stands for.
    found = source.mapInArrow(_each(describe, min_words, width), f"id {kind}, fp long, pos int, n int, sig binary, bands array<long>")
    found = save(found, "paragraphs")
    near = save(_near(found), "near-paragraphs")
    drop_saved(found)
    place = F.struct(F.isnull("id").alias("late"), "id", "fp", "pos")
    nodes = near.groupBy("sig").agg(F.first("n").alias("n"), F.min(place).alias("first"), F.count("*").alias("c"), F.first("bands").alias("bands"))
    nodes = save(nodes, "paragraph-nodes")
    release(spark)

    # One shuffle by band, for nodes alone and of nothing but their names; of those that share a band the rest is fetched.
    bands = nodes.select(F.explode("bands").alias("gram"), F.xxhash64("sig").alias("name"))
    shared = save(bands.withColumn("c", F.count("*").over(Window.partitionBy("gram"))).where("c > 1").select("gram", "name"), "paragraph-bands")
    release(spark)
    named = shared.select("name").distinct()
    named = save(nodes.select(F.xxhash64("sig").alias("name"), "sig", "n", "first").join(_sent(named), "name", "left_semi"), "near-nodes")
    release(spark)
    # What shares a band is cut out of its text, once.
    wanted = named.groupBy(F.col("first.id").alias("rid"), F.col("first.fp").alias("rfp")).agg(F.collect_list(F.struct("first.pos", "sig")).alias("wanted"))

    def pick(batch: pa.RecordBatch, of: np.ndarray, pos: np.ndarray, flat: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        sigs = [{w["pos"]: w["sig"] for w in row} for row in batch.column("wanted").to_pylist()]
        ends, sig, parts, bits = np.append(at, len(flat)).tolist(), [], [], []
        for i, (row, k) in enumerate(zip(of.tolist(), pos.tolist(), strict=True)):
            if k in sigs[row]:
                sig.append(sigs[row][k])
                parts.append(flat[ends[i] : ends[i + 1]])
                bits.append(bitmap(parts[-1]))
        columns = [pa.array(sig, pa.binary()), pa.array(np.zeros(len(sig), np.int32)), pa.array(parts, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["sig", "fragment", "part", "bits"])

    cut = source.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("fp") == F.col("rfp"))).select("wanted", "text")
    # A row that repeats a document gives its parts again.
    segments = save(cut.mapInArrow(_each(pick, min_words, width), "sig binary, fragment int, part array<long>, bits array<long>").dropDuplicates(["sig", "fragment"]), "segments")
    release(spark)
    known = segments.select(F.xxhash64("sig").alias("name"), "sig", F.size("part").alias("n"), "bits")
    posts = shared_posts(shared.join(_sent(known), "name").select("sig", "n", F.lit(0).alias("pos"), "gram", "bits"))
    for used in (shared, named):
        drop_saved(used)
    release(spark)
    parts = segments.drop("bits")
    roots = linked_components(posts, percent, lambda needed: parts)
    for used in (posts, segments):
        drop_saved(used)
    release(spark)

    # The first paragraph of each component, and of each set that occurs more than once without links.
    linked = nodes.select("sig", "first").join(_sent(roots.withColumnRenamed("node", "sig")), "sig")
    least = linked.groupBy("root").agg(F.min("first").alias("stays"))
    alone = nodes.where("c > 1").join(_sent(roots.select(F.col("node").alias("sig"))), "sig", "left_anti")
    stays = save(linked.join(least, "root").select("sig", "stays").unionByName(alone.select("sig", F.col("first").alias("stays"))), "paragraph-stays")
    for used in (nodes, roots):
        drop_saved(used)
    release(spark)
    # A document's own lines meet in one list, no more.
    gone = near.select("id", "fp", "pos", "sig").join(_sent(stays), "sig").where(place != F.col("stays")).groupBy("id", "fp").agg(F.collect_set("pos").alias("gone"))
    gone = save(gone, "paragraphs-gone")
    for used in (near, stays):
        drop_saved(used)
    release(spark)

    def strip(texts: pa.Array, gone: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        cut = paragraphs_of(texts, min_words)
        rows = [strip_paragraphs(t, set(g or ()), found) for t, g, found in zip(texts, gone.to_pylist(), cut, strict=True)]
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_paragraphs", pa.int64()), ("n_dropped", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("text", pa.string())]))

    stripped = row_udf(strip, "n_bytes long, n_paragraphs long, n_dropped long, spans array<struct<start: long, stop: long>>, text string")
    rows = packed(docs, id_col, text_col)
    out = rows.join(gone, same_document(rows, gone), "left").withColumn("done", stripped(text_bytes(inner(docs, text_col)), F.col("gone")))
    new: dict[str, Column] = {c: F.col(f"done.{c}") for c in ("n_bytes", "n_paragraphs", "n_dropped", "spans")}
    return unpacked(out, docs.columns, **new, **{text_col: F.col("done.text")})


def _near(found: DataFrame) -> DataFrame:
    """The rows of ``found`` with a band that another row has too, and a few others; most have none and are never shuffled.

    Only bands are, each summed up where it is read. Those of several rows set two bits each of a filter of bounded size,
    which goes to all tasks. A full one lets more rows through; none that shares a band is lost.
    """
    common = save(found.select(F.explode("bands").alias("gram")).groupBy("gram").count().where("count > 1").select("gram"), "common-bands")
    release(found.sparkSession)
    size = min(MOST_FILTER_BITS, max(1 << 15, 1 << (FILTER_BITS * common.count()).bit_length()))
    low = size - 1
    at = common.select(F.explode(F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 32).bitwiseAND(low))).alias("at")).select(F.col("at") + 1)
    bits = at.toDF("at").groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    held = np.zeros((size >> 15, 1 << 12), np.uint8)
    for bucket, own in zip(bits["bucket"].to_pylist(), bits["bits"], strict=True):
        held[bucket - 1] = np.frombuffer(own.as_buffer(), np.uint8)
    held = found.sparkSession.sparkContext.broadcast(held.ravel())
    drop_saved(common)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("bands").flatten().to_numpy().view(np.uint64)
            met = np.ones(len(gram), bool)
            for place in (gram & np.uint64(low), gram >> np.uint64(32) & np.uint64(low)):
                met &= (held.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(met.reshape(len(batch), -1).any(1) if len(batch) else met))

    return found.mapInArrow(pick, found.schema)


def _sent(keys: DataFrame) -> DataFrame:
    """``keys``, to be sent to all tasks if they are few; else Spark shuffles both sides, and splits the large partitions that one key makes."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def strip_paragraphs(text: bytes, gone: set[int], found: list[tuple[int, int, int]]) -> dict:
    """A text without those of its paragraphs that are numbered in ``gone``, and what went."""
    left, spans, at = [], [], 0
    for k in sorted(gone):
        start, _, stop = found[k]
        if spans and spans[-1]["stop"] == start:
            spans[-1]["stop"] = stop
        else:
            spans.append({"start": start, "stop": stop})
    for s in spans:
        left.append(text[at : s["start"]])
        at = s["stop"]
    left.append(text[at:])
    return {"n_bytes": len(text), "n_paragraphs": len(found), "n_dropped": len(gone), "spans": spans, "text": b"".join(left).decode()}


def op5_paragraph_dedup(spark, sf_dir):
    """Every document without repeated paragraphs (five words, a similarity of 0.8 or more)."""
    out = dedup_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", "n_paragraphs", "n_dropped", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
