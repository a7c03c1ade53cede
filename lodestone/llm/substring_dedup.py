"""Suffix-array dedup: bytes of strings that an earlier document has too.

A string of ``length`` bytes is handled where its anchor is: the place of the least hash among
its ``GRAM``-byte grams, so that equal strings have equal anchors. Texts are read a few megabytes
at once, and of an anchor that several documents of such a part have, only two go on to meet the
other parts: an anchor that a third of all documents have is no large group anywhere. Anchors
that only one document has are dropped. Around each other anchor lies a piece of text with its
strings. Pieces meet by hash first, without their text: of equal ones, those of later documents
are repeated whole, and the first goes on only where its anchor has other pieces too.

These few are cut out and meet by anchor in a shard, which builds a suffix array by Larsson-Sadakane
refinement and finds equal strings by Kasai's common prefixes. An anchor with very many different
pieces is dealt over several shards, whose sorted strings are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import drop_saved, join_keys, packed, row_udf, same_document, save, slices, table, text_bytes, unpacked
from lodestone.llm._release import release
from lodestone.llm.shingles import mix
from lodestone.llm.suffix_arrays import equal_windows

#: Bytes of a gram, which is what texts must share for their strings to be compared; three times eight.
#: Shorter ones make fewer anchors, but more of them are shared by chance.
GRAM = 24
#: Bytes of pieces to a shard. An anchor with more is dealt over several.
SHARD_BYTES = 1 << 21
#: Tables of up to so many rows of 16 bytes are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are searched for anchors at once; a longer text is searched in overlapping windows.
TEXT_BYTES = 1 << 20
#: Bits for a place in such a window.
PLACE = np.uint64(21)
#: Bytes of text, about, whose anchors meet in one bucket.
BUCKET_BYTES = 1 << 23
#: Stands for a null id, which comes after all others.
LAST = (1 << 63) - 1


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, a window of texts at once: text, hash, and first and last start of the strings that have the anchor.

    A text of over TEXT_BYTES is cut into windows, so an anchor at a border may come twice, with
    a part of its strings each time.
    """
    span = length - GRAM + 1
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, TEXT_BYTES):
            window = text[at : at + TEXT_BYTES + length - 1] if len(text) > TEXT_BYTES else text
            if held and size + len(window) > TEXT_BYTES:
                yield _anchors(held, length, span)
                held, size = [], 0
            held.append((i, at, window))
            size += len(window)
    if held:
        yield _anchors(held, length, span)


def _anchors(held: list[tuple[int, int, bytes]], length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    wide = np.frombuffer(b"".join(w for _, _, w in held), np.uint8).astype(np.uint64)
    two = wide[:-1] | (wide[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    n = len(wide) - GRAM + 1
    hashes = mix(mix(mix(eight[:n] + np.uint64(GRAM)) + eight[8 : 8 + n]) + eight[16 : 16 + n])
    # The least hash, then the leftmost: both depend on the string alone.
    least = ((hashes >> PLACE) << PLACE) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    places = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    sizes = np.array([len(w) for _, _, w in held])
    counts = sizes - length + 1
    window = np.repeat(np.arange(len(held)), counts)
    start = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = places[start + np.repeat(np.cumsum(sizes) - sizes, counts)]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (window[1:] != window[:-1])])
    last = np.r_[first[1:], len(own)] - 1
    text, begin = (np.array([x[k] for x in held])[window[first]] for k in (0, 1))
    return text, hashes[own[first]].view(np.int64), begin + start[first], begin + start[last]


def _groups(*ordered: np.ndarray) -> np.ndarray:
    """Where a group of equal values begins."""
    n = len(ordered[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in ordered:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new][:n])


def _blobs(h: np.ndarray, ids: np.ndarray, shared: bool, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket of anchors: its pairs of anchor and document, by document, as bytes."""
    # Anchors are least hashes, so most are small numbers; mixed again they spread evenly.
    bucket = (((mix(h.view(np.uint64)) >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((ids, bucket))
    h, ids, bucket = h[order], ids[order], bucket[order]
    first = _groups(bucket)
    ends = pa.array(np.r_[first, len(h)] * 8, pa.int32())
    raw = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(c).tobytes())]) for c in (h, ids)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(np.full(len(first), shared)), *raw], names=["bucket", "shared", "hs", "ids"])


def _merged_spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans of each document."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    shift = doc * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + shift)
    new = np.r_[True, (a + shift)[1:] > reach[:-1]]
    return doc[new], a[new], (reach - shift)[np.r_[new[1:], True]]


def merge_sorted(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Runs of (sorted strings, numbers): for each run, the smallest number that any run has for its strings.

    Each run is sought in each other one by binary search.
    """
    out = [n.copy() for _, n in runs]
    for i, (strings, _) in enumerate(runs):
        for j, (others, numbers) in enumerate(runs):
            if i != j and len(others):
                at = np.minimum(np.searchsorted(others, strings), len(others) - 1)
                found = others[at] == strings
                out[i][found] = np.minimum(out[i][found], numbers[at[found]])
    return out


def shared_anchors(texts: DataFrame, length: int, total: int) -> DataFrame:
    """``id`` and ``hs``, the 64-bit anchors of ``texts`` (id, text) that two ids or more have."""
    n_buckets = max(8, total // BUCKET_BYTES)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            own = batch.column("id").to_numpy()
            found = [(own[i], h) for i, h, _, _ in anchors(batch.column("text").to_pylist(), length)]
            if not found:
                continue
            ids, h = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids, h))
            ids, h = ids[order], h[order]
            once = _groups(h, ids)
            ids, h = ids[once], h[once]
            first = _groups(h)
            n = np.diff(np.r_[first, len(h)])
            # What is shared here is known; its first and last document still meet the other parts.
            yield _blobs(h[first], ids[first], False, n_buckets)
            if (n > 1).any():
                last = (first + n - 1)[n > 1]
                yield _blobs(h[last], ids[last], False, n_buckets)
                here = np.repeat(n > 1, n)
                yield _blobs(h[here], ids[here], True, n_buckets)

    def meet(held: pa.Table) -> pa.Table:
        shared = held["shared"].to_numpy()
        columns = []
        for c in ("hs", "ids"):
            raw = held[c].to_pylist()
            columns.append([np.frombuffer(b"".join(x for x, s in zip(raw, shared, strict=True) if s == want), np.int64) for want in (False, True)])
        (h, known_h), (ids, known_ids) = columns
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        first = _groups(h)
        n = np.diff(np.r_[first, len(h)])
        apart = np.repeat(ids[first] != ids[first + n - 1], n) if len(h) else np.empty(0, bool)
        h, ids = np.r_[h[apart], known_h], np.r_[ids[apart], known_ids]
        order = np.lexsort((h, ids))
        h, ids = h[order], ids[order]
        once = _groups(ids, h)
        return pa.Table.from_arrays([pa.array(ids[once]), pa.array(h[once])], names=["id", "h"])

    found = texts.mapInArrow(find, "bucket int, shared boolean, hs binary, ids binary")
    met = found.groupBy("bucket").applyInArrow(meet, "id long, h long")
    return met.groupBy("id").agg(F.collect_list("h").alias("hs"))


def piece_fates(texts: DataFrame, length: int, total: int) -> DataFrame:
    """What becomes of the pieces around the shared anchors of ``texts`` (id, fp, text, hs): id, fp, a, b, h.

    Without ``h``: bytes from a to b are those of a piece that a smaller id has. With it: the piece is
    the first of its kind, and must be compared with others of the anchor ``h``.
    """
    n_buckets = max(8, total // BUCKET_BYTES)
    packed_names = ["bucket", "h", "name", "id", "fp", "start", "size"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            text, own, fps = batch.column("text").to_pylist(), batch.column("id").to_numpy(), batch.column("fp").to_numpy()
            shared = [np.sort(x.values.to_numpy()) for x in batch.column("hs")]
            found = []
            for who, h, a, b in anchors(text, length):
                first = _groups(who)
                keep = np.zeros(len(h), bool)
                for lo, hi in zip(first.tolist(), np.r_[first[1:], len(who)].tolist(), strict=True):
                    wanted = shared[who[lo]]
                    keep[lo:hi] = wanted[np.minimum(np.searchsorted(wanted, h[lo:hi]), len(wanted) - 1)] == h[lo:hi]
                found.append((who[keep], h[keep], a[keep], b[keep] + length))
            if not found:
                continue
            who, h, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            name = np.fromiter((xxhash.xxh3_64_intdigest(text[i][x:y]) for i, x, y in zip(who.tolist(), a.tolist(), b.tolist(), strict=True)), np.uint64, len(who)).view(np.int64)
            ids, size = own[who], b - a
            # What a smaller id here has is settled here; the others go on.
            order = np.lexsort((ids, name, h))
            first = _groups(h[order], name[order])
            least = np.repeat(ids[order][first], np.diff(np.r_[first, len(order)]))
            here = ids[order] == least
            doc, x, y = _merged_spans(who[order[~here]], a[order[~here]], b[order[~here]])
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array([len(doc) % n_buckets], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([np.ascontiguousarray(c, np.int64).tobytes()], pa.binary()) for c in (own[doc], fps[doc], x, y - x))], names=packed_names)
            stay = order[here]
            bucket = (((mix(h[stay].view(np.uint64)) >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
            sort = np.lexsort((a[stay], who[stay], bucket))
            stay, bucket = stay[sort], bucket[sort]
            at = _groups(bucket)
            ends = pa.array(np.r_[at, len(stay)] * 8, pa.int32())
            raw = [pa.Array.from_buffers(pa.binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(c[stay], np.int64).tobytes())]) for c in (h, name, ids, fps[who], a, size)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), *raw], names=packed_names)

    def meet(held: pa.Table) -> pa.Table:
        flat = lambda rows, c: np.frombuffer(b"".join(rows[c].to_pylist()), np.int64)
        local = held.filter(pc.is_null(held["h"]))
        held = held.filter(pc.is_valid(held["h"]))
        h, name, ids, fp, start, size = (flat(held, c) for c in packed_names[1:])
        order = np.lexsort((ids, name, h))
        h, name, ids, fp, start, size = (c[order] for c in (h, name, ids, fp, start, size))
        first = _groups(h, name)
        least = np.repeat(ids[first], np.diff(np.r_[first, len(h)]))
        of = _groups(h)
        kinds = np.repeat(np.add.reduceat(np.isin(np.arange(len(h)), first).astype(np.int64), of), np.diff(np.r_[of, len(h)])) if len(h) else np.empty(0, np.int64)
        later, compared = ids > least, (ids == least) & (kinds > 1)
        lid, lfp, la, lsize = (flat(local, c) for c in packed_names[3:])
        parts = [np.r_[c[later], c[compared], d] for c, d in ((ids, lid), (fp, lfp), (start, la), (size, lsize))]
        anchor = pa.array(np.r_[np.zeros(int(later.sum()), np.int64), h[compared], np.zeros(len(lid), np.int64)], mask=np.r_[np.ones(int(later.sum()), bool), np.zeros(int(compared.sum()), bool), np.ones(len(lid), bool)])
        return pa.Table.from_arrays([pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2]), pa.array(parts[2] + parts[3]), anchor], names=["id", "fp", "a", "b", "h"])

    found = texts.mapInArrow(cut, "bucket int, " + ", ".join(f"{c} binary" for c in packed_names[1:]))
    return found.groupBy("bucket").applyInArrow(meet, "id long, fp long, a long, b long, h long")


def cut_pieces(texts: DataFrame) -> DataFrame:
    """The pieces of ``texts`` (id, fp, text, wanted) at ``wanted`` (a, b, h), each different one of a text once: h, id, fp, starts, piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            who, h, starts, pieces = [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                places: dict[tuple[int, bytes], set[int]] = {}
                for w in wanted:
                    places.setdefault((w["h"], text[w["a"] : w["b"]]), set()).add(w["a"])
                for (k, piece), at in places.items():
                    who.append(i)
                    h.append(k)
                    starts.append(sorted(at))
                    pieces.append(piece)
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch.column("id").take(take), batch.column("fp").take(take), pa.array(starts, pa.list_(pa.int64())), pa.array(pieces, pa.binary())], names=["h", "id", "fp", "starts", "piece"])

    return texts.mapInArrow(cut, "h long, id long, fp long, starts array<long>, piece binary")


def _expand(row_piece: np.ndarray, run_piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and runs (both by number of their piece, runs in order) that belong together."""
    counts = np.bincount(run_piece, minlength=n)
    begin = np.cumsum(counts) - counts
    of = counts[row_piece]
    row = np.repeat(np.arange(len(row_piece)), of)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of) + np.repeat(begin[row_piece], of)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` (array of start, stop in bytes) and ``kept`` (binary).

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with
    a smaller id. Strings are judged on the whole input and never cross documents; what is left
    may cut characters of several bytes, so it is binary. A null or empty text has no bytes; long
    texts are searched in overlapping windows; null ids come after all others and not before each
    other; rows that repeat a document get its result and do not count against each other, nor do
    texts of the same id; an empty table gives an empty result. Columns of the input with the
    results' names are replaced. ``id_col`` holds integers.
    """
    spark = docs.sparkSession
    rows = packed(docs, id_col, text_col)
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), text_bytes(text_col).alias("text"))

    # A text that an earlier document has is repeated as a whole, and adds no string to others.
    narrow = save(source.select("id", "fp", F.md5("text").alias("same"), F.length("text").alias("n")), "texts")
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    several = narrow.where(F.col("n") >= length).groupBy("same").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    several = save(several.select("same", "first"), "same-texts")
    copies = save(join_keys(narrow, several, ["same"], ["id"]).where("id > first").select("id", "fp").distinct(), "copies")
    drop_saved(narrow)
    unique = source.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, ["id", "fp"], "left_anti")

    flagged = save(shared_anchors(unique.select("id", "text"), length, total), "shared-anchors")
    release(spark)
    fates = save(piece_fates(unique.join(flagged, "id").select("id", "fp", "text", "hs"), length, total), "piece-fates")
    drop_saved(flagged)
    release(spark)

    # The text of the pieces that must be compared, and of no others.
    wanted = fates.where("h IS NOT NULL").groupBy("id", "fp").agg(F.collect_set(F.struct("a", "b", "h")).alias("wanted"))
    pieces = save(cut_pieces(unique.join(wanted, ["id", "fp"]).select("id", "fp", "text", "wanted")), "pieces", "zstd")
    release(spark)
    n_shards = max(1, -(-pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0] // shard_bytes))
    large = pieces.groupBy("h").agg(F.sum(F.length("piece")).alias("bytes")).where(F.col("bytes") > shard_bytes)
    large = save(large.select("h", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts")), "large-anchors")
    # Anchors share shards; a large one has shards of its own.
    dealt = join_keys(pieces, large, ["h"], ["piece"], "left")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("h"), F.lit(n_shards))).otherwise(F.col("h"))
    part = F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("piece"), "parts").cast("int"))
    dealt = dealt.select("h", "id", "fp", "starts", "piece", shard.alias("shard"), part.alias("part"))

    def search(held: pa.Table) -> pa.Table:
        part, h = held["part"][0].as_py(), held["h"].to_numpy()
        row_piece = held["piece"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        once = np.unique(row_piece, return_index=True)[1]
        if part < 0:
            # An anchor with one piece has nothing to compare.
            _, back, counts = np.unique(h[once], return_inverse=True, return_counts=True)
            number = np.cumsum(counts[back] > 1) - 1
            keep = (counts[back] > 1)[row_piece]
            rows, row_piece, once = np.flatnonzero(keep), number[row_piece[keep]], once[counts[back] > 1]
        else:
            rows = np.arange(len(h))
        names = ["h", "id", "fp", "a", "b", "least", "part", "number", "string"]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        if not len(once):
            return pa.Table.from_arrays([pa.nulls(0, k) for k in kinds], names=names)
        data = held["piece"].take(pa.array(once)).to_pylist()
        ids = held["id"].to_numpy()
        own = ids[once]
        text = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.array([len(x) for x in data])
        begins = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        piece = np.repeat(np.arange(len(data)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[piece] + offset
        owner = np.empty(len(text), np.int64)
        owner[starts] = piece
        ordered, number = equal_windows(text, starts, length)
        new = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        least = np.minimum.reduceat(own[owner[ordered]], new)
        group = np.empty(len(text), np.int64)
        group[ordered] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(ordered)]))
        mine = group[starts]
        if part < 0:
            # Neighbouring strings of a piece that an earlier document has are one run.
            tell = (least[mine] < own[piece]).astype(np.int64)
        else:
            tell = mine
        first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (tell[1:] != tell[:-1])])
        last = np.r_[first[1:], len(piece)] - 1
        if part < 0:
            first, last = first[tell[first] > 0], last[tell[first] > 0]
        # A row has its piece at one start or more.
        lists = held["starts"].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        several = np.diff(at)[rows]
        where = np.repeat(rows, several)
        begin = flat[np.arange(len(where)) - np.repeat(np.cumsum(several) - several, several) + np.repeat(at[:-1][rows], several)]
        row, run = _expand(np.repeat(row_piece, several), piece[first], len(data))
        begin, row, n = begin[row], where[row], len(row)
        a, b = begin + offset[first[run]], begin + offset[last[run]] + length
        columns = [h[row], ids[row], held["fp"].to_numpy()[row], a, b, np.full(n, -1) if part < 0 else least[mine[first[run]]], np.full(n, part, np.int32), np.full(n, -1) if part < 0 else mine[first[run]]]
        out = [pa.Table.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.binary())], names=names)]
        if part >= 0:
            # For the other shards of this anchor: its different strings, in order.
            n, shown = len(new), [text[s : s + length].tobytes() for s in ordered[new]]
            none = pa.nulls(n, pa.int64())
            out.append(pa.Table.from_arrays([pa.array(np.full(n, h[0])), none, none, none, none, pa.array(least), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n)), pa.array(shown, pa.binary())], names=names))
        return pa.concat_tables(out)

    searched = save(dealt.groupBy("shard", "part").applyInArrow(search, "h long, id long, fp long, a long, b long, least long, part int, number long, string binary"), "runs")
    release(spark)

    def merge(held: pa.Table) -> pa.Table:
        parts = held["part"].to_numpy()
        strings = np.frombuffer(b"".join(held["string"].to_pylist()), f"V{length}")
        # Bytes compare as big-endian words, so that all lengths and zero bytes sort alike.
        strings = np.array([s.tobytes() + b"\x01" for s in strings], f"S{length + 1}")
        least = held["least"].to_numpy()
        order = np.lexsort((strings, parts))
        cuts = np.flatnonzero(np.r_[True, parts[order][1:] != parts[order][:-1]])
        runs = [(strings[o], least[o]) for o in np.split(order, cuts[1:])]
        merged = np.empty(len(least), np.int64)
        merged[order] = np.concatenate(merge_sorted(runs))
        return pa.Table.from_arrays([held["h"], held["part"], held["number"], pa.array(merged)], names=["h", "part", "number", "least"])

    strings = searched.where("string IS NOT NULL")
    slice_of = F.pmod(F.xxhash64("string"), F.lit(max(1, -(-strings.count() * length // shard_bytes))))
    merged = strings.withColumn("slice", slice_of).groupBy("h", "slice").applyInArrow(merge, "h long, part int, number long, least long")
    dealt_runs = searched.where("part >= 0 AND string IS NULL").drop("least").join(merged, ["h", "part", "number"]).where("least < id")
    gone = searched.where("part < 0").select("id", "fp", "a", "b").unionByName(dealt_runs.select("id", "fp", "a", "b"))
    # A document's own spans meet in one list, no more.
    gone = gone.unionByName(fates.where("h IS NULL").drop("h")).groupBy("id", "fp").agg(F.collect_set(F.struct("a", "b")).alias("gone"), F.lit(False).alias("whole"))
    whole = copies.select("id", "fp", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"), F.lit(True).alias("whole"))
    gone = save(gone.unionByName(whole), "removals")
    for used in (fates, pieces, searched):
        drop_saved(used)
    release(spark)

    def drop(texts: pa.Array, gone: pa.Array, whole: pa.Array) -> pa.Array:
        n, removed, spans, kept = [], [], [], []
        for text, g, w in zip(texts, gone, whole, strict=True):
            text, found = text.as_py(), []
            if w.as_py():
                found = [(0, len(text))]
            elif g.is_valid:
                a, b = g.values.field("a").to_numpy(), g.values.field("b").to_numpy()
                found = list(zip(*(c.tolist() for c in _merged_spans(np.zeros(len(a), np.int64), a, b)[1:]), strict=True))
            edges = [0, *(e for s in found for e in s), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            n.append(len(text))
            removed.append(len(text) - len(kept[-1]))
            spans.append([{"start": x, "stop": y} for x, y in found])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())], names=["n", "removed", "spans", "kept"])

    rows = rows.withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    out = rows.join(gone, same_document(rows, gone), "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    dropped = row_udf(drop, "n long, removed long, spans array<struct<start:int,stop:int>>, kept binary")
    out = out.withColumn("done", dropped(text_bytes(f"in{docs.columns.index(text_col)}"), F.col("gone"), F.col("whole")))
    return unpacked(out, docs.columns, n_bytes=F.col("done.n"), n_removed=F.col("done.removed"), spans=F.col("done.spans"), kept=F.col("done.kept"))


def op7_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of 50-byte strings that an earlier one has."""
    out = repeated_spans(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
