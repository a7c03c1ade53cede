"""Quality rules: base statistics of a text, and cross-document line frequency.

A document fails outright on its base statistics. Beyond these, normalised lines are hashed
and, for each host, counted over distinct documents; lines above the limits are boilerplate
and are taken out, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import SALTS, inner, join_keys, packed, row_udf, same_document, save, table, text_bytes, unpacked
from lodestone.llm.shingles import word_hashes

#: Words to a window for ``n_repeat_words``.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
NOT_FIRST_BYTES = bytes(range(0x80, 0xC0))
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), list(SPACES))
#: Windows of one hash whose words are objects at once.
LIKE = 4096
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(text: bytes, width: int = WINDOW) -> tuple[int, int]:
    """The words of a text, and those inside windows of ``width`` words that it has twice or more, the first included.

    Words are hashes at first, so that those of a long text needn't be objects. Hashes only propose
    repeated windows; the windows' words decide.
    """
    hashes = word_hashes(text)
    at, h = repeated_windows(hashes, width)
    if not len(at):
        return len(hashes), 0
    start, stop = word_spans(text)
    order = np.argsort(h, kind="stable")
    at = at[order]
    edges = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1], True]).tolist()
    again = np.ones(len(at), bool)
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        places = at[first:last]
        spans = [text[i:j] for i, j in zip(start[places].tolist(), stop[places + width - 1].tolist(), strict=True)] if last - first <= LIKE else None
        if spans is None:
            # Very many of one hash: one by one against the first, which they all but surely equal.
            own = text[start[places[0]] : stop[places[0] + width - 1]].split()
            if all(text[i:j].split() == own for i, j in zip(start[places].tolist(), stop[places + width - 1].tolist(), strict=True)):
                continue
            spans = [text[i:j] for i, j in zip(start[places].tolist(), stop[places + width - 1].tolist(), strict=True)]
        if any(x != spans[0] for x in spans):
            words = [tuple(x.split()) for x in spans]
            often = Counter(words)
            again[first:last] = [often[w] > 1 for w in words]
    return len(hashes), covered(at[again], len(hashes), width)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and stops, in bytes."""
    space = np.concatenate([[True], IS_SPACE[np.frombuffer(text, np.uint8)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def repeated_windows(order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows whose hash the text has twice or more, and the hashes."""
    n = len(order) - width + 1
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    mixed = (order + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    ranked = np.argsort(h)
    same = h[ranked][1:] == h[ranked][:-1]
    at = np.sort(ranked[np.r_[False, same] | np.r_[same, False]])
    return at, h[at]


def covered(at: np.ndarray, n: int, width: int) -> int:
    """Words of ``n`` that windows at these places cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """``STATS`` of one text in UTF-8."""
    seen: set[bytes] = set()
    twice = 0
    for line in text.split(b"\n"):
        if line in seen:
            twice += 1
        elif line.strip():
            seen.add(line)
    n, again = repeated_words(text)
    joined = text.translate(None, SPACES)
    return (
        n,
        len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, NOT_FIRST_BYTES))),
        len(text) - len(text.translate(None, SYMBOLS)),
        twice,
        again,
    )


def normal_line(line: bytes) -> bytes:
    """A line as it is counted: stripped of ASCII white space, A-Z lower-cased, digits read as 0."""
    return line.strip().lower().translate(DIGITS)


DIGITS = bytes(48 if 48 <= i < 58 else i for i in range(256))


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normal_line(line)) - (1 << 63)


DESCRIBED = ", ".join(f"{c} long" for c in STATS) + ", lines array<long>"


def describe(texts: pa.Array) -> pa.Array:
    """Base statistics, and the hashes of the different lines of a text that have a word."""
    stats, hashes = [], []
    for text in texts:
        text = text.as_py()
        stats.append(base_stats(text))
        hashes.append(list({line_hash(line) for line in text.split(b"\n") if line.strip()}))
    columns = list(zip(*stats, strict=True)) if stats else [[]] * len(STATS)
    arrays = [pa.array(list(c), pa.int64()) for c in columns]
    return pa.StructArray.from_arrays([*arrays, pa.array(hashes, pa.list_(pa.int64()))], names=[*STATS, "lines"])


def strip(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines whose hashes are in ``gone``, and how many words went."""
    counts, left = [], []
    for text, g in zip(texts, gone, strict=True):
        text, g, n = text.as_py(), g.as_py(), 0
        if g:
            g, stay = set(g), []
            for line in text.split(b"\n"):
                if line.strip() and line_hash(line) in g:
                    n += len(line.split())
                else:
                    stay.append(line)
            text = b"\n".join(stay)
        counts.append(n)
        left.append(text)
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=["n", "text"])


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_line_docs: int = 10,
    max_line_share: float = 0.01,
    min_left_words: int = 5,
    min_left_percent: int = 30,
) -> DataFrame:
    """``docs`` with ``STATS``, ``base_failed``, ``n_boilerplate`` (words in lines taken out), ``kept``, and ``text`` without those lines.

    A line (stripped, A-Z lower-cased, digits read as 0) is boilerplate on a host if more distinct
    documents of the host have it than ``max_line_docs`` and than ``max_line_share`` of the host's
    documents. A document is kept if its base statistics pass and ``min_left_words`` words and
    ``min_left_percent`` of its words are left.

    Null ids are allowed; null hosts are one host; a null or empty text has no words and fails;
    rows that repeat an id with its text on a host are one document and get its result; an empty
    table gives an empty result. Texts over LONG_TEXT bytes tell words and windows apart by
    64-bit hashes. Columns of the input with the result's names are replaced.
    """
    rows = packed(docs, id_col, text_col, host_col)
    described = row_udf(describe, DESCRIBED)(text_bytes(inner(docs, text_col)))
    found = rows.select("id", "fp", "c0", described.alias("d")).select("id", "fp", "c0", "d.*")
    base = save(found.dropDuplicates(["id", "fp", "c0"]), "quality-base")

    # Distinct documents of a host, and how many of them have each line. A host may be a third of
    # all rows: lines spread it, and its own number is repeated for each salt.
    hosts = base.groupBy("c0").agg(F.count("*").alias("n_docs")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = base.select("id", "fp", "c0", F.explode("lines").alias("line"))
    counted = lines.groupBy("c0", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_line_docs).withColumn("s", F.pmod("line", F.lit(SALTS)).cast("int"))
    often = counted.join(hosts, counted["c0"].eqNullSafe(hosts["c0"]) & (F.col("s") == F.col("salt"))).where(F.col("n") > F.col("n_docs") * max_line_share)
    often = save(often.select(counted["c0"], "line"), "quality-lines")
    gone = join_keys(lines, often, ["c0", "line"], ["id", "fp"]).groupBy("id", "fp", "c0").agg(F.collect_list("line").alias("gone"))

    judged = base.drop("lines")
    judged = judged.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
    judged = judged.join(gone.withColumnsRenamed({"id": "gid", "fp": "gfp", "c0": "gc"}), F.col("id").eqNullSafe(F.col("gid")) & (F.col("fp") == F.col("gfp")) & F.col("c0").eqNullSafe(F.col("gc")), "left").drop("gid", "gfp", "gc")
    stripped = row_udf(strip, "n long, text string")(text_bytes(inner(docs, text_col)), F.col("gone"))
    out = rows.join(judged, same_document(rows, judged, "c0")).withColumn("done", stripped)
    left = F.col("n_words") - F.col("done.n")
    kept = ~F.col("base_failed") & (left >= min_left_words) & (left * 100 >= F.col("n_words") * min_left_percent)
    new = {c: F.col(c) for c in (*STATS, "base_failed")} | {"n_boilerplate": F.col("done.n"), "kept": kept, text_col: F.col("done.text")}
    return unpacked(out, docs.columns, **new)


def op9_quality_rules(spark, sf_dir):
    """All documents under the production rules; the source is the host."""
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), ln AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         translate(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[0-9]', '0', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM ln
), dup AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS c FROM lw WHERE n > 0 GROUP BY ALL) GROUP BY doc_id
), often AS (
  SELECT c.source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS docs FROM lw WHERE n > 0 GROUP BY source, k) c
  JOIN (SELECT source, count(*) AS all_docs FROM d GROUP BY source) a ON c.source IS NOT DISTINCT FROM a.source
  WHERE docs > 10 AND docs > all_docs * 0.01
), gone AS (
  SELECT doc_id, sum(n)::BIGINT AS gone
  FROM lw JOIN often ON lw.source IS NOT DISTINCT FROM often.source AND lw.k = often.k
  WHERE n > 0 GROUP BY doc_id
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)
), twice AS (
  SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id
), j AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(gone, 0) AS gone
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_words - gone >= 5 AND (n_words - gone) * 100 >= n_words * 30 AS kept
FROM j
"""
