"""A knowledge base's chunks: lexical and hybrid search over live rows, and what surrounds an answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.lexemes import STOP_WORDS, with_stems
from lodestone.functions.text import last_segment, tokens
from lodestone.functions.vector import cosine
from lodestone.operators.graph_index import nearest_exactly
from lodestone.operators.postings import Postings, occurrences
from lodestone.operators.retrieval import best_per, dense_arm, ranked
from lodestone.shared import save

#: Weights of a vendor, model and language that fit. Fixed values.
BOOSTS = {"vendor": 0.003, "model": 0.002, "language": 0.001}
#: The source type that is only searched when asked for. Fixed value.
WEB = "web"


def live_rows(chunks: DataFrame, org: str, source_types: list[str] | None = None) -> DataFrame:
    """Live, undeleted rows of an organisation. Without ``source_types``: of all types but ``WEB``; an empty list: none."""
    kind = F.col("source_type") != WEB if source_types is None else F.col("source_type").isin(source_types)
    return chunks.where((F.col("org_id") == org) & F.col("is_live") & F.col("deleted_at").isNull() & kind)


@dataclass(frozen=True)
class Query:
    """A question's words, phrases (words that follow each other) and words that must be absent; any one of them suffices."""

    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...] = ()
    absent: tuple[str, ...] = ()


def parse_question(text: str | None) -> Query:
    """Plain words, ``"quoted phrases"`` and ``-absent`` words; ``or`` is how all are joined anyway. Stop words are left out."""
    words, phrases, absent = [], [], []
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', (text or "").lower()):
        found = [w for w in re.findall("[a-z0-9]+", quoted or plain) if w not in STOP_WORDS]
        if plain == "or" or not found:
            continue
        if minus:
            absent += found
        elif len(found) > 1:
            phrases.append(tuple(found))
        else:
            words += found
    return Query(tuple(dict.fromkeys(words)), tuple(dict.fromkeys(phrases)), tuple(dict.fromkeys(absent)))


def lexicon(texts: DataFrame) -> DataFrame:
    """The different tokens of all texts with their stems: token, stem. Worth saving; it changes with the texts alone."""
    found = texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    return with_stems(found.where(~F.col("token").isin(*STOP_WORDS)))


def text_search(index: Postings, live: DataFrame, query: Query, k: int = 20) -> DataFrame:
    """id, hits, rank of the ``k`` of the ``live`` texts (id) that match, by occurrences of the words and phrases, ties by id.

    A text matches if it has one of the words or phrases by stem, or lacks an ``absent`` word. Each
    occurrence is a cover by itself, so their number is the rank's order. Only postings of the
    question's stems are read; no text is.
    """
    if not (query.words or query.phrases or query.absent):
        return ranked(live.select("id", F.lit(0).cast("long").alias("hits")).limit(0), k, F.asc("id"))
    found = occurrences(index, live, list(query.words), list(query.phrases), list(query.absent))
    return ranked(found, k, F.desc("hits"), F.asc("id"))


def match_chunks(chunks: DataFrame, vector: Column, query: Query, index: Postings, org: str, source_types: list[str] | None = None, k: int = 8, candidates: int = 20, constant: int = 60, **wanted: str) -> DataFrame:
    """The ``k`` best chunks: id, doc_id, parent_id, dense_rank, lexical_rank, similarity, score.

    ``chunks``: id, doc_id, parent_id, org_id, is_live, deleted_at, source_type, text, vector, vendor,
    models (array), language; ``index``: postings of their texts. Two arms over the live rows are fused by reciprocal ranks; a vendor,
    model or language that is ``wanted`` adds its weight. The similarity is that of every row, of those
    that only the words found too. Ties go by id.
    """
    live = live_rows(chunks, org, source_types)
    dense = dense_arm(live, vector, candidates).select("id", F.col("rank").alias("dense_rank"))
    lexical = text_search(index, live, query, candidates).select("id", F.col("rank").alias("lexical_rank"))
    both = dense.join(lexical, "id", "full")
    # The arms have a few rows; one more pass fetches what belongs to them.
    facts = live.join(F.broadcast(both), "id")
    score = sum((F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank")), F.lit(0.0))
    fits = {"vendor": lambda v: F.col("vendor") == v, "model": lambda v: F.array_contains("models", v), "language": lambda v: F.col("language") == v}
    for name, value in wanted.items():
        score = score + F.when(fits[name](value), BOOSTS[name]).otherwise(0.0)
    out = facts.select("id", "doc_id", "parent_id", "dense_rank", "lexical_rank", cosine(F.col("vector"), vector).alias("similarity"), F.round(score, 9).alias("score"))
    return out.orderBy(F.desc("score"), F.asc("id")).limit(k)


def with_parents(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best match of each parent with what to read: the matches' columns, ``content`` (the parent's text, or else its own) and ``title``.

    ``matches`` has id, parent_id and rank; ``chunks`` id, text and title.
    """
    best = best_per(matches, F.coalesce("parent_id", "id"), F.asc("rank"))
    own = chunks.select("id", F.col("text").alias("_own"), "title").join(best, "id")
    parent = chunks.select(F.col("id").alias("parent_id"), F.col("text").alias("_parent")).join(best.select("parent_id").distinct(), "parent_id")
    return own.join(parent, "parent_id", "left").select(*matches.columns, F.coalesce("_parent", "_own").alias("content"), "title")


def images_for_chunks(chunk_ids: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Pictures of the chunks' documents and pages: id, image_id, doc_id, page, caption; never the model's description, nor decorative ones.

    Ordered by chunk, page (none last) and image.
    """
    places = chunks.join(chunk_ids.select("id").distinct(), "id").select("id", "doc_id", F.col("page").alias("_page"))
    found = images.where("NOT decorative").join(places, "doc_id").where(F.col("_page").isNull() | (F.col("page") == F.col("_page")))
    return found.select("id", "image_id", "doc_id", "page", "caption").orderBy("id", F.asc_nulls_last("page"), "image_id")


def evidence_pictures(refs: DataFrame, images: DataFrame, most_refs: int = 8, most: int = 4) -> DataFrame:
    """Up to ``most`` pictures of the first ``most_refs`` references, in their order, each once: ord, image_id.

    ``refs``: ord, hash, doc_id, page. A reference with a hash means the picture of that content; one
    without, those of its page. Two equi-joins stand for the OR.
    """
    first = F.broadcast(refs.orderBy("ord").limit(most_refs))
    by_hash = images.join(first.where("hash IS NOT NULL").select("ord", F.col("hash").alias("content_hash")), "content_hash").select("ord", "image_id", "content_hash")
    by_page = images.join(first.where("hash IS NULL").select("ord", "doc_id", "page"), ["doc_id", "page"]).select("ord", "image_id", "content_hash")
    once = best_per(by_hash.unionByName(by_page), F.col("content_hash"), F.asc("ord"), F.asc("image_id"))
    return once.orderBy("ord", "image_id").limit(most).select("ord", "image_id")


def match_call_cards(cards: DataFrame, vector: Column, org: str, k: int = 5) -> DataFrame:
    """id, similarity, rank of the reviewed, live cards whose symptom is nearest."""
    usable = cards.where((F.col("org_id") == org) & F.col("is_live") & F.col("deleted_at").isNull() & (F.col("review_status") == "indexed"))
    return dense_arm(usable.select("id", F.col("symptom_vec").alias("vector")), vector, k)


def faq_evidence(faqs: DataFrame, chunks: DataFrame, vector: Column, floor: float = 0.8, strong: float = 0.92, k: int = 3) -> DataFrame:
    """Live passages behind the nearest resolved questions: id, similarity, strong, rank; one for each parent.

    ``faqs``: id, vector, active, chunk_ids. A passage counts with the most similar question that names
    it. ``strong`` tells whether the nearest question reaches that similarity.
    """
    near = dense_arm(faqs.where("active"), vector, k, floor)
    named = faqs.select("id", "chunk_ids").join(F.broadcast(near), "id").select(F.explode("chunk_ids").alias("chunk"), "similarity")
    most = named.groupBy("chunk").agg(F.max("similarity").alias("similarity"))
    top = near.agg((F.max("similarity") >= strong).alias("strong"))
    live = chunks.where("is_live AND deleted_at IS NULL").select("id", "parent_id").join(F.broadcast(most), F.col("id") == F.col("chunk"))
    best = best_per(live, F.coalesce("parent_id", "id"), F.desc("similarity"), F.asc("id")).crossJoin(F.broadcast(top))
    # Named by ``k`` questions at most, so few.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.asc("id")))).select("id", "similarity", "strong", "rank")


def record_resolutions(faqs: DataFrame, turns: DataFrame, same: float = 0.97) -> tuple[DataFrame, DataFrame]:
    """``faqs`` after rated ``turns``, and what became of each turn (turn_id, faq, reason).

    ``faqs``: id, question, vector, active, uses, chunk_ids, turn_id. ``turns``: turn_id, rating, outcome,
    verified, question, vector, chunk_ids. A rating other than ``resolved`` takes the turn's question out.
    A resolved, verified answer with a question and sources goes in, unless an active question is as
    similar as ``same``: then the nearest one counts a use. The turns of a batch meet the questions from
    before it, each turn its nearest, in blocks of a bounded size.
    """
    skip = F.when(F.col("outcome") != "answered", "not an answer").when(~F.coalesce("verified", F.lit(True)), "the answer was flagged unverified")
    skip = skip.when(F.col("question").isNull() | (F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))) == 0), "no question or sources were recorded")
    rated = turns.withColumns({"reason": F.when(F.col("rating") == "resolved", skip), "resolved": F.col("rating") == "resolved"})
    adds = rated.where("resolved AND reason IS NULL")
    # Ids of any kind as numbers, for the search.
    numbered = lambda df, c: df.select(F.xxhash64(c).alias("id"), "vector")
    near = nearest_exactly(numbered(faqs.where("active"), "id"), numbered(adds, "turn_id"), 1).where(F.col("similarity") >= same)
    ids = faqs.where("active").select(F.col("id").alias("known"), F.xxhash64("id").alias("_faq"))
    best = near.join(ids, F.col("id") == F.col("_faq")).select(F.col("query_id").alias("_turn"), "known")
    adds = adds.withColumn("_turn", F.xxhash64("turn_id"))
    placed = adds.join(best, "_turn", "left")
    uses = placed.where("known IS NOT NULL").groupBy(F.col("known").alias("id")).agg(F.count("*").alias("more"))
    out = rated.where("NOT resolved").select("turn_id", F.lit(True).alias("out"))
    kept = faqs.join(uses, "id", "left").join(out, "turn_id", "left")
    kept = kept.select("id", "question", "vector", (F.col("active") & F.col("out").isNull()).alias("active"), (F.col("uses") + F.coalesce("more", F.lit(0))).alias("uses"), "chunk_ids", "turn_id")
    new = placed.where("known IS NULL").select(F.sha2(F.concat_ws("|", "turn_id", "question"), 256).alias("id"), "question", "vector", F.lit(True).alias("active"), F.lit(0).cast("long").alias("uses"), "chunk_ids", "turn_id")
    became = rated.join(placed.select("turn_id", F.col("known").isNotNull().alias("had")), "turn_id", "left")
    faq = F.when(~F.col("resolved"), "removed").when(F.col("reason").isNotNull(), "skipped").when(F.col("had"), "already_known").otherwise("added")
    return kept.unionByName(new), became.select("turn_id", faq.alias("faq"), "reason")


def citation_text(chunks: DataFrame, citations: DataFrame, shown: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """``citations`` (cite_id, doc_id, page, section) with the text they mean: that of the page, or of the chunks whose section path ends so.

    ``chunks``: doc_id, chunk_index, page_from, page_to, section_path, text, live ones or not. Texts in order, a blank line between.
    A page or section is put together once, however many cite it; ``shown`` makes of its text what citations get.
    """
    paged, named = citations.where("page IS NOT NULL"), citations.where("page IS NULL").select("doc_id", F.lower(F.trim("section")).alias("_section"))
    # The pages of a document that are cited meet each of its chunks in one row.
    cited = paged.groupBy("doc_id").agg(F.collect_set("page").alias("_cited"))
    within = F.filter("_cited", lambda p: p.between(F.col("page_from"), F.coalesce("page_to", "page_from")))
    none = F.lit(None).cast("string")
    by_page = chunks.join(cited, "doc_id").select("doc_id", F.explode(within).alias("_page"), none.alias("_section"), "chunk_index", "text")
    tail = chunks.withColumn("_section", F.lower(last_segment(F.col("section_path")))).join(named.distinct(), ["doc_id", "_section"])
    by_section = tail.select("doc_id", F.lit(None).cast(citations.schema["page"].dataType).alias("_page"), "_section", "chunk_index", "text")
    # A page or section has few chunks.
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n")
    places = by_page.unionByName(by_section).groupBy("doc_id", "_page", "_section").agg(text.alias("text"))
    places = save(places.select("doc_id", "_page", "_section", shown(F.col("text")).alias("text")), "cited-places")
    keyed = citations.withColumns({"_page": F.col("page"), "_section": F.when(F.col("page").isNull(), F.lower(F.trim("section")))})
    same = (keyed["doc_id"] == places["doc_id"]) & keyed["_page"].eqNullSafe(places["_page"]) & keyed["_section"].eqNullSafe(places["_section"])
    return keyed.join(places, same, "left").select(*[keyed[c] for c in citations.columns], places["text"])


#: Literals that an answer may only say if its evidence does: measures with a unit, colours of wires, pins. Fixed values.
LITERAL = r"\b\d+(?:\.\d+)?\s?(?:volts?|v|amps?|a|ohms?|mm|nm|ft-lbs?|psi|hz)\b|\bpin\s?\d+\b"
SAFETY = r"(?i)\b(?:warning|caution|danger|disconnect|isolate)\b"


def literal_guard(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """What answers say without evidence, and what they leave out: answer_id, type, what.

    ``answers``: answer_id, text; ``evidence``: answer_id, text. ``detail_mismatch``: a literal that no
    evidence text has. ``dropped_warning``: a line of the evidence with a safety word, of which the answer has no
    safety word at all.
    """
    said = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LITERAL), F.lit(0)))).alias("what"))
    known = evidence.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LITERAL), F.lit(0)))).alias("what")).distinct()
    wrong = said.join(known, ["answer_id", "what"], "left_anti").select("answer_id", F.lit("detail_mismatch").alias("type"), "what")
    lines = evidence.select("answer_id", F.explode(F.split("text", "\n")).alias("what")).where(F.col("what").rlike(SAFETY)).distinct()
    silent = answers.where(~F.coalesce(F.col("text").rlike(SAFETY), F.lit(False))).select("answer_id")
    return wrong.unionByName(lines.join(silent, "answer_id", "left_semi").select("answer_id", F.lit("dropped_warning").alias("type"), "what"))


def gap_records(refused: DataFrame) -> DataFrame:
    """Questions that were refused, as rows to append: gap_id, question (2000 characters), vector, candidates (ids), reason."""
    return refused.select(F.sha2(F.concat_ws("|", "turn_id", "question"), 256).alias("gap_id"), F.substring("question", 1, 2000).alias("question"), "vector", F.coalesce("candidates", F.array().cast("array<long>")).alias("candidates"), "reason")


def citation_keys(sources: DataFrame) -> DataFrame:
    """``sources`` (answer_id, ord, doc_id, title, page, section) as citations: answer_id, key, label, ord; each key at its first place with its last label."""
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(last_segment(F.col("section")))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("s"), "section"), F.lit("")))
    named = sources.select("answer_id", key.alias("key"), F.concat_ws(", ", "title", F.nullif(where, F.lit(""))).alias("label"), "ord")
    return named.groupBy("answer_id", "key").agg(F.max_by("label", F.struct("ord", "label")).alias("label"), F.min("ord").alias("ord"))
