"""Text expressions: tokens, titles, codes, paths, and answers' citation marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def term_count(text: Column, terms: list[str]) -> Column:
    """Occurrences of any of ``terms`` (lower case) among the tokens."""
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.size(F.filter(tokens(text), lambda t: F.array_contains(wanted, t))).cast("long")


def has_code(text: Column) -> Column:
    """Whether a word holds both letters and digits, as part numbers do."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.exists(words, lambda w: w.rlike("[A-Za-z]") & w.rlike("[0-9]"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_title(title: Column) -> Column:
    """A file title without extension, leading "copy of" and trailing "(n)"."""
    t = F.regexp_replace(title, r"\.[A-Za-z0-9]{1,5}$", "")
    t = F.regexp_replace(t, r"^(?i:copy of)\s+", "")
    return F.trim(F.regexp_replace(t, r"\s*\([0-9]+\)$", ""))


def last_segment(path: Column, mark: str = ">") -> Column:
    return F.trim(F.element_at(F.split(path, F.lit(mark)), -1))


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def contains_folded(column: Column, part: str) -> Column:
    return F.contains(F.lower(column), F.lit(part.lower()))


def follow_up(text: Column, opening: list[str], back: list[str]) -> Column:
    """Whether a question leans on what was said: up to six words, an opening word, or a word that points back."""
    t = F.lower(F.trim(text))
    words = F.regexp_extract_all(t, F.lit(r"[^ \n\t]+"), F.lit(0))
    marks = F.array(*[F.lit(b) for b in back])
    return (F.size(words) <= 6) | F.element_at(words, 1).isin(*opening) | F.arrays_overlap(tokens(t), marks)
