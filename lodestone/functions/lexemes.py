"""Lexemes: English stop words, and stems by suffix rules, as column expressions.

The stemmer is Porter's published algorithm in its later English form, for lower-case words of
a-z: steps 1a to 5 with the regions R1 and R2, without its list of exceptional words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no lexeme. Fixed values.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Suffixes of steps 2, 3 and 4, each with what takes its place. Fixed values of the algorithm.
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: What comes before R1, and before R1 again before R2.
REGION = f"^{OTHER}*{VOWEL}+{OTHER}"
#: A short syllable at the end.
SHORT = f"(?:{OTHER}{VOWEL}[^aeiouywx]|^{VOWEL}{OTHER})$"


class Dialect:
    """The few functions that rules need, as Spark columns; :class:`Sql` writes the same in SQL."""

    def value(self, value):
        return F.lit(value)

    def has(self, word, pattern):
        return word.rlike(pattern)

    def change(self, word, pattern, to):
        return F.regexp_replace(word, pattern, to)

    def found(self, word, pattern, group=0):
        return F.regexp_extract(word, pattern, group)

    def size(self, word):
        return F.length(word)

    def when(self, cases, otherwise):
        out = None
        for test, value in cases:
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(otherwise)

    def both(self, a, b):
        return a & b

    def at_least(self, a, b):
        return a >= b

    def minus(self, a, b):
        return a - b

    def pick(self, table, key):
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    def cut(self, word, n, end):
        return F.concat(F.substring(word, F.lit(1), n), end)


class Sql(Dialect):
    """Rules as SQL text, for the engines that queries are held against."""

    def value(self, value):
        return str(value).lower()

    def has(self, word, pattern):
        return f"regexp_matches({word}, '{pattern}')"

    def change(self, word, pattern, to):
        return f"regexp_replace({word}, '{pattern}', '{to}')"

    def found(self, word, pattern, group=0):
        return f"regexp_extract({word}, '{pattern}', {group})"

    def size(self, word):
        return f"length({word})"

    def when(self, cases, otherwise):
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases) + f" ELSE {otherwise} END"

    def both(self, a, b):
        return f"({a} AND {b})"

    def at_least(self, a, b):
        return f"({a} >= {b})"

    def minus(self, a, b):
        return f"({a} - {b})"

    def pick(self, table, key):
        return "CASE " + key + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"

    def cut(self, word, n, end):
        return f"substr({word}, 1, {n}) || {end}"


def steps(d: Dialect) -> list:
    """The algorithm's steps, each a function of the word so far, its R1 and its R2 (letters before each region)."""

    def one_a(w, r1, r2):
        return d.when(
            [(d.has(w, "sses$"), d.change(w, "sses$", "ss")), (d.has(w, "..(?:ied|ies)$"), d.change(w, "i(?:ed|es)$", "i")), (d.has(w, "(?:ied|ies)$"), d.change(w, "i(?:ed|es)$", "ie")), (d.has(w, "(?:us|ss)$"), w), (d.has(w, f"{VOWEL}.*.s$"), d.change(w, "s$", ""))], w
        )

    def one_b(w, r1, r2):
        eed = d.when([(d.at_least(d.minus(d.size(w), d.size(d.found(w, "eed(?:ly)?$"))), r1), d.change(w, "eed(?:ly)?$", "ee"))], w)
        bare = d.change(w, "(?:ed|edly|ing|ingly)$", "")
        short = d.both(d.has(bare, SHORT), d.at_least(r1, d.size(bare)))
        mended = d.when([(d.has(bare, "(?:at|bl|iz)$"), d.change(bare, "$", "e")), (d.has(bare, "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), d.change(bare, ".$", "")), (short, d.change(bare, "$", "e"))], bare)
        return d.when([(d.has(w, "eed(?:ly)?$"), eed), (d.has(w, f"{VOWEL}.*(?:ed|edly|ing|ingly)$"), mended)], w)

    def one_c(w, r1, r2):
        return d.when([(d.has(w, f".{OTHER}y$"), d.change(w, "y$", "i"))], w)

    def by_table(table, region):
        def step(w, r1, r2):
            end = d.found(w, "(?:" + "|".join(table) + ")$")
            stem = d.minus(d.size(w), d.size(end))
            inside = d.both(d.at_least(d.size(end), d.value(1)), d.at_least(stem, r1 if region == 1 else r2))
            return d.when([(inside, d.cut(w, stem, d.pick(table, end)))], w)

        return step

    def ion(w, r1, r2):
        return d.when([(d.both(d.has(w, "[st]ion$"), d.at_least(d.minus(d.size(w), d.value(3)), r2)), d.change(w, "ion$", ""))], w)

    def five(w, r1, r2):
        at = d.minus(d.size(w), d.value(1))
        bare = d.change(w, "e$", "")
        e = d.when([(d.at_least(at, r2), bare), (d.both(d.at_least(at, r1), d.when([(d.has(bare, SHORT), d.value(False))], d.value(True))), bare)], w)
        return d.when([(d.has(w, "e$"), e), (d.both(d.has(w, "ll$"), d.at_least(at, r2)), d.change(w, "l$", ""))], w)

    return [one_a, one_b, one_c, by_table(STEP_2, 1), by_table(STEP_3, 1), by_table(dict.fromkeys(STEP_4, ""), 2), ion, five]


def regions(d: Dialect, word):
    """Letters of a word before R1 and before R2; the whole word where there is no region."""
    first = d.size(d.found(word, REGION))
    both = d.size(d.found(word, REGION + REGION[1:]))
    return tuple(d.when([(d.at_least(n, d.value(1)), n)], d.size(word)) for n in (first, both))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of up to two letters are their own.

    Each step works on a bound name (an array of one, transformed), so that no expression holds the one
    before it many times over.
    """
    d = Dialect()
    whole = F.transform(F.array(word), lambda w: F.struct(w.alias("w"), *[r.alias(n) for n, r in zip(("r1", "r2"), regions(d, w), strict=True)]))
    for step in steps(d):
        whole = F.transform(whole, _stepped(step))
    return F.when(F.length(word) > 2, F.get(whole, F.lit(0))["w"]).otherwise(word)


def _stepped(step):
    return lambda x: F.struct(step(x["w"], x["r1"], x["r2"]).alias("w"), x["r1"].alias("r1"), x["r2"].alias("r2"))


def with_stems(words: DataFrame, column: str = "token") -> DataFrame:
    """``words`` with ``stem``."""
    return words.withColumn("stem", stem(F.col(column)))


def stems_sql(relation: str, column: str = "token") -> str:
    """SQL of ``relation`` with ``stem``, by the same rules."""
    d = Sql()
    r1, r2 = regions(d, column)
    sql = f"SELECT *, {r1} AS r1, {r2} AS r2, {column} AS stem FROM {relation}"
    for step in steps(d):
        sql = f"SELECT * REPLACE ({step('stem', 'r1', 'r2')} AS stem) FROM ({sql})"
    return f"SELECT * EXCLUDE (r1, r2) REPLACE (CASE WHEN length({column}) > 2 THEN stem ELSE {column} END AS stem) FROM ({sql})"


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)
