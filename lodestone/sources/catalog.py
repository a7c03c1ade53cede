"""Makes, years, models and key types as a site's endpoints tell them, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import squeeze

#: Names under which endpoints give a level's value, the first one that is there counts. Fixed values.
NAMES = {"makes": ["make", "name"], "years": ["year"], "models": ["model", "name", "m"], "recnum": ["profile_id", "pid", "veh_id"], "key_type": ["key_type", "kt"]}


def _objects(body: Column) -> Column:
    """The elements of a JSON array as JSON texts; a body that is no array has none."""
    return F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>"))


def _named(item: Column, names: list[str]) -> Column:
    """The first of ``names`` that an object has; null for others."""
    return F.coalesce(*[F.get_json_object(item, f"$.{n}") for n in names])


def values(body: Column, level: str) -> Column:
    """A level's values in order: of strings or numbers themselves, of objects the named field; empty ones are left out."""
    read = lambda x: F.coalesce(F.when(F.startswith(F.ltrim(x), F.lit("{")), F.coalesce(_named(x, NAMES[level]), F.lit(""))), x)
    return F.filter(F.transform(_objects(body), read), lambda v: v != "")


def key_types(body: Column) -> Column:
    """Of a keys answer: recnum and key_type of each object with a recnum."""
    each = F.transform(_objects(body), lambda x: F.struct(F.coalesce(_named(x, NAMES["recnum"]), F.lit("")).alias("recnum"), F.coalesce(_named(x, NAMES["key_type"]), F.lit("")).alias("key_type")))
    return F.filter(each, lambda k: k["recnum"] != "")


def options(html: Column) -> Column:
    """Values of the options of an older page's list of makes."""
    inner = F.regexp_extract(html, r'(?is)<select[^>]*id="make"[^>]*>(.*?)</select>', 1)
    return F.filter(F.transform(F.regexp_extract_all(inner, F.lit(r'(?is)<option[^>]*\bvalue="([^"]*)"'), F.lit(1)), squeeze), lambda v: v != "")


def first_with_rows(*answers: Column) -> Column:
    """The first array that isn't empty, as far as one is there; else an empty one."""
    out = F.array().cast("array<string>")
    for a in reversed(answers):
        out = F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a).otherwise(out)
    return out


def lattice(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Makes (make), years (make, year), models (make, year, model) and keys (make, year, model, recnum, key_type).

    ``answers``: api (makes, years, models, keys or page), source (1 first, 2 where the first has nothing), make, year,
    model (what was asked for, null above its level), body. Makes fall back on an older page's list,
    years and models on the second source, where the first is missing, empty or can't be read. A level below
    a value that isn't listed above it doesn't count. Repeated values are one.
    """
    asked = {"years": ["make"], "models": ["make", "year"], "keys": ["make", "year", "model"]}
    tops = answers.where(F.col("api").isin("makes", "page")).groupBy().agg(F.max(F.when(F.col("api") == "makes", F.col("body"))).alias("a"), F.max(F.when(F.col("api") == "page", F.col("body"))).alias("b"))
    makes = tops.select(F.explode(first_with_rows(values(F.col("a"), "makes"), options(F.col("b")))).alias("make")).distinct()
    levels = [makes]
    for api, name in (("years", "year"), ("models", "model")):
        own = answers.where((F.col("api") == api) & F.col("source").isin(1, 2)).groupBy(*asked[api]).agg(*[F.max(F.when(F.col("source") == k, F.col("body"))).alias(f"b{k}") for k in (1, 2)])
        found = own.select(*asked[api], F.explode(first_with_rows(values(F.col("b1"), api), values(F.col("b2"), api))).alias(name)).distinct()
        levels.append(found.join(levels[-1], asked[api], "left_semi"))
    keys = answers.where("api = 'keys'").select(*asked["keys"], F.explode(key_types(F.col("body"))).alias("k")).select(*asked["keys"], "k.recnum", "k.key_type").distinct()
    return (*levels, keys.join(levels[-1], asked["keys"], "left_semi"))
