"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host + path`` plus the literal tokens that every URL
it fits must hold. Token frequencies are counted over all distinct URLs; each rule is
posted under its rarest token. A URL's tokens fetch the candidate rules, and only those run
their regular expression. All steps are DataFrame operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import save, table, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """``name``: shown in results, and its length decides between rules. ``pattern``: a regular
    expression that must be found in host + path. ``tokens``: lower-case alphanumeric runs that
    stand, bounded by other characters or the ends, in every URL that the pattern fits; a rule
    without any is tried on every URL. Of the rules of the same length, the one first by name wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    host = host.translate(str.maketrans(UPPER, LOWER))
    whole = re.findall("[a-z0-9]+", host)
    # The last run of the path may go on in the URL, so it is no whole token there.
    whole += re.findall("[a-z0-9]+(?=[^a-z0-9])", path.translate(str.maketrans(UPPER, LOWER)))
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host + path)
    return Rule(f"{host}{path}", verdict, rf"^(?:[^/]*\.)?{quoted}", tuple(dict.fromkeys(whole)))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits where ``word`` stands as a whole token in host or path."""
    return Rule(f"*{word}*", verdict, rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])", (word,))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.split(F.translate(key, UPPER, LOWER), "[^a-z0-9]+"))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, or null) and ``verdict``.

    Without a fitting rule the verdict is ``default``, but ``block`` for a URL without a host
    (null, empty or without ``://``). Repeated rows and repeated URLs get the same result;
    columns of the input with one of the four names are replaced. No rules: all get the default.
    """
    spark = pages.sparkSession
    columns = pages.columns
    url = F.col(f"`{url_col}`")
    row = pages.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(columns)], url_host(url).alias("host"), url_path(url).alias("path"))
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens) or [""]) for r in dict.fromkeys(rules)]
    rule_table = spark.createDataFrame(rows, "name string, rule_verdict string, pattern string, tokens array<string>")

    # A URL without any token of its own still gets the empty one, as do all for rules without tokens.
    keys = row.select(F.concat("host", "path").alias("key"), "host").where("host != ''").select("key").distinct()
    tokens = keys.select("key", F.explode(F.array_union(_tokens(F.col("key")), F.array(F.lit("")))).alias("token"))
    posted = rule_table.select("name", F.explode("tokens").alias("token"))
    small = len(rows) <= BROADCAST_RULES
    known = posted.select("token").distinct()
    # Statistics over all URLs, of the tokens that rules hold.
    seen = tokens.join(F.broadcast(known) if small else known, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        posted.join(seen, "token", "left")
        .groupBy("name")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    index = rarest.join(rule_table.drop("tokens"), "name")
    index = save(index, "url-rules")
    hits = (
        tokens.join(F.broadcast(index) if small else index, "token")
        .where(F.expr("key rlike pattern"))
        .groupBy("key")
        .agg(F.min_by(F.struct("name", "rule_verdict"), F.struct(-F.length("name"), "name")).alias("best"))
    )
    # Written first, so that the join below exchanges both sides and a hot URL can be split at run time.
    hits = save(hits, "url-verdicts")
    out = row.withColumn("key", F.concat("host", "path")).join(hits, "key", "left")
    otherwise = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit(default))
    verdict = F.coalesce(F.col("best.rule_verdict"), otherwise)
    return unpacked(out, columns, host=F.col("host"), path=F.col("path"), rule=F.col("best.name"), verdict=verdict)


PRODUCTION_RULES = [
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
]


def op8_url_filters(spark, sf_dir):
    """Every page's URL under the production rules."""
    return filter_urls(table(spark, sf_dir, "pages"), PRODUCTION_RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rhost, rpath, rv) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), h AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rv, length(rhost || rpath)) AS rv
  FROM (SELECT DISTINCT host, path FROM u) JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, u.host, u.path, h.rule AS rule,
       coalesce(h.rv, CASE WHEN u.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN h ON u.host = h.host AND u.path = h.path
"""
