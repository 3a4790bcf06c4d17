"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of 256 bits. A URL's hash picks one block and one bit in each of its eight words; the blocks
are made by bit_or over the listed URLs, so building it is one map-side combined aggregation. The number of blocks is a power
of two, about 16 bits a listed URL and at most shared.MAX_BLOCKS (10 MB), which bounds what is broadcast whatever the list; a fuller
filter only passes more URLs to the exact hash join, which removes every false positive.

Defined results: a null or empty URL, or one without `://`, has an empty host and path, fits no rule, isn't listed and is
allowed. Repeated rows are judged one by one; of rules of equal length that fit, the later one in order of length counts. Very
long URLs are read whole. The input is carried as a struct, so its columns can have any names. An empty list blocks nothing;
no pages, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import flagged, stored, table

#: (verdict, rule): host, then path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Query parameters that don't change a page.
TRACKING = ("utm_[^=]*", "ref", "fbclid", "gclid")
#: What puts a page on the registered query's list: a label of its host, or runs of symbols in its title.
MARKERS = ("spam-farm", "casino-win", "cheap-pills", "free-bets", "adult-x", "ads-track")
TITLE_JUNK = "<title>[^<]*([#*$%]{3}|[|] )"


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without a trailing slash, sorted query without tracking parameters; no
    scheme, no fragment. Null if there is no host."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)\\z", "")
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.rlike(x, F.lit("^(" + "|".join(TRACKING) + ")(=|\\z)")))
    asked = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+\\z", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls. rules: a short list, kept in the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        on, slash, start = text.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page, host, path, rule, listed, verdict): every row of pages as the struct `page`; the rule's verdict, else block if
    the canonical URL is listed. listed: a column `url`. The list's keys are stored, so whatever they are taken from is read once;
    rows that the filter rules out aren't shuffled, and the others meet the keys in an exact hash join."""
    spark = pages.sparkSession
    keys = stored(spark, listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct(), "listed")
    judged = flagged(pages.select(F.struct("*").alias("page"), canonical(F.col(url)).alias("key")), "key", keys, keys.count(), "maybe")
    hits = judged.where("maybe").join(keys.withColumn("hit", F.lit(True)), "key", "left").select("page", F.coalesce("hit", F.lit(False)).alias("listed"))
    both = hits.unionByName(judged.where("NOT maybe").select("page", F.lit(False).alias("listed")))
    host, path = host_path(F.col("page")[url])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return both.select("page", "listed", host.alias("host"), path.alias("path")).select("page", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def marked(pages: DataFrame) -> DataFrame:
    """The list of the registered query: URLs of pages on hosts with a label in MARKERS or with junk in their title. Other
    spellings of such a URL are blocked with it, whatever their own title."""
    host = F.rlike(host_path(F.col("url"))[0], F.lit("(^|\\.)(" + "|".join(MARKERS) + ")\\."))
    return pages.where(F.coalesce(host | F.rlike("html", F.lit(TITLE_JUNK)), F.lit(False))).select("url")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), marked(pages)).select("page.page_id", "host", "path", "rule", "verdict", "listed")


def _oracle() -> str:
    host = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
    path = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    cases = ""
    for says, text in sorted(RULES, key=lambda r: -len(r[1])):
        on, slash, start = text.partition("/")
        cases += f" WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '{slash}{start}') THEN {{{says}|{text}}}"
    rule = "CASE" + "".join(c for c in cases) + " ELSE NULL END"
    as_rule, as_verdict = re.sub(r"\{(\w+)\|([^}]*)\}", r"'\2'", rule), re.sub(r"\{(\w+)\|([^}]*)\}", r"'\1'", rule)
    marker = f"coalesce(regexp_matches(host, '(^|\\.)({'|'.join(MARKERS)})\\.') OR regexp_matches(html, '{TITLE_JUNK}'), false)"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({'|'.join(TRACKING)})(=|\\z)'))), '&')"
    key = "CASE WHEN h <> '' THEN h || regexp_replace(path, '/+\\z', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END"
    return f"""WITH p AS (SELECT page_id, url, html, {host} AS host, {path} AS path FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)\\z', '') AS h, {query} AS q FROM p),
c AS (SELECT *, {key} AS key FROM k),
l AS (SELECT DISTINCT key AS lk FROM c WHERE {marker} AND key IS NOT NULL),
j AS (SELECT c.*, lk IS NOT NULL AS listed FROM c LEFT JOIN l ON key = lk)
SELECT page_id, host, path, {as_rule} AS rule, coalesce({as_verdict}, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j"""


ORACLE = _oracle()
