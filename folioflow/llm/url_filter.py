"""URL filter (op9, native): blocked Bloom filter in front of an exact join, under host/path rules.

The list of unwanted URLs is compared in canonical form. Every listed URL sets eight bits, one in
each 32-bit lane of one 256-bit block (four longs); a page URL can only be listed if all of its
eight bits are set. Pages that pass are joined to the list itself, which removes false positives, so
the filter only decides how many rows reach the exact join, never the result.

The filter grows with the list (``BITS_PER_URL`` bits each). Up to ``BROADCAST_BLOCKS`` blocks of 32 bytes it is
broadcast; a larger one is joined by block. Pages are read once: what the filter says of them is written to the shared
folder, from where the few possible hits go to the exact join.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule, and is allowed
unless the list holds the empty URL; repeated pages are judged one by one; an empty list blocks none; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import materialize

#: (verdict, host, path): fits the host and its subdomains where the URL's path starts with the path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Blocks up to which the filter is broadcast: 8 MB.
BROADCAST_BLOCKS = 1 << 18
BITS_PER_URL = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't select content.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without closing slashes, query without tracking; no scheme or fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.concat(
        F.regexp_replace(host(url), r"^(www|m)\.", ""),
        F.regexp_replace(path(url), r"/+$", ""),
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
    )


def rule_columns(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)).cast("int")


def _masks(url: str) -> list[Column]:
    """Four longs with one bit set in each of their two 32-bit lanes."""
    lane = lambda i: f"CAST(shiftrightunsigned(xxhash64({url}, 'lanes'), {5 * i}) & 31L AS INT)"
    return [F.expr(f"shiftleft(1L, {lane(2 * j)}) | shiftleft(1L, 32 + {lane(2 * j + 1)})") for j in range(4)]


def build_filter(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """``listed``: one column ``url_key``. The filter as a table (block, w0..w3), and its number of blocks."""
    n_blocks = 1
    while n_blocks * 256 < n_listed * BITS_PER_URL:
        n_blocks *= 2
    m = listed.select(_block(F.col("url_key"), n_blocks).alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(_masks("url_key"))])
    return m.groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)]), n_blocks


def possible_hits(pages: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """``pages`` (with ``url_key``) plus ``possible``: false means certainly not listed."""
    filt, n_blocks = build_filter(listed, n_listed)
    # Read back, a large filter is dealt anew for the join, so that Spark may split a hot block.
    filt = F.broadcast(filt) if n_blocks <= BROADCAST_BLOCKS else materialize(filt, "filter").hint("merge")
    cols = pages.columns
    p = pages.withColumn("block", _block(F.col("url_key"), n_blocks)).join(filt, "block", "left")
    passed = reduce(lambda a, b: a & b, [F.col(f"w{j}").bitwiseAND(m) == m for j, m in enumerate(_masks("url_key"))])
    return p.select(*cols, F.coalesce(passed, F.lit(False)).alias("possible"))


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict and whether the URL is listed, for every page.

    ``listed`` has one column ``url_key`` of canonical URLs, without repeats.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("url_key"))
    listed = materialize(listed.select("url_key"), "listed")
    tested = materialize(possible_hits(base, listed, listed.count()), "tested")
    # Joined by URL and its hash: a list grouped by URL alone is dealt anew, so that Spark may split a hot URL.
    right = listed.select("url_key", F.xxhash64("url_key").alias("url_hash"), F.lit(True).alias("hit"))
    hits = tested.filter("possible").withColumn("url_hash", F.xxhash64("url_key")).join(right, ["url_key", "url_hash"], "left")
    cols = [F.col(id_col), F.col("host"), F.col("path")]
    out = hits.select(*cols, F.coalesce("hit", F.lit(False)).alias("listed")).unionByName(
        tested.filter("NOT possible").select(*cols, F.lit(False).alias("listed"))
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*cols, rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("listed"))


def listed_from_pages(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs that several pages share (mirrors, tracking links): the registered query's list, which grows with the pages."""
    keys = pages.select(canonical(F.col(url_col)).alias("url_key")).filter("url_key <> ''")
    return keys.groupBy("url_key").count().filter("count > 1").select("url_key")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
a AS (SELECT page_id, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        array_to_string(list_filter(string_split(regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
          lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') AS q FROM p),
b AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END AS k FROM a),
l AS (SELECT k FROM b WHERE k <> '' GROUP BY k HAVING count(*) > 1),
r(kind, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
      ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
c AS (SELECT b.page_id, b.host, b.path, b.k IN (SELECT k FROM l) AS listed,
        (SELECT max_by(r.kind || ' ' || r.h || r.p, length(r.h || r.p)) FROM r
          WHERE (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p)) AS best FROM b)
SELECT page_id, host, path, substr(best, 7) AS rule,
  CASE WHEN best IS NOT NULL THEN substr(best, 1, 5) WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM c
"""
