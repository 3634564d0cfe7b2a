"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

An entry of the list is a canonical URL and covers what lies below it: subdomains of its host, and paths under its path.
So a page has several keys (host suffixes, each with the prefixes of the path), which are looked up in its row.
Everything is built from DataFrame functions. The filter has 256-bit blocks (four longs each); a key sets one bit in each
word of its block. Its size is bounded by ``MAX_BLOCKS`` whatever the list's length, so every task may hold it: a longer
list only raises the share of false positives, and the exact join removes those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 19  # x 32 bytes: 16 MB at most in a task
SALTS = 8

#: Host and path prefixes with their verdicts; the longest that fits wins.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Sites whose pages are listed, as canonical URLs.
LISTED_NAMES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_SITES = [f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org")]


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty if null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of a URL as written; empty if null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical_url(url: Column) -> Column:
    """One spelling for URLs that name the same page; null if there is no host.

    Scheme, ``www.``, default port, fragment, tracking parameters and a final slash go; other parameters stay.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    whole = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    place = lambda j: F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(j)) for j in range(4)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def shape_of(listed: DataFrame) -> tuple[int, int, int]:
    """(entries, most host labels, most path segments) of distinct ``canonical`` entries."""
    host = F.regexp_extract("canonical", "^[^/?]*", 0)
    path = F.regexp_extract("canonical", "^[^/?]*([^?]*)", 1)
    r = listed.agg(F.count("*"), F.max(F.size(F.split(host, r"\."))), F.max(F.size(F.split(path, "/")) - 1)).first()
    return r[0], r[1] or 0, r[2] or 0


def keys_of(url: Column, labels: int, segments: int) -> Column:
    """Canonical URLs that cover a page, of at most so many host labels and path segments; empty without a host.

    An entry of more labels or segments than the longest one listed can't be met, so the two numbers leave nothing out.
    """
    whole = F.coalesce(canonical_url(url), F.lit(""))
    host = F.split(F.regexp_extract(whole, "^[^/?]*", 0), r"\.")
    path = F.split(F.regexp_extract(whole, "^[^/?]*([^?]*)", 1), "/")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(host), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(host, -n, n), "."))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size(path), F.lit(segments + 1))), lambda n: F.array_join(F.slice(path, 1, n), "/"))
    below = F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    return F.when(whole != "", F.array_distinct(F.concat(below, F.array(whole)))).otherwise(F.array().cast("array<string>"))


def bloom_words(listed: DataFrame, n_blocks: int) -> DataFrame:
    """One row ``words``: the four longs of each block, in order, for the ``canonical`` entries of ``listed``."""
    key = F.col("canonical")
    bits = listed.select(_block(key, n_blocks).alias("block"), *[b.alias(f"b{j}") for j, b in enumerate(_bits(key))])
    empty = listed.sparkSession.range(n_blocks).select(F.col("id").alias("block"), *[F.lit(0).cast("long").alias(f"b{j}") for j in range(4)])
    blocks = bits.unionByName(empty).groupBy("block").agg(F.array(*[F.bit_or(f"b{j}") for j in range(4)]).alias("w"))
    rows = blocks.agg(F.sort_array(F.collect_list(F.struct("block", "w"))).alias("rows"))  # MAX_BLOCKS entries at most
    return rows.select(F.flatten(F.transform("rows", lambda r: r["w"])).alias("words"))


def blocks_for(n_keys: int) -> int:
    """Number of blocks for a list of that length, a power of two up to MAX_BLOCKS."""
    return min(MAX_BLOCKS, 1 << max(6, (n_keys // KEYS_PER_BLOCK).bit_length()))


def listed_hits(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``maybe``, its keys that the filter passes, and a boolean ``listed``: whether one of them is in
    ``listed.canonical``.

    Pages that the filter turns away never reach a shuffle; the keys of the others are joined exactly, salted so that an
    entry that a third of all pages lie under is spread over SALTS tasks. Null URLs are not listed; repeats stay.
    """
    listed = listed.where("canonical is not null").select("canonical").distinct()
    count, labels, segments = shape_of(listed)
    n = blocks_for(count)

    def passes(k: Column) -> Column:
        words = F.slice(F.col("__words"), (_block(k, n) * 4 + 1).cast("int"), F.lit(4))
        return F.forall(F.zip_with(words, F.array(*_bits(k)), lambda w, m: w.bitwiseAND(m) != 0), lambda x: x)

    # the optimizer puts the subquery into the lambda, where it is named once: rows never carry the filter (tests look at the plan)
    keys = pages.withColumn("__keys", keys_of(F.col(url), labels, segments)).withColumn("__words", bloom_words(listed, n).scalar())
    probe = keys.select(*pages.columns, F.filter("__keys", passes).alias("maybe"))
    rest = probe.where(F.size("maybe") == 0).withColumn("listed", F.lit(False))
    exact = listed.select("canonical", F.lit(True).alias("__listed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    own = [*pages.columns, "maybe"]
    hits = (
        probe.where(F.size("maybe") > 0).withColumn("__salt", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int"))
        .select(*own, "__salt", F.posexplode("maybe").alias("__place", "canonical"))
        .join(exact.hint("shuffle_hash"), ["canonical", "__salt"], "left")
        .groupBy(*own).agg(F.coalesce(F.bool_or("__listed"), F.lit(False)).alias("listed"), F.sum(F.when(F.col("__place") == 0, 1)).alias("__rows"))
        .select(*own, "listed", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))).alias("__row")).drop("__row")
    )
    return rest.unionByName(hits)


def rule_column(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules or RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def site_list(spark: SparkSession, sites=None) -> DataFrame:
    """``canonical`` of the listed sites, or of any other canonical URLs given."""
    sites = LISTED_SITES if sites is None else sites
    return spark.range(1).select(F.explode(F.array(*map(F.lit, sites)).cast("array<string>")).alias("canonical"))


def judge(pages: DataFrame, listed: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed for each page.

    A null or malformed URL has an empty host and path, fits no rule, is not listed and so is allowed. Extra columns of
    ``pages`` are not read; repeated rows each get a row.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_column(host, path, rules)
    base = pages.select("page_id", "url")
    return listed_hits(base, listed).select(
        "page_id", host.alias("host"), path.alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        canonical_url(F.col("url")).alias("canonical"), "listed",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, site_list(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/'
  END AS rule FROM u),
c AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AS site FROM r),
listed AS (
  SELECT name || '.example.' || top AS canonical
  FROM (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) n (name),
       (VALUES ('com'), ('net'), ('org')) t (top)),
k AS (SELECT page_id, url, unnest([array_to_string(l[i:], '.') FOR i IN range(1, len(l) + 1)]) AS canonical
  FROM (SELECT page_id, url, string_split(site, '.') AS l FROM c)),
hits AS (SELECT DISTINCT page_id, url FROM k JOIN listed USING (canonical))
SELECT c.page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL OR hits.url IS NOT NULL THEN 'block'
            ELSE 'allow' END AS verdict
FROM c LEFT JOIN hits ON c.page_id = hits.page_id AND c.url = hits.url
"""
