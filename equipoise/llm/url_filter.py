"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join (DataFrame functions only).

A listing names (host, path, verdict) entries.  An entry's canonical URL is its lower-cased host
followed by its path; it covers its host and all subdomains, and all paths that start with its path.
A page's look-up keys are therefore every label suffix of its host followed by every prefix of its
path that is as long as some listed path.  Keys that the filter lets pass are possible hits; their
distinct lists are exploded once and joined by hash to the listing, which removes false positives.
The longest listed URL wins.

The filter has 2**12 to 2**18 blocks of 256 bits by the size of the listing (8 MB at most; a longer
listing only lets more false positives through to the join).  A key sets one bit in each of a
block's four words.

Defined results: a NULL url, or one without ``://``, has an empty host and path and no rule, and gets
the default verdict.  Repeated pages give repeated rows; an empty listing gives every page the default.
Entries that repeat a canonical URL count once, the smallest verdict wins; entries whose path is NULL or
doesn't begin with ``/`` can cover no page and are left out.  Extra columns are kept, but for those named
host, path, rule or verdict, which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import UPPER, free_names, materialize, table

LEAST_BLOCKS, MOST_BLOCKS, ENTRIES_A_BLOCK = 1 << 12, 1 << 18, 16
WORDS = 4

#: FIXED VALUES: the rules of the query, (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, with A-Z lower-cased; path: then up to ``?``, ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit of each word of the key's block, from a second hash."""
    second = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word_0 .. word_3) of the blocks in which a ``url`` of ``listed`` has set bits."""
    keyed = listed.select(_block(F.col("url"), blocks).alias("block"),
                          *[b.alias(f"word_{i}") for i, b in enumerate(_bits(F.col("url")))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"word_{i}").alias(f"word_{i}") for i in range(WORDS)])


def with_possible_hits(pages: DataFrame, filter_blocks: DataFrame, blocks: int, lengths: DataFrame, hits: str = "hits") -> DataFrame:
    """``pages`` (with host and path) and ``hits`` (a name that they don't have): the look-up keys that the filter lets pass.

    The filter (8 MB at most) and the listed path lengths reach the rows as scalar subqueries.
    """
    session = pages.sparkSession
    words, listed, tried = free_names([*pages.columns, hits], "filter", "sizes", "keys")
    whole = session.range(blocks).join(filter_blocks, F.col("id") == F.col("block"), "left").select(
        "id", F.array(*[F.coalesce(f"word_{i}", F.lit(0).cast("long")) for i in range(WORDS)]).alias("words"))
    # one row each, written so that the subqueries are scans of it
    packed = materialize(whole.agg(F.array_sort(F.collect_list(F.struct("id", "words"))).alias("rows")).select(
        F.flatten(F.transform("rows", lambda r: r["words"])).alias("filter")), "url-filter").scalar()
    sizes = materialize(lengths.agg(F.array_sort(F.collect_set("length")).alias("lengths")), "url-lengths").scalar()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)))
    prefixes = F.transform(F.filter(listed, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.when(F.col("host") != "", F.flatten(F.transform(
        suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))

    def passes(key: Column) -> Column:
        base = _block(key, blocks) * WORDS
        seen = [F.get(F.col(words), base + i).bitwiseAND(bit) != 0 for i, bit in enumerate(_bits(key))]
        return seen[0] & seen[1] & seen[2] & seen[3]

    return (pages.withColumns({words: packed, listed: sizes}).withColumn(tried, keys)
            .withColumn(hits, F.array_distinct(F.filter(tried, passes))).drop(words, listed, tried))


def judge_urls(pages: DataFrame, listing: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the longest listed URL that covers the page, or NULL) and verdict."""
    listed = materialize(
        listing.filter("host IS NOT NULL AND (path = '' OR startswith(path, '/'))")
        .select(F.concat(F.translate("host", UPPER, UPPER.lower()), "path").alias("url"),
                F.length("path").alias("length"), "verdict")
        .groupBy("url", "length").agg(F.min("verdict").alias("verdict")), "url-listing")
    blocks = LEAST_BLOCKS
    while blocks < MOST_BLOCKS and blocks * ENTRIES_A_BLOCK < listed.count():
        blocks *= 2
    host, path = host_and_path(F.col(url))
    own = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*own, host.alias("host"), path.alias("path"))
    hits, best = free_names(parsed.columns, "hits", "best")
    tested = with_possible_hits(parsed, bloom_blocks(listed, blocks), blocks, listed.select("length"), hits)
    # the same few lists of possible hits come again and again: each is looked up once
    distinct = tested.filter(F.size(hits) > 0).select(F.col(hits).alias("hits")).distinct()
    verified = (distinct.select("hits", F.explode("hits").alias("url"))
                .join(listed.hint("shuffle_hash"), "url")
                .groupBy("hits").agg(F.max(F.struct(F.length("url").alias("n"), "url", "verdict")).alias(best)))
    return tested.join(verified.select(F.col("hits").alias(hits), best), hits, "left").select(
        *own, "host", "path", F.col(f"{best}.url").alias("rule"),
        F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page url, by the listed rules; a page without a rule is allowed."""
    listing = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listing).drop("url")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM q)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
