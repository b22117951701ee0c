"""URL filters: a blocked Bloom filter before an exact join (operator 3).

Listed canonical URLs set bits in 512-bit blocks, eight 64-bit words of which each URL sets one bit a word. The filter
is a table of blocks; a page looks up its block, and only pages whose bits are all set go on to the hash join with the
listed URLs themselves, which removes false positives. Rules (host and path) overrule the list; the longest wins.

The block table is broadcast only if its size, known from the count of listed URLs, is at most ``BROADCAST_BYTES``;
beyond that it is joined by block. The exact join salts the pages' side, as one URL may hold many rows.

Defined cases: a null URL or one without :// has an empty host and path and is allowed; repeated rows are judged each;
an empty list allows all that no rule blocks; empty tables give empty results; other columns pass through, but for those
named host, path, rule and verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, fresh, salted_join, table

#: (host and path, verdict): fixed values of the query.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Domains whose pages the query lists.
LISTED_DOMAINS = ("ads-track.example.com", "spam-farm.example.org", "casino-win.example.net", "adult-x.example.com", "cheap-pills.example.net", "free-bets.example.net")
WORDS = 8
BITS_PER_URL = 12
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From the question mark on, up to a number sign; empty where nothing follows the mark."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]+)", 1), F.lit(""))


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host without user, port, last dot and a leading www., m. or blog., path without its last slash or .html, and the query; null without a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@|\.?(:[0-9]*)?$", ""), r"^(www|m|blog)\.", "")
    return F.when(host != "", F.concat(name, F.regexp_replace(path, r"(/|\.html)$", ""), query))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits; of equal length, the one with the longer host."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"))):
        name, slash, rest = rule.partition("/")
        tests.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def masks(bits: str) -> list[Column]:
    """One bit of each word, from the column ``bits``."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{bits}`, {6 * i}) & 63 as int))") for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0 ... w7 of the distinct ``canon`` values; blocks without a URL have no row."""
    keyed = listed.select(F.pmod(F.xxhash64("canon"), F.lit(blocks)).alias("block"), F.xxhash64("canon", F.lit(1)).alias("_bits"))
    keyed = keyed.select("block", *[mask.alias(f"w{i}") for i, mask in enumerate(masks("_bits"))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=(), url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. listed: a column of this name with the URLs to block."""
    made = ("host", "path", "rule", "verdict")
    of = lambda: canonical(host_of(F.col(url)), path_of(F.col(url)), query_of(F.col(url)))
    listed = cut(listed.select(of().alias("canon")).where("canon is not null").distinct())
    count = listed.count()
    blocks = max(1, -(-count * BITS_PER_URL // (64 * WORDS)))
    names = [c for c in pages.columns if c.lower() not in made]
    canon, block, bits, hit, found, own, *words = fresh(pages, "canon", "block", "bits", "hit", "listed", "own", *[f"w{i}" for i in range(WORDS)])
    table_ = bloom(listed, blocks).toDF(own, *words)
    small = blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES
    rows = pages.select(*[F.col(f"`{c}`") for c in names], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), of().alias(canon))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({block: F.coalesce(F.pmod(F.xxhash64(canon), F.lit(blocks)), F.lit(-1)), bits: F.xxhash64(canon, F.lit(1))})
    probe = rows.join(F.broadcast(table_) if small else table_, F.col(block) == F.col(own), "left")
    passed = F.lit(True)
    for word, mask in zip(words, masks(bits), strict=True):
        passed = passed & (F.col(word).bitwiseAND(mask) != 0)
    probe = cut(probe.withColumn(hit, F.coalesce(passed, F.lit(False))).drop(own, *words, block, bits))
    exact = salted_join(probe.where(F.col(hit)), listed.select(F.col("canon").alias(canon), F.lit(True).alias(found)), [canon], how="left")
    both = exact.unionByName(probe.where(~F.col(hit)).withColumn(found, F.lit(None).cast("boolean")))
    verdicts = F.coalesce(*[F.when(F.col("rule") == rule, F.lit(verdict)) for rule, verdict in rules], F.when(F.col(found), F.lit("block")).otherwise(F.lit("allow")))
    return both.withColumn("verdict", verdicts).drop(canon, hit, found)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: pages of six domains, by their own or a subdomain's host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = host_of(F.col("url"))
    on_list = F.lit(False)
    for domain in LISTED_DOMAINS:
        on_list = on_list | (host == domain) | host.endswith("." + domain)
    found = filter_urls(pages, pages.where(on_list).select("url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_url_filter": op3_url_filter}
ORACLE_SQL = {
    "op3_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]+)', 1), '') AS query
            FROM pages
        ), canon AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '(?s)^.*@|\\.?(:[0-9]*)?$', '', 'g'), '^(www|m|blog)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') || query END AS canon,
                   regexp_matches(host, '(^|\\.)(ads-track\\.example\\.com|spam-farm\\.example\\.org|casino-win\\.example\\.net|adult-x\\.example\\.com|cheap-pills\\.example\\.net|free-bets\\.example\\.net)$') AS on_list
            FROM parts
        ), rules(rule, name, start, verdict) AS (
            VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                   ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
        ), judged AS (
            SELECT c.*, (SELECT max_by({'rule': r.rule, 'verdict': r.verdict}, length(r.rule)) FROM rules r
                         WHERE (c.host = r.name OR ends_with(c.host, '.' || r.name)) AND starts_with(c.path, r.start)) AS best,
                   c.canon IN (SELECT l.canon FROM canon l WHERE l.on_list AND l.canon IS NOT NULL) AS listed
            FROM canon c
        )
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM judged
    """,
}
