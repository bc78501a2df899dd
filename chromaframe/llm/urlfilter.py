"""URL filtering with a blocked Bloom filter in front of an exact hash join.

The filter is a table: one row per block of 512 bits, held as eight long words, built with bit_or.
A URL's hash names its block and eight bits, one in each word, so a probe reads one row. Probing is
a join on the block number, and only the possible hits are joined with the listed URLs themselves.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

#: Bits of filter per listed URL; blocks are half as full as they could be, so about one probe in a few hundred is a false positive.
BITS_PER_URL = 16
BLOCK_BITS = 512
WORDS = BLOCK_BITS // 64
#: A filter is broadcast up to this many blocks (64 bytes each, 8 MB in all); beyond, the probe shuffles.
BROADCAST_BLOCKS = 1 << 17
#: Tasks that share the rows of one URL that many pages have.
SALTS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, with A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(text_of(url), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(text_of(url), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without www. or m. and default port, path without a closing slash, .html or index page, and the
    query without tracking parameters; the scheme and the fragment do not count. Null without a host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(text_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _mask(column: str, word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {6 * word}) & 63 as int))")


def bloom_blocks(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """block and w0 to w7 of the filter over the given column; blocks without a bit are left out."""
    keyed = listed.select(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block"), F.xxhash64(F.col(column), F.lit(1)).alias("_pick"))
    return keyed.groupBy("block").agg(*[F.bit_or(_mask("_pick", k)).alias(f"w{k}") for k in range(WORDS)])


def listed_hits(urls: DataFrame, column: str, listed: DataFrame, listed_column: str, result: str = "listed") -> DataFrame:
    """Adds a boolean column: whether the row's canonical URL is one of the listed ones. Nulls are not.

    The columns of urls stay as they are, whatever these are named.
    """
    block, pick, key, salt, hit, name, filter_block, hit_salt, *words = fresh(urls, "block", "pick", "key", "salt", "hit", "name", "filter_block", "hit_salt", *[f"w{k}" for k in range(WORDS)])
    names = listed.select(F.col(listed_column).alias(name)).where(F.col(name).isNotNull()).distinct()
    blocks = max(1, -(-names.count() * BITS_PER_URL // BLOCK_BITS))
    table = bloom_blocks(names, name, blocks).toDF(filter_block, *words)
    table = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    probed = urls.withColumn(block, F.pmod(F.xxhash64(column), F.lit(blocks))).withColumn(pick, F.xxhash64(F.col(column), F.lit(1)))
    probed = probed.join(table, F.col(block) == F.col(filter_block), "left")
    possible = F.lit(True)
    for k, word in enumerate(words):
        possible = possible & (F.col(word).bitwiseAND(_mask(pick, k)) != 0)
    # Only possible hits carry a key into the exact join; a URL that many pages share is looked up once, and its rows are
    # dealt over some tasks, as are those without a key.
    row = F.monotonically_increasing_id()
    probed = probed.withColumn(key, F.when(F.coalesce(possible, F.lit(False)), F.col(column))).withColumn(salt, F.when(F.col(key).isNull(), row).otherwise(F.pmod(row, F.lit(SALTS))))
    probed = probed.drop(block, pick, filter_block, *words)
    found = probed.select(key).where(F.col(key).isNotNull()).distinct().join(names, F.col(key) == F.col(name), "left_semi")
    found = found.select(F.col(key).alias(hit), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias(hit_salt))
    met = probed.join(found, (F.col(key) == F.col(hit)) & (F.col(salt) == F.col(hit_salt)), "left")
    return met.withColumn(result, F.col(hit).isNotNull()).drop(key, salt, hit, hit_salt)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, as host and path joined, and its verdict; both null if none fits.

    A rule fits its host and all subdomains where the URL's path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(at + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, listed_column: str, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A rule that fits decides; elsewhere a URL is blocked if its canonical form is listed. A null URL or
    one without :// has an empty host and path and is allowed. Repeated rows are each judged; columns of
    pages that are named like a result are replaced.
    """
    base = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "listed") if c != url_col])
    url, (canonical,) = F.col(url_col), fresh(base, "canonical")
    rows = listed_hits(base.withColumn(canonical, canonical_url(url)), canonical, listed, listed_column)
    rows = rows.drop(canonical).withColumn("host", url_host(url)).withColumn("path", url_path(url))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
