"""URL filters: path rules, then a blocked Bloom filter before an exact hash join (operator 6).

The listed canonical URLs, a table, fill a blocked Bloom filter: a key sets
eight bits of one 256-bit block, a row has a block's four words. A URL looks at
one block. The blocks are sent to the tasks, so that no URL moves for them, as
long as they are :data:`MOST_BLOCKS` at most; a longer list's blocks are joined
by their number. Only URLs that may be listed go on to an exact join on the
canonical URL, which removes the false positives; all others are done.

Rules ``(host, path, verdict)`` go first: a rule fits its host and all
subdomains if the path starts with the rule's; the longest rule wins.

Canonical URL: no scheme, host lower-cased without leading ``www.`` or ``m.``
and without port, path without trailing ``/`` or ``.html``, query without
``utm_*`` and ``ref`` parameters, no fragment.

Rows: a null URL, or one without ``://``, has empty host and path; no rule
fits it and it is allowed unless listed. Repeated rows each get a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD_FROM, FOLD_TO, cut, fresh, tidy

#: Rules of the registered query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules that one call takes; each is an expression of the plan.
MOST_RULES = 1000
#: Host labels whose pages make up the list of the registered query.
LISTED_LABELS = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]
BITS_PER_KEY, BLOCK_BITS, BITS_SET = 16, 256, 8
#: Blocks (some 60 bytes each) that are sent to every task: the filter of four million listed URLs.
MOST_BLOCKS = 1 << 18


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), FOLD_FROM[:26], FOLD_TO[:26]), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Canonical form of a URL (see the module's text)."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":\d*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: str) -> Column:
    """Text (``what="rule"``) or verdict of the longest rule that fits; null without."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(rule_host + rule_path if what == "rule" else verdict)).otherwise(out)
    return out


def _positions(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(BITS_SET)]


def _words(h: Column) -> list[Column]:
    """The four words of a key's bits."""
    out = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for at in _positions(h):
            # the shift of a long takes the low six bits of its count
            word = word.bitwiseOR(F.when(F.shiftright(at, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def bloom_blocks(keys: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """``keys(key)`` -> rows ``(block, w0..w3)`` of the filter, and its count of blocks."""
    blocks = 1
    while blocks * BLOCK_BITS < n * bits_per_key:
        blocks *= 2
    h = F.xxhash64("key", F.lit("bits"))
    rows = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(h))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_BITS // 64)]), blocks


@tidy("url-verdicts")
def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", bits_per_key: int = BITS_PER_KEY, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``pages(page_id, url)``, ``listed(url)`` -> ``page_id, host, path, rule, verdict, listed, maybe`` (whether the filter let it pass)."""
    keys = cut(listed.select(canonical(F.col(listed.columns[0]).cast("string")).alias("key")).where("key <> ''").distinct(), "url-list")
    filter_, blocks = bloom_blocks(keys, keys.count(), bits_per_key)
    filter_ = cut(filter_, "url-bloom").withColumnRenamed("block", "of")
    address = F.col(url).cast("string")
    p = pages.select(F.col(key).alias("key"), host_of(address).alias("host"), path_of(address).alias("path"), F.coalesce(canonical(address), F.lit("")).alias("canon"))
    if blocks <= most_blocks:
        block, filter_ = F.pmod(F.xxhash64("canon"), F.lit(blocks)), F.broadcast(filter_)
    else:
        # an address without a canonical form is in no list: dealt out by its host and path, not to one block
        block = F.when(F.col("canon") == "", -1 - F.pmod(F.xxhash64("key", "path"), F.lit(1 << 30))).otherwise(F.pmod(F.xxhash64("canon"), F.lit(blocks)))
    looked = p.join(filter_, block == F.col("of"), "left")
    hit = F.col("of").isNotNull() & (F.col("canon") != "")
    for i, w in enumerate(_words(F.xxhash64("canon", F.lit("bits")))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(w) == w)
    # without the pages' other columns these rows are small; written once, no address is judged again for the second branch
    looked = cut(looked.select("key", "host", "path", F.when(F.coalesce(hit, F.lit(False)), F.col("canon")).alias("canon")), "url-looked")
    sure = looked.where("canon is not null").join(keys.select(F.col("key").alias("canon"), F.lit(True).alias("exact")), "canon", "left")
    passed = sure.select("key", "host", "path", F.coalesce("exact", F.lit(False)).alias("listed"), F.lit(True).alias("maybe"))
    both = looked.where("canon is null").select("key", "host", "path", F.lit(False).alias("listed"), F.lit(False).alias("maybe")).unionAll(passed)
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(host, path, rules, "verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select(F.col("key").alias(key), "host", "path", rule_of(host, path, rules, "rule").alias("rule"), verdict.alias("verdict"), "listed", "maybe")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Rows of ``pages`` whose URL is allowed; columns unchanged."""
    (bad_url,) = fresh(pages, "bad")
    urls = pages.select(F.col(url).cast("string").alias("u")).distinct()
    bad = judge(urls, listed, rules, "u", "u").where("verdict = 'block'").select(F.col("u").alias(bad_url))
    return pages.join(bad, F.col(url).cast("string") == F.col(bad_url), "left_anti")


def listed_urls(pages: DataFrame, labels: list[str] = LISTED_LABELS) -> DataFrame:
    """URLs of ``pages`` on hosts with a listed label: the list of the registered query."""
    on = F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*[F.lit(x) for x in labels]))
    return pages.where(on).select("url")


#: The registered query in DuckDB.
ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM a),
c AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  list_has_any(string_split(host, '.'), ['ads-track', 'spam-farm', 'casino-win', 'adult-x', 'cheap-pills', 'free-bets']) AS listed FROM b)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM c
"""
