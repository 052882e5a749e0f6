"""URL filters: pattern rules indexed by their rarest literal token.

Every rule (a host-and-path rule or a regular expression) names literal tokens that any URL it fits must hold. The
number of URLs that hold each of these tokens is counted over the whole table; each rule is filed under the rarest of
its tokens. A URL's own tokens fetch the rules filed under them, and only these rules run their regular expressions. A
rule without a token is filed under the empty token, which every URL is taken to hold.

Native, for any number of rules: the index is a table, written out, so that its size is known. Distinct hosts and paths
are cut into tokens, these are joined with the index (Spark broadcasts it if it is small, and shuffles by token, splitting
frequent ones, if not), and the best fitting rule of each host and path is joined back. URLs that fetch no rule that fits are in
no shuffle but the last join's.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and the default verdict; very long URLs are
cut into tokens whole; repeated rows are judged each; of rules of equal rank the last in order of name wins; an empty table gives an empty result, and no rules give
the default verdict; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RULE_TABLE = "name string, verdict string, pattern string, tokens array<string>, rank long, listed boolean"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # over host + path, matched from its first character
    tokens: tuple[str, ...]  # literal tokens, each present in whatever the pattern fits
    rank: int  # among fitting rules the highest rank wins
    listed: bool  # a host-and-path rule, reported by name


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))


def host_rule(verdict: str, rule: str) -> Rule:
    """``example.net/en/``: the host and its subdomains, paths that begin with ``/en/``. Longer rules outrank shorter ones."""
    host, _, path = rule.partition("/")
    # A path prefix may end within a URL's token, so that only its complete tokens are literal.
    whole = host if path == "" else f"{host}/{path[: len(path) - len(re.search(r'[A-Za-z0-9]*$', path)[0])]}"
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?\Q{host}\E\Q/{path}\E", tokens_of(whole), 1_000_000 + len(rule), True)


def label_rule(word: str) -> Rule:
    """Blocks hosts one of whose labels has the word as a hyphenated part."""
    return Rule(f"*{word}*", "block", rf"^(?:[^/]*\.)?(?:[^./]*-)?{word}(?:-[^./]*)?(?:[./:]|$)", (word,), len(word), False)


RULES = [host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/")]
#: Words of hosts that offer gambling, adult content, drugs, advertising or link farms.
BLOCKED_WORDS = "adult ads adserver bet bets betting casino escort malware phishing pills poker porn sex slots spam tracker viagra warez xxx".split()
#: (pattern over host and path, literal tokens): pages that hold forms, files or lists rather than text, wherever they are.
BLOCKED_PATHS = [
    (r"^[^/]*/(?:.*/)?wp-login\.php$", ("wp", "login", "php")),
    (r"^[^/]*/(?:.*/)?xmlrpc\.php$", ("xmlrpc", "php")),
    (r"^[^/]*/cgi-bin/", ("cgi", "bin")),
    (r"^[^/]*/(?:.*/)?tag/[^/]+/page/[0-9]+/?$", ("tag", "page")),
    (r"^[^/]*/(?:.*/)?(?:cart|basket)/checkout(?:/|$)", ("checkout",)),
    (r"^[^/]*/.*\.zip$", ("zip",)),
    (r"^[^/]*/.*\.tar\.gz$", ("tar", "gz")),
]
PATTERNS = [label_rule(w) for w in BLOCKED_WORDS] + [Rule(p, "block", p, tokens, 100 + len(p), False) for p, tokens in BLOCKED_PATHS]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(F.concat(host, path), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return C.table_of(spark, [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank, r.listed) for r in rules], RULE_TABLE)


def build_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rank, name, verdict, pattern, listed): each rule filed under the rarest of its tokens, by counts over all rows of urls (host, path)."""
    spark = urls.sparkSession
    each = rules.withColumn("no", F.monotonically_increasing_id()).withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    each, path = C.write_out(spark, each, "url-rules")
    have = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = have.join(each.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "token", "left").groupBy("no").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    filed, _ = C.write_out(spark, each.drop("token", "tokens").dropDuplicates(["no"]).join(rarest, "no").select("token", "rank", "name", "verdict", "pattern", "listed"), "url-index")
    C.drop_path(spark, path)
    return filed


def url_filter(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, default: str = "allow", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) per row of pages; rule is the winning host rule, pattern whatever decided.

    rules: a list, or a table of RULE_TABLE's columns for long ones; RULES and PATTERNS by default.
    """
    rules = RULES + PATTERNS if rules is None else rules
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    host, path = parts(F.col(url))
    df = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    filed = build_index(df, table)
    own = url_tokens(F.col("host"), F.col("path"))
    if filed.where("token = ''").limit(1).count():
        own = F.concat(F.array(F.lit("")), own)
    some, bare = df.where("host <> '' OR path <> ''"), df.where("host = '' AND path = ''")
    fetched = some.select("host", "path").distinct().withColumn("token", F.explode(own)).join(filed, "token")
    fits = fetched.where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", "name", "verdict", "listed")).alias("best"))
    # Rows without a URL have no rule, and would be one key of the join.
    judged = some.join(best, ["host", "path"], "left").unionByName(bare.withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return judged.select("page_id", "host", "path", F.when(F.col("best.listed"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.name").alias("pattern"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_WORDS = "|".join(BLOCKED_WORDS)
_PATHS = ", ".join(f"('{p}', {100 + len(p)})" for p, _ in BLOCKED_PATHS)
OP5_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(name, rank, fit) AS (SELECT '*' || w || '*', length(w), '^([^/]*\.)?([^./]*-)?' || w || '(-[^./]*)?([./:]|$)' FROM unnest(string_split('{_WORDS}', '|')) t(w) UNION ALL SELECT p, n, p FROM (VALUES {_PATHS}) v(p, n)),
c AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
  (SELECT max((rank, name)) FROM r WHERE host || path <> '' AND regexp_matches(host || path, fit)) AS best FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN best IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(rule, best[2]) AS pattern FROM c
"""
