"""URL discovery: sitemaps and result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..session import checkpointed
from . import gate

# Markup that is looked for, the bound of sitemaps read, and the engine's own domains.
LOC = r"(?is)<loc>\s*([^<\s]+)\s*</loc>"
BLOCK = r"(?is)<(url|sitemap)\b.*?</\1>"
LASTMOD = r"(?is)<lastmod>\s*([^<\s]+)\s*</lastmod>"
ROBOTS = r"(?im)^\s*sitemap\s*:\s*(\S+)"
XML = r"(?i)<(?:urlset|sitemapindex)\b"
MAX_SITEMAPS = 20
RESULT = r"(?s)<h3 class=\"res-title[^\"]*\"[^>]*>\s*<a\s+href=\"[^\"]*\"\s+data-mdurl=\"([^\"]+)\"[^>]*>(.*?)</a>\s*</h3>"
#: Where words are asked for, and the title of a page of results.
SEARCH, RESULT_TITLE = "https://www.so.com/s", r"(?i)_360搜索\s*</title>"
OWN_DOMAINS = ("so.com", "360.com", "qhimg.com", "qhres.com", "haosou.com", "360kan.com", "bing.com")


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ROBOTS), F.lit(1))


def sitemap_rows(xml: DataFrame, text: str = "text", key: str = "url") -> DataFrame:
    """(sitemap, pos, loc, lastmod, child) of the entries of sitemaps; a sitemapindex has only children. No text, no rows."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(0))
    # What is said of the whole text is said before its entries are rows: beside the explode it would be read again for each of them.
    whole = xml.where(F.rlike(F.col(text), F.lit(XML))).select(F.col(key).alias("sitemap"), F.rlike(F.col(text), F.lit("(?i)<sitemapindex")).alias("index"), blocks.alias("blocks"))
    df = whole.select("sitemap", "index", F.posexplode("blocks").alias("pos", "block"))
    child = F.col("index") | F.rlike("block", F.lit("(?i)^<sitemap\\b"))
    out = df.select("sitemap", "pos", F.regexp_extract("block", LOC, 1).alias("loc"), F.regexp_extract("block", LASTMOD, 1).alias("lastmod"), child.alias("child"))
    return out.where("loc <> ''")


def top_entries(entries: DataFrame, match: str = "", since: str = "", limit: int = 20, order: str = "ord") -> DataFrame:
    """(url, lastmod, rank): newest first, ties as they came, undated last."""
    df = entries.where(F.rlike("url", F.lit(f"(?i){match}"))) if match else entries
    df = df.where((F.col("lastmod") != "") & (F.substring("lastmod", 1, 10) >= since)) if since else df
    best = df.orderBy(F.desc("lastmod"), order).limit(limit)
    return best.select("url", "lastmod", F.row_number().over(Window.orderBy(F.desc("lastmod"), order)).alias("rank"))


def locate(sites: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, url, ord) of the sitemaps with which each site begins, and (site, kind, detail) of sites without any.

    sites: (site), with or without scheme; fetched: (url, text, kind), kind being null where there is a text. Roots are
    tried in turn: the sitemaps that a root's robots.txt names, else its /sitemap.xml if that is one. Of a site without
    any the first refusal is told, else that there is none.
    """
    tried = sites.select("site", F.posexplode(U.roots(F.col("site"))).alias("r", "root"))
    files = tried.select("site", "r", "root", F.posexplode(F.array(F.lit("/robots.txt"), F.lit("/sitemap.xml"))).alias("f", "file")).withColumn("url", F.concat("root", "file"))
    got = files.join(fetched, "url", "left")
    declared = got.where("f = 0").select("site", "r", "f", F.posexplode(robots_sitemaps(F.col("text"))).alias("ord", "found"))
    plain = got.where((F.col("f") == 1) & F.rlike("text", F.lit(XML))).select("site", "r", "f", F.lit(0).alias("ord"), F.col("url").alias("found"))
    both = declared.unionByName(plain)
    best = both.groupBy("site").agg(F.min(F.struct("r", "f")).alias("b"))
    roots_ = both.join(best, "site").where((F.col("r") == F.col("b.r")) & (F.col("f") == F.col("b.f"))).select("site", F.col("found").alias("url"), "ord")
    refused = F.min_by("kind", F.when(F.col("kind") == "blocked", F.struct("r", "f")))
    lost = got.withColumn("kind", error_kind(F.col("kind"))).groupBy("site").agg(refused.alias("refused")).join(best, "site", "left_anti")
    errors = lost.select("site", F.coalesce("refused", F.lit("no_sitemap")).alias("kind"), F.when(F.col("refused").isNotNull(), "refused").otherwise("no sitemap found").alias("detail"))
    return roots_, errors


def expand(roots: DataFrame, edges: DataFrame, limit: int = MAX_SITEMAPS) -> DataFrame:
    """(site, url, n): by site the sitemaps in the order a queue reads them, the first ``limit``. roots: (site, url, ord); edges: (parent, child, pos).

    Level by level for all sites at once: children of a level that the site has not seen, each once, by (parent's place,
    position). A level has at most ``limit`` rows a site, and each is a checkpoint. Without a column site there is one.
    """
    one = "site" not in roots.columns
    if one:
        roots = roots.withColumn("site", F.lit(""))
    turn = Window.partitionBy("site")
    seen = roots.groupBy("site", "url").agg(F.min("ord").alias("ord")).select("site", "url", F.row_number().over(turn.orderBy("ord")).alias("n"), F.lit(0).alias("level")).where(F.col("n") <= limit)
    for level in range(1, limit):
        seen = checkpointed(seen)
        last = seen.where(F.col("level") == level - 1).select("site", F.col("url").alias("parent"), "n")
        new = last.join(edges, "parent").groupBy("site", F.col("child").alias("url")).agg(F.min(F.struct("n", "pos")).alias("at")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        have = seen.groupBy("site").agg(F.max("n").alias("have"))
        new = new.join(have, "site").select("site", "url", (F.col("have") + F.row_number().over(turn.orderBy("at"))).alias("n"), F.lit(level).alias("level")).where(F.col("n") <= limit)
        new = checkpointed(new)
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen.select(*(["url", "n"] if one else ["site", "url", "n"]))


def collect(sites: DataFrame, fetched: DataFrame, match: str = "", since: str = "", limit: int = 20, max_sitemaps: int = MAX_SITEMAPS) -> tuple[DataFrame, DataFrame]:
    """(site, url, lastmod, rank) of each site's newest entries, and (site, kind, detail) of what went wrong.

    Locating, expansion, parsing, filters and top-k in one: fetched (url, text, kind) holds robots.txt files and sitemaps.
    Of the sitemaps read, those without a text or that are no sitemap are errors; a site without results and without errors has the error no_match.
    """
    first, errors = locate(sites, fetched)
    # Read again by each level and by the results.
    rows = checkpointed(sitemap_rows(fetched))
    read = expand(first, rows.where("child").select(F.col("sitemap").alias("parent"), F.col("loc").alias("child"), "pos"), max_sitemaps)
    read = checkpointed(read)
    state = read.join(fetched, "url", "left")
    broken = state.where(~F.coalesce(F.rlike("text", F.lit(XML)), F.lit(False))).select("site", F.when(F.col("text").isNotNull(), "invalid_response").otherwise(error_kind(F.coalesce("kind", F.lit("http_error")))).alias("kind"), F.col("url").alias("detail"))
    entries = read.join(rows.where("NOT child"), F.col("url") == F.col("sitemap")).select("site", F.col("loc").alias("url"), "lastmod", "n", "pos")
    if match:
        entries = entries.where(F.rlike("url", F.lit(f"(?i){match}")))
    if since:
        entries = entries.where((F.col("lastmod") != "") & (F.substring("lastmod", 1, 10) >= since))
    newest = Window.partitionBy("site").orderBy(F.desc("lastmod"), "n", "pos")
    results = entries.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit).select("site", "url", "lastmod", "rank")
    errors = errors.unionByName(broken)
    empty = sites.select("site").join(results.select("site").distinct(), "site", "left_anti").join(errors.select("site").distinct(), "site", "left_anti")
    return results, errors.unionByName(empty.select("site", F.lit("no_match").alias("kind"), F.lit("no entry matches").alias("detail")))


def site_query(site: Column, words: Column) -> Column:
    """What a search engine is asked for: words within a site, if there is one."""
    return T.strip(F.concat_ws(" ", F.when(F.coalesce(site, F.lit("")) != "", F.concat(F.lit("site:"), site)), words))


def own_domain(url: Column) -> Column:
    h, out = U.host(url), F.lit(False)
    for d in OWN_DOMAINS:
        out = out | (h == d) | F.endswith(h, F.lit(f".{d}"))
    return F.coalesce(out, F.lit(False))


def result_hits(pages: DataFrame, html: str = "html", limit: int = 10, native: bool = False) -> DataFrame:
    """(query, title, url, rank) of the results of each page but the engine's own; ranks count those that stay."""
    pattern = F.lit(RESULT)
    hits = F.arrays_zip(F.regexp_extract_all(F.col(html), pattern, F.lit(1)).alias("url"), F.regexp_extract_all(F.col(html), pattern, F.lit(2)).alias("title"))
    df = pages.select("query", F.posexplode(hits).alias("pos", "x")).select("query", "pos", F.col("x.url").alias("url"), F.col("x.title").alias("raw"))
    text = T.strip(T.unescape_some(F.regexp_replace("raw", "<[^>]+>", ""))) if native else T.strip_tags(F.col("raw"))
    kept = df.where(~own_domain(F.col("url"))).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where(F.col("rank") <= limit)
    return kept.select("query", text.alias("title"), "url", "rank")


def by_words(asked: DataFrame, responses: DataFrame, limit: int = 10, native: bool = False) -> tuple[DataFrame, DataFrame]:
    """Discovery by words: (query, title, url, rank) of results, and (query, kind, detail) of queries without any.

    asked: (query, site, words); responses: captured responses to the addresses that search_url() gives. A page counts only if its title is
    that of results (an engine's refusal has another), else the next engine's answer is taken. A query that no engine
    answered is blocked, unreachable and so on by its last attempt; one with a page and no results of others is no_match; one without responses is invalid_response.
    """
    urls = asked.select("query", search_url(F.col("site"), F.col("words")).alias("url"))
    outcomes = gate.acquire(responses.join(urls.select("url").distinct(), "url", "left_semi"), expect=RESULT_TITLE)
    got = urls.join(outcomes, "url", "left")
    hits = result_hits(got.where("data IS NOT NULL").select("query", F.col("data").cast("string").alias("html")), limit=limit, native=native)
    failed = got.where("data IS NULL").select("query", error_kind(gate.last_kind(F.col("attempts"))).alias("kind"), F.coalesce("error", F.lit("no response")).alias("detail"))
    none = got.where("data IS NOT NULL").join(hits.select("query").distinct(), "query", "left_anti").select("query", F.lit("no_match").alias("kind"), F.lit("no results").alias("detail"))
    return hits, failed.unionByName(none)


def search_url(site: Column, words: Column) -> Column:
    """The address of a search within a site."""
    return F.concat(F.lit(f"{SEARCH}?"), U.query_string(q=site_query(site, words)))


def error_kind(kind: Column) -> Column:
    """An attempt's kind as discovery reports it."""
    return F.when(kind.isin("timeout", "network"), "network_unreachable").when(kind == "http_error", "http_error").when(kind.isin("challenge", "empty_body"), "blocked").otherwise("invalid_response")
