"""The registered queries and the SQL they are checked with.

The test tables hold no captured responses, sitemaps, result pages or decks, so queries derive such relations from
pages, documents and parts, by the same rule here and in SQL. Where a rule is one that both engines read alike, it is
written once, as SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cardlines
from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..operators import deck, diagnose, discover, domains, frames, gate, keywords, pages, policy, rollup, temporal
from ..session import scratch, table
from ..sources import decks, dims, writer
from ..sources import slides as slide_source
from ..streaming import acquire as stream
from ..streaming import ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


WS = r"[\s\p{Z}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_unescape(x: str) -> str:
    return rf"""regexp_replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')"""


_SKIP = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "nav", "footer", "header", "noscript"))
SQL_TEXT = rf"""array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(html, '(?is)<!--.*?-->|{_SKIP}', '<>', 'g'), '<[^>]*>'), lambda x: {sql_strip(sql_unescape('x'))}), lambda x: x <> ''), chr(10))"""
SQL_TITLE = rf"""{sql_strip(sql_unescape("regexp_replace(CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) ELSE regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) END, '<[^>]+>', '', 'g')"))}"""


def sql_truncate(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || chr(10) || chr(10) || '[... 截断，原文共 ' || length({x}) || ' 字符 ...]' ELSE {x} END"


def shared(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    """A relation that both engines derive by the same SQL."""
    for t in tables:
        table(spark, sf, t).createOrReplaceTempView(f"sluiceway_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM sluiceway_{t}")
    return spark.sql(sql)


# --- pages ---------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {SQL_TEXT} AS text FROM pages")
def page_clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.clean_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {SQL_TEXT} AS text FROM pages")
def page_parsed_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.parse_page(F.col("html"))["text"].alias("text"))


@query(f"""WITH t AS (SELECT page_id, url, {SQL_TITLE} AS title, {SQL_TEXT} AS w FROM pages), n AS (SELECT *, length(w) >= 200 AS ok FROM t)
SELECT page_id, url, 'html' AS type, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN CAST(length(w) AS INTEGER) END AS length, CASE WHEN ok AND length(w) > 8000 THEN true END AS truncated,
CASE WHEN ok THEN {sql_truncate('w', 8000)} END AS text, CASE WHEN NOT ok THEN 'body too short' END AS error FROM n""")
def page_clean_record(spark, sf):
    return pages.clean_records(table(spark, sf, "pages"))


@query(f"SELECT doc_id, CAST(length(text) AS INTEGER) AS length, {sql_truncate('text', 8000)} AS text FROM documents")
def document_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("length"), T.truncate(F.col("text"), 8000).alias("text"))


SQL_LINKS = rf"""WITH a AS (SELECT page_id, url AS base, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
b AS (SELECT page_id, base, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS text FROM a),
c AS (SELECT page_id, pos, regexp_extract(base, '^([a-zA-Z]+://[^/?#]+)', 1) || {sql_unescape('href')} AS url, trim(regexp_replace({sql_unescape('text')}, '{WS}+', ' ', 'g')) AS text FROM b),
d AS (SELECT page_id, url, min(pos) AS pos, coalesce(arg_min(text, pos) FILTER (text <> ''), '') AS text FROM c GROUP BY ALL)
SELECT page_id, url, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS rank FROM d WHERE text <> ''"""


@query(SQL_LINKS)
def page_links(spark, sf):
    return pages.numbered(pages.split_links(pages.resolve(pages.raw_links(table(spark, sf, "pages"))))[1])


_ATTACHED = """SELECT page_id, url, concat('<a href="/d/', page_id, '.pdf">Report ', page_id, '</a><a href="b', page_id, '.OFD?x=1"></a><a href="/p/1.html">Page</a><a href="/d/', page_id, '.pdf">again</a><a href="https://other.org/', page_id, '.docx"><img alt="Form"></a><a href="mailto:x@y.z">m</a><a href="b', page_id, '.OFD?x=1">late</a>') AS html FROM pages"""
SQL_ATTACHMENTS = """WITH a AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS root, regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '') AS dir FROM pages),
l AS (SELECT page_id, 1 AS rank, root || '/d/' || page_id || '.pdf' AS url, 'pdf' AS ext, 'Report ' || page_id AS text FROM a UNION ALL SELECT page_id, 2, dir || 'b' || page_id || '.OFD?x=1', 'ofd', 'late' FROM a UNION ALL SELECT page_id, 3, 'https://other.org/' || page_id || '.docx', 'docx', 'Form' FROM a)"""


def attached(spark, sf):
    return pages.split_links(pages.resolve(pages.raw_links(shared(spark, sf, _ATTACHED, "pages"), native=False)))


@query(SQL_ATTACHMENTS + " SELECT * FROM l")
def attachment_links(spark, sf):
    return pages.numbered(attached(spark, sf)[0]).select("page_id", "rank", "url", "ext", "text")


@query(SQL_ATTACHMENTS + " SELECT page_id, count(*) AS attachments_total, CAST(1 AS BIGINT) AS pages_total, string_agg(url, ' ' ORDER BY rank) FILTER (rank <= 2) AS attachments, 'Page' AS pages FROM l GROUP BY page_id")
def diagnose_links(spark, sf):
    lists = diagnose.link_lists(*attached(spark, sf), most=2)
    return lists.select("page_id", "attachments_total", "pages_total", F.array_join(F.transform("attachments", lambda x: x["url"]), " ").alias("attachments"), F.array_join(F.transform("pages", lambda x: x["text"]), " ").alias("pages"))


@query(SQL_ATTACHMENTS + " SELECT page_id, count(*) AS matched, arg_min(url, rank) AS url, arg_min(text, rank) AS text FROM l WHERE regexp_matches(text, '(?i)REPORT .*7|form') GROUP BY page_id")
def diagnose_target(spark, sf):
    return diagnose.target(attached(spark, sf)[0], "REPORT .*7|form")


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN h LIKE 'www.%' THEN [s || '://' || h] ELSE [s || '://' || h, s || '://www.' || h] END AS roots FROM a""")
def host_roots(spark, sf):
    scheme = F.regexp_extract("url", "^(https?)://", 1)
    return table(spark, sf, "pages").select("page_id", U.roots(F.concat(scheme, F.lit("://"), U.host(F.col("url")))).alias("roots"))


# --- responses -----------------------------------------------------------------------------------------------

_BODY = "CASE {m} WHEN 1 THEN left(html, 300) WHEN 2 THEN concat('<title>Just a moment</title>', html) WHEN 5 THEN concat('%PDF-1.7 ', html) ELSE html END"
_STATUS = "CASE {m} WHEN 3 THEN 404 WHEN 4 THEN 412 WHEN 6 THEN 0 ELSE 200 END"
_URL = "CASE {m} WHEN 7 THEN concat(split_part(url, '?', 1), '.pdf') ELSE url END"
_CTYPE = "CASE {m} WHEN 5 THEN 'application/pdf' ELSE 'text/html' END"


def responses_sql(engine: str, m: str) -> str:
    """Responses of an engine, spoiled in turn by the page's number."""
    f = lambda x: x.format(m=m)
    return f"SELECT page_id, {f(_URL)} AS url, '{engine}' AS engine, CAST({f(_STATUS)} AS INT) AS status, encode({f(_BODY)}{{utf8}}) AS data, {f(_CTYPE)} AS content_type FROM pages"


def responses(spark, sf: str, engine: str, m: str) -> DataFrame:
    return spark.sql(responses_sql(engine, m).format(utf8=", 'UTF-8'").replace("FROM pages", "FROM {pages}"), pages=table(spark, sf, "pages"))


SQL_VERDICT = """CASE WHEN status <> 0 AND status >= 400 THEN 'http_error' WHEN content_type LIKE '%pdf%' OR starts_with(decode(data), '%PDF-') THEN NULL
WHEN lower(split_part(url, '?', 1)) LIKE '%.pdf' THEN 'wrong_content_type' WHEN octet_length(data) < 500 THEN 'empty_body' WHEN contains(left(decode(data), 4096), 'Just a moment') THEN 'challenge' END"""


@query(f"SELECT page_id, {SQL_VERDICT} AS verdict FROM ({responses_sql('http', 'page_id % 8').format(utf8='')})")
def response_verdict(spark, sf):
    r = responses(spark, sf, "http", "page_id % 8")
    return r.select("page_id", gate.verdict(F.col("status"), F.col("data"), F.col("content_type"), F.col("url")).alias("verdict"))


@query("""WITH a AS (SELECT page_id, CAST([200, 403, 404, 410, 412, 429, 500, 503][page_id % 8 + 1] AS INTEGER) AS status, page_id % 3 > 0 AS passed FROM pages)
SELECT page_id, CASE WHEN NOT passed THEN status WHEN status >= 400 AND status NOT IN (403, 412, 429, 503) THEN status ELSE 200 END AS final FROM a""")
def status_launder(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.element_at(F.array(*map(F.lit, (200, 403, 404, 410, 412, 429, 500, 503))), (F.col("page_id") % 8 + 1).cast("int")).alias("status"), (F.col("page_id") % 3 > 0).alias("passed"))
    return df.select("page_id", gate.launder(F.col("status"), F.col("passed")).alias("final"))


SQL_ACQUIRE = f"""WITH h AS ({responses_sql('http', 'page_id % 8').format(utf8='')}), b0 AS ({responses_sql('browser', 'page_id % 5').format(utf8='')}),
b AS (SELECT b0.page_id, h.url, b0.engine, b0.status, b0.data, b0.content_type FROM b0 JOIN h USING (page_id)), r AS (SELECT *, 1 AS k FROM h UNION ALL SELECT *, 2 FROM b),
v AS (SELECT *, {SQL_VERDICT} AS kind FROM r), d AS (SELECT *, CASE WHEN kind = 'http_error' THEN 'HTTP ' || status ELSE kind END AS detail FROM v),
g AS (SELECT url, min(k) FILTER (kind IS NULL) AS won, string_agg(detail, '；' ORDER BY k) FILTER (kind IS NOT NULL) AS details, arg_min(engine, k) FILTER (kind IS NULL) AS engine_used, arg_min(octet_length(data), k) FILTER (kind IS NULL) AS n,
 count(*) FILTER (kind IS NOT NULL) AS bad, bool_or(k = 1 AND kind IS NOT NULL) AS first_bad FROM d GROUP BY url)"""


def asked_in_turn(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The responses of each engine. A page is a visit of its url, of which there may be several."""
    h = responses(spark, sf, "http", "page_id % 8")
    return h, responses(spark, sf, "browser", "page_id % 5").drop("url").join(h.select("page_id", "url"), "page_id").select(h.columns)


def outcomes(spark, sf):
    h, b = asked_in_turn(spark, sf)
    return gate.acquire(h.unionByName(b), visit="page_id")


@query(SQL_ACQUIRE + " SELECT url, engine_used, CASE WHEN won IS NOT NULL THEN 200 END AS status, n AS bytes, CASE WHEN won = 2 THEN 1 WHEN won IS NULL THEN 2 ELSE 0 END AS failed, CASE WHEN won IS NULL THEN details END AS error FROM g")
def tiered_acquire(spark, sf):
    return outcomes(spark, sf).select("url", "engine_used", "status", F.octet_length("data").cast("long").alias("bytes"), gate.engines_failed(F.col("attempts")).alias("failed"), "error")


@query(SQL_ACQUIRE + " SELECT count(*) AS total, count(won) AS succeeded, count(*) FILTER (won = 2) AS degraded, CAST(sum(coalesce(n, 0)) AS BIGINT) AS length FROM g")
def fetch_summary(spark, sf):
    return gate.summary(outcomes(spark, sf))


@query(f"SELECT page_id, url, octet_length(encode(html)) AS bytes, {SQL_TITLE} AS title, CAST(length({SQL_TEXT}) AS INTEGER) AS text_len, regexp_matches(html, 'Just a moment') AS challenge FROM pages")
def diagnose_probe(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"), H.title(F.col("html")).alias("title"), F.length(H.clean_text(F.col("html"))).alias("text_len"), F.rlike("html", F.lit(gate.CHALLENGE)).alias("challenge"))


@query(SQL_ACQUIRE + f""", w AS (SELECT d.url, d.engine, d.data, d.content_type, won FROM d JOIN g USING (url) WHERE k = won), p AS (SELECT g.url, g.engine_used, w.content_type, g.won, details, content_type LIKE '%pdf%' OR starts_with(decode(data), '%PDF-') AS pdf, decode(data) AS t FROM g LEFT JOIN w USING (url))
SELECT url, engine_used, CASE WHEN won IS NOT NULL THEN 200 END AS status, content_type, CASE WHEN won IS NULL OR won = 2 THEN true END AS degraded, CASE WHEN won IS NOT NULL AND NOT pdf THEN CAST(length(t) AS INTEGER) END AS length, CASE WHEN won IS NOT NULL AND NOT pdf THEN t END AS raw, CASE WHEN won IS NULL THEN details WHEN pdf THEN 'a PDF has no raw text' END AS error FROM p""")
def raw_record(spark, sf):
    h, b = asked_in_turn(spark, sf)
    return pages.fetch(gate.captures(outcomes(spark, sf), h.unionByName(b)), raw=True)


@query(SQL_ACQUIRE + " SELECT url, arg_max(kind, k) AS kind, details AS error, count(*) AS attempts FROM d JOIN g USING (url) WHERE won IS NULL GROUP BY url, details")
def acquire_failures(spark, sf):
    return gate.failures(outcomes(spark, sf)).withColumn("attempts", F.size("attempts").cast("long"))


@query(f"""WITH r AS ({responses_sql('http', 'page_id % 8').format(utf8='')}) SELECT engine, coalesce(verdict, 'pass') AS verdict, count(*) AS n, CAST(sum(octet_length(data)) AS BIGINT) AS bytes FROM (SELECT *, {SQL_VERDICT} AS verdict FROM r) GROUP BY ALL""")
def diagnose_report(spark, sf):
    return diagnose.report(diagnose.describe(responses(spark, sf, "http", "page_id % 8")))


_MESSAGE = "SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'Page.goto: Download is starting ' WHEN 1 THEN 'net::ERR_ABORTED at ' WHEN 2 THEN 'Timeout 30000ms exceeded ' ELSE 'net::ERR_FAILED ' END, doc_id) AS message FROM documents"


@query(f"SELECT doc_id, doc_id % 4 < 2 AS download FROM ({_MESSAGE})")
def download_messages(spark, sf):
    return shared(spark, sf, _MESSAGE, "documents").select("doc_id", gate.is_download(F.col("message")).alias("download"))


_SAID = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('site', doc_id % 9, '.org') END AS site, concat('energy ', doc_id, ' report') AS words, concat(' a', doc_id, ', ,b c,, d') AS list, concat(doc_id % 5, ', ', doc_id % 7, '-', doc_id % 7 + 3, ',x,9-2') AS spec FROM documents"


@query(f"SELECT doc_id, 'https://s.org/s?q=' || CASE WHEN site = '' THEN '' ELSE 'site%3A' || site || '+' END || replace(words, ' ', '+') AS url, 'a' || doc_id || '|b|c|d' AS words, array_to_string(list_sort(list_distinct(list_filter(list_concat([doc_id % 5], range(doc_id % 7, doc_id % 7 + 4)), lambda x: x BETWEEN 1 AND 6))), ',') AS pages FROM ({_SAID})")
def query_parts(spark, sf):
    d = shared(spark, sf, _SAID, "documents")
    return d.select("doc_id", diagnose.query_url("https://s.org/s", F.col("site"), F.col("words")).alias("url"), F.array_join(T.words(F.col("list")), "|").alias("words"), F.array_join(T.page_numbers(F.col("spec"), F.lit(6)), ",").alias("pages"))


# --- discovery -----------------------------------------------------------------------------------------------

_LASTMOD = "CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('2024-0', CAST(page_id % 9 + 1 AS STRING), '-1', CAST(page_id % 7 AS STRING)) END"


@query(f"""WITH a AS (SELECT url, {_LASTMOD} AS lastmod, page_id AS ord FROM pages WHERE regexp_matches(url, '(?i)/(en|de)/')), b AS (SELECT *, row_number() OVER (ORDER BY lastmod DESC, ord) AS r FROM a WHERE lastmod <> '' AND left(lastmod, 10) >= '2024-03-01')
SELECT url, lastmod, CAST(r AS INTEGER) AS rank FROM b WHERE r <= 20""")
def sitemap_topk(spark, sf):
    df = table(spark, sf, "pages").select("url", F.expr(_LASTMOD).alias("lastmod"), F.col("page_id").alias("ord"))
    return discover.top_entries(df, "/(en|de)/", "2024-03-01")


_ENTRY = "concat('<url><loc> ', url, ' </loc>', CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<lastmod>', " + _LASTMOD + ", '</lastmod>') END, '</url>')"


@query(f"SELECT CAST(page_id // 50 AS BIGINT) AS sitemap, url AS loc, CASE WHEN page_id % 3 = 0 THEN '' ELSE {_LASTMOD} END AS lastmod, false AS child FROM pages WHERE regexp_matches(url, '^[^<[:space:]]+$')")
def sitemap_entries(spark, sf):
    # One document for fifty pages, as many as there are.
    e = table(spark, sf, "pages").select(F.expr("page_id DIV 50").alias("sitemap"), "page_id", F.expr(_ENTRY).alias("e"))
    xml = e.groupBy("sitemap").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), "\n"), F.lit("</urlset>")).alias("text"))
    return discover.sitemap_rows(xml, "text", "sitemap").select("sitemap", "loc", "lastmod", "child")


@query("""WITH RECURSIVE e AS (SELECT page_id AS p, c, pos FROM (SELECT page_id, unnest([page_id * 2 + 1, page_id * 2 + 2, page_id // 3]) AS c, unnest([0, 1, 2]) AS pos FROM pages)),
w AS (SELECT CAST(0 AS BIGINT) AS u, 0 AS d, '' AS path UNION ALL SELECT e.c, d + 1, path || lpad(CAST(pos AS VARCHAR), 2, '0') FROM w JOIN e ON e.p = w.u WHERE d < 6),
f AS (SELECT u, min((d, path)) AS o FROM w GROUP BY u), n AS (SELECT u, row_number() OVER (ORDER BY o) AS n FROM f) SELECT CAST(u AS VARCHAR) AS url, CAST(n AS INTEGER) AS n FROM n WHERE n <= 20""")
def sitemap_bfs(spark, sf):
    p = table(spark, sf, "pages")
    kids = F.array(*[F.struct(c.cast("string").alias("child"), F.lit(k).alias("pos")) for k, c in enumerate((F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.floor(F.col("page_id") / 3)))])
    edges = p.select(F.col("page_id").cast("string").alias("parent"), F.explode(kids).alias("x")).select("parent", "x.*")
    return discover.expand(spark.createDataFrame([("0", 0)], "url string, ord int"), edges)


_HIT = """concat('<h3 class="res-title "><a href="/r" data-mdurl="', CASE WHEN page_id % 4 = 0 THEN concat('https://www.so.com/', CAST(page_id AS STRING)) ELSE url END, '" x><em>Hit</em> ', CAST(page_id AS STRING), '&amp;</a></h3>')"""


@query("""WITH a AS (SELECT page_id // 20 AS query, page_id, url, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS rank FROM pages WHERE page_id % 4 <> 0)
SELECT query, 'Hit ' || page_id || '&' AS title, url, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 10""")
def serp_hits(spark, sf):
    p = table(spark, sf, "pages").select(F.expr("page_id DIV 20").alias("query"), F.struct("page_id", F.expr(_HIT).alias("h")).alias("s"))
    html = p.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["h"]), "\n").alias("html"))
    return discover.result_hits(html)


#: Sites are the pages' hosts, of three kinds: with an index that robots.txt names (and another that doesn't answer), with /sitemap.xml alone, with nothing but a refusal.
_SITES = "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, min(page_id) % 3 AS k, min(page_id) AS first FROM pages GROUP BY 1"


def sitemap_files(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "pages").withColumn("site", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    sites = p.groupBy("site").agg(F.min("page_id").alias("first")).withColumn("k", F.col("first") % 3)
    each = F.struct("page_id", F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"), F.expr(_LASTMOD), F.lit("</lastmod></url>")).alias("e"))
    # A site's entries in one sitemap, as in the wild; a sitemap has fifty thousand at most.
    lists = p.groupBy("site").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["e"]), ""), F.lit("</urlset>")).alias("xml"))
    root = F.concat(F.lit("https://"), "site")
    file = lambda df, path, text, kind=None: df.select(F.concat(root, F.lit(path)).alias("url"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(kind).cast("string").alias("kind"))
    named = sites.where("k = 0")
    robots = file(named, "/robots.txt", F.concat(F.lit("User-agent: *\nSitemap: "), root, F.lit("/a.xml\nsitemap : "), root, F.lit("/gone.xml\n")))
    index = file(named, "/a.xml", F.concat(F.lit("<sitemapindex><sitemap><loc>"), root, F.lit("/b.xml</loc></sitemap><sitemap><loc>"), root, F.lit("/a.xml</loc></sitemap></sitemapindex>")))
    own = lambda k, path: file(lists.join(sites.where(F.col("k") == k).select("site"), "site", "left_semi"), path, F.col("xml"))
    refused = file(sites.where("k = 2 AND first % 2 = 0"), "/robots.txt", F.lit(None).cast("string"), "challenge")
    fetched = robots.unionByName(index).unionByName(own(0, "/b.xml")).unionByName(own(1, "/sitemap.xml")).unionByName(refused)
    return sites.select("site"), fetched


@query(f"""WITH s AS ({_SITES}), e AS (SELECT site, url, {_LASTMOD} AS lastmod, page_id FROM pages JOIN s ON site = regexp_extract(url, '^https?://([^/?#]+)', 1) WHERE k < 2 AND regexp_matches(url, '(?i)/(en|de|fr)/')),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY lastmod DESC, page_id) AS rank FROM e WHERE lastmod >= '2024-02-01') SELECT site, url, lastmod, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def sitemap_discovery(spark, sf):
    return discover.collect(*sitemap_files(spark, sf), "/(en|de|fr)/", "2024-02-01", 3)[0]


@query(f"""WITH s AS ({_SITES}) SELECT site, CASE WHEN k = 0 THEN 'http_error' WHEN first % 2 = 0 THEN 'blocked' ELSE 'no_sitemap' END AS kind, CASE WHEN k = 0 THEN 'https://' || site || '/gone.xml' WHEN first % 2 = 0 THEN 'refused' ELSE 'no sitemap found' END AS detail FROM s WHERE k <> 1
UNION ALL SELECT site, 'no_match', 'no entry matches' FROM s WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) = site AND regexp_matches(url, '(?i)/(en|de|fr)/') AND {_LASTMOD} >= '2024-02-01')""")
def sitemap_errors(spark, sf):
    return discover.collect(*sitemap_files(spark, sf), "/(en|de|fr)/", "2024-02-01", 3)[1]


# --- policies ------------------------------------------------------------------------------------------------


def library_raw(spark, sf):
    """JSON answers of fifty rows at most for each department from documents: title, url, time and publisher by rule."""
    d = table(spark, sf, "documents")
    keys = dims.departments(spark).select(F.col("code").alias("dept"), F.col("name").alias("dept_name"), "puborg_keys", F.row_number().over(_by("code")).alias("k"))
    row = F.struct(F.concat(F.lit("<em>T</em>"), F.col("doc_id").cast("string"), F.lit(" &amp; ")).alias("title"), F.when(F.col("doc_id") % 13 > 0, F.concat(F.lit("http://p/"), (F.col("doc_id") % 500).cast("string"))).alias("url"), F.when(F.col("doc_id") % 17 > 0, F.lit(1700000000000) + F.col("doc_id") * 3600000).alias("pubtime"), F.element_at(F.array(*map(F.lit, ("发展改革委办公厅", "应急管理部", "其他"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("puborg"), F.lit("c").alias("pcode"))
    some = d.select((F.col("doc_id") % 8 + 1).alias("k"), F.expr("doc_id DIV 400").alias("ord"), F.col("doc_id"), row.alias("row"))
    raw = some.groupBy("k", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "row"))), lambda x: x["row"]).alias("l"))
    return raw.join(F.broadcast(keys), "k").select("dept", "dept_name", "puborg_keys", "ord", F.to_json(F.struct(F.struct(F.col("l").alias("listVO")).alias("searchVO"))).alias("raw"))


def _by(col: str):
    from pyspark.sql import Window

    return Window.orderBy(col)


_VALUES = ", ".join(f"('{c}', '{n}', {k}, {('NULL' if not keys else repr(keys[0]))})" for k, (c, n, _, keys, *_) in enumerate(sorted(dims.DEPARTMENTS), 1))
SQL_LIBRARY = f"""WITH dep(dept, dept_name, k, key) AS (VALUES {_VALUES}), r AS (SELECT doc_id, doc_id % 8 + 1 AS k, 'T' || doc_id || ' &' AS title, CASE WHEN doc_id % 13 > 0 THEN 'http://p/' || doc_id % 500 END AS url,
CASE WHEN doc_id % 17 > 0 THEN 1700000000000 + doc_id * 3600000 END AS ms, ['发展改革委办公厅', '应急管理部', '其他'][doc_id % 3 + 1] AS puborg FROM documents),
f AS (SELECT *, CAST(make_timestamp(ms * 1000) AS DATE) AS day, row_number() OVER (PARTITION BY dept ORDER BY doc_id) AS n FROM r JOIN dep USING (k) WHERE url IS NOT NULL AND ms IS NOT NULL AND CAST(make_timestamp(ms * 1000) AS DATE) >= DATE '2023-11-20' - 7 AND (key IS NULL OR contains(puborg, key)))"""


@query(SQL_LIBRARY + " SELECT dept, dept_name, title, url, strftime(day, '%Y-%m-%d') AS date, puborg, 'c' AS pcode, 'policy_library' AS source_tier FROM f WHERE n <= 5")
def policy_library(spark, sf):
    return policy.library_candidates(library_raw(spark, sf), 5, "w", "2023-11-20").drop("pos")


def listing_raw(spark, sf):
    """Listing pages of one department, forty notices each."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("doc_id DIV 40").alias("ord"), F.concat(F.lit('<li><a href="/t2024010'), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit('.html" target="_blank"> Notice on '), F.element_at(F.array(*map(F.lit, ("safety", "energy", "prices"))), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(" "), F.col("doc_id").cast("string"), F.lit(" </a></li>")).alias("h"))
    html = d.groupBy("ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), "\n").alias("raw"))
    return html.select(F.lit("ndrc").alias("dept"), F.lit("国家发展和改革委员会").alias("dept_name"), F.lit("https://www.ndrc.gov.cn/xxgk/zcfb/fzggwl/").alias("list_url"), "ord", "raw")


SQL_LISTING = """, l AS (SELECT doc_id, 'ndrc' AS dept, '国家发展和改革委员会' AS dept_name, 'Notice on ' || ['safety', 'energy', 'prices'][doc_id % 3 + 1] || ' ' || doc_id AS title,
'https://www.ndrc.gov.cn/t2024010' || (doc_id % 9 + 1) || '_' || doc_id || '.html' AS url, '2024-01-0' || (doc_id % 9 + 1) AS date, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 3 < 2)"""
_LIST = "SELECT dept, dept_name, title, url, date, CAST(NULL AS VARCHAR) AS puborg, CAST(NULL AS VARCHAR) AS pcode, 'official_site' AS source_tier"


@query(f"WITH x AS (SELECT 1) {SQL_LISTING} {_LIST} FROM l WHERE n <= 5")
def policy_listing(spark, sf):
    return policy.listing_candidates(listing_raw(spark, sf), dims.DEPARTMENTS[0][6], ["safety", "energy"]).drop("pos")


_WISHES = "SELECT DISTINCT concat('energy ', doc_id % 100) AS keyword FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 < 4"
#: The notices' titles that hold a keyword of a table, in order.
SQL_WISHES = f"WITH k AS ({_WISHES}), {SQL_LISTING.lstrip(', ').replace('WHERE doc_id % 3 < 2', '')}, m AS (SELECT * EXCLUDE n, row_number() OVER (ORDER BY n) AS n FROM l WHERE EXISTS (SELECT 1 FROM k WHERE contains(title, keyword)))"


@query(f"{SQL_WISHES} {_LIST} FROM m WHERE n <= 50")
def policy_keyword_table(spark, sf):
    """Notices by a table of keywords."""
    return policy.listing_candidates(listing_raw(spark, sf), dims.DEPARTMENTS[0][6], shared(spark, sf, _WISHES, "documents"), 50).drop("pos")


@query(f"""{SQL_LIBRARY} {SQL_LISTING}, a AS (SELECT dept, dept_name, title, url, strftime(day, '%Y-%m-%d') AS date, puborg, 'c' AS pcode, 'policy_library' AS source_tier, k * 2 AS p, n FROM f WHERE n <= 40 UNION ALL {_LIST}, 1000 AS p, n FROM l WHERE n <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY p, n) AS first FROM a) SELECT dept, dept_name, title, url, date, puborg, pcode, source_tier FROM b WHERE first = 1""")
def policy_union(spark, sf):
    lib = policy.library_candidates(library_raw(spark, sf), 40, "w", "2023-11-20")
    lst = policy.listing_candidates(listing_raw(spark, sf), dims.DEPARTMENTS[0][6], ["safety", "energy"])
    plan = dims.departments(spark).select(F.col("code").alias("dept"), F.lit("policy_library").alias("source_tier"), (F.row_number().over(_by("code")) * 2).alias("plan_no")).unionByName(spark.createDataFrame([("ndrc", "official_site", 1000)], "dept string, source_tier string, plan_no int"))
    return policy.union_first([lib, lst], plan)


_STATES = "SELECT concat('d', doc_id) AS dept, CASE WHEN doc_id % 2 = 0 THEN 'policy_library' ELSE 'official_site' END AS tier, doc_id % 7 > 0 AS fetched, CASE doc_id % 11 WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'request timed out' WHEN 3 THEN '疑似反爬' WHEN 4 THEN 'other' END AS fetch_error, CAST(doc_id % 3 AS INT) AS links, CAST(doc_id % 5 AS INT) AS matched FROM documents"


@query(f"""WITH s AS ({_STATES}), e AS (SELECT dept, tier, CASE WHEN NOT fetched THEN 'invalid_response' WHEN fetch_error = 'HTTP 404' THEN 'http_error' WHEN fetch_error = 'request timed out' THEN 'network_unreachable' WHEN fetch_error = '疑似反爬' THEN 'blocked' WHEN fetch_error IS NOT NULL THEN 'invalid_response' WHEN tier = 'official_site' AND links = 0 THEN 'invalid_response' WHEN matched = 0 THEN 'no_match' END AS kind,
CASE WHEN NOT fetched THEN 'missing' WHEN fetch_error IS NOT NULL THEN fetch_error WHEN tier = 'official_site' AND links = 0 THEN 'stale pattern' WHEN matched = 0 THEN 'no match' END AS detail FROM s) SELECT * FROM e WHERE kind IS NOT NULL""")
def policy_errors(spark, sf):
    return policy.tier_errors(shared(spark, sf, _STATES, "documents"))


def policy_found(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The search over all departments: one library unread, one with a failed answer, one listing whose links have changed, one unread."""
    d = dims.departments(spark)
    plan = policy.plan(d.select("code", F.row_number().over(_by("code")).alias("ord")), d)
    lib = library_raw(spark, sf).select(F.concat(F.lit("library:"), "dept").alias("url"), "ord", "raw", F.lit(None).cast("string").alias("error")).where("url NOT IN ('library:samr', 'library:mof')")
    lst = listing_raw(spark, sf).select(F.col("list_url").alias("url"), F.col("ord"), "raw", F.lit(None).cast("string").alias("error"))
    rest = d.where("code IN ('mof', 'miit')").select(F.when(F.col("code") == "mof", F.lit("library:mof")).otherwise(F.col("list_url")).alias("url"), F.lit(0).cast("long").alias("ord"), F.when(F.col("code") == "miit", "<li>nothing</li>").alias("raw"), F.when(F.col("code") == "mof", "HTTP 404").alias("error"))
    fetched = lib.unionByName(lst).unionByName(rest)
    return policy.search(plan, fetched, d, ["safety", "energy"], 5, "w", "2023-11-20")


SQL_SEARCH = f"""{SQL_LIBRARY} {SQL_LISTING}, a AS (SELECT dept, dept_name, title, url, strftime(day, '%Y-%m-%d') AS date, puborg, 'c' AS pcode, 'policy_library' AS source_tier, k * 2 AS p, n FROM f WHERE n <= 5 AND dept NOT IN ('samr', 'mof')
UNION ALL SELECT l.dept, l.dept_name, title, url, date, NULL, NULL, 'official_site', k * 2 + 1, n FROM l JOIN dep USING (dept) WHERE n <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY p, n) AS first FROM a),
e AS (SELECT dept, 'policy_library' AS tier, CASE dept WHEN 'samr' THEN 'invalid_response' WHEN 'mof' THEN 'http_error' ELSE 'no_match' END AS kind, CASE dept WHEN 'samr' THEN 'missing' WHEN 'mof' THEN 'HTTP 404' ELSE 'no match' END AS detail FROM dep WHERE dept IN ('samr', 'mof') OR dept NOT IN (SELECT dept FROM f)
UNION ALL SELECT 'miit', 'official_site', 'invalid_response', 'stale pattern' UNION ALL SELECT 'mem', 'official_site', 'invalid_response', 'missing')"""


@query(SQL_SEARCH + " SELECT dept, dept_name, title, url, date, puborg, pcode, source_tier FROM b WHERE first = 1")
def policy_search(spark, sf):
    return policy_found(spark, sf)[0]


@query(SQL_SEARCH + f", site(dept, site_domain) AS (VALUES {', '.join(f'({r[0]!r}, {r[2]!r})' for r in dims.DEPARTMENTS)}) SELECT dept, dept_name, tier, kind, detail, site_domain FROM e JOIN dep USING (dept) JOIN site USING (dept)")
def policy_search_errors(spark, sf):
    return policy_found(spark, sf)[1]


@query(SQL_SEARCH + " SELECT source_tier AS what, count(*) AS n FROM b WHERE first = 1 GROUP BY 1 UNION ALL SELECT 'errors', count(*) FILTER (kind <> 'no_match') FROM e")
def policy_search_counts(spark, sf):
    return policy.counts(*policy_found(spark, sf))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def keep_first_dedupe(spark, sf):
    return gate.keep_first(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


# --- dimensions ----------------------------------------------------------------------------------------------


def _sql_values(rows, names: str) -> str:
    one = lambda v: "NULL" if v is None else "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@query(_sql_values([(r[0], r[1], r[2], "、".join(r[3]), r[4], r[5]) for r in dims.DEPARTMENTS], "code, name, site_domain, keys, library_type, list_url"))
def dims_departments(spark, sf):
    return dims.departments(spark).select("code", "name", "site_domain", F.array_join("puborg_keys", "、").alias("keys"), "library_type", "list_url")


@query(_sql_values([(*r[:6], "、".join(r[6])) for r in dims.INSTITUTIONS], "code, name_zh, name_en, site_domain, org_type, language, reports"))
def dims_sources(spark, sf):
    return dims.institutions(spark).select("code", "name_zh", "name_en", "site_domain", "org_type", "language", F.array_join("report_types", "、").alias("reports"))


_KNOWN = [*(r[0] for r in dims.TEMPLATES), *(a for r in dims.TEMPLATES for a in r[2]), "nothing"]
_NAMES = f"SELECT DISTINCT element_at(array({', '.join(map(repr, _KNOWN))}), CAST(doc_id % {len(_KNOWN)} + 1 AS INT)) AS name FROM documents"
_REGISTRY = ", ".join(f"({k}, {r[0]!r}, {r[1]!r}, {r[2]!r}, {r[3]!r})" for k, r in enumerate(dims.TEMPLATES))
SQL_NAMES = f"WITH reg(ord, key, label, aliases, sections) AS (VALUES {_REGISTRY}), n AS (SELECT DISTINCT [{', '.join(map(repr, _KNOWN))}][doc_id % {len(_KNOWN)} + 1] AS name FROM documents), t AS (SELECT name, key, label, sections, row_number() OVER (PARTITION BY name ORDER BY name <> key, ord) AS r FROM n LEFT JOIN reg ON name = key OR list_contains(aliases, name))"


@query(SQL_NAMES + " SELECT name, key, label FROM t WHERE r = 1")
def template_resolve(spark, sf):
    return dims.resolve_template(shared(spark, sf, _NAMES, "documents"), dims.templates(spark))


@query(SQL_NAMES + " SELECT name, CASE WHEN length(name) = 2 THEN 'own' ELSE array_to_string(sections, '|') END AS sections FROM t WHERE r = 1")
def sections_given_or_usual(spark, sf):
    given = F.when(F.length("name") == 2, F.array(F.lit("own"))).when(F.length("name") == 3, F.array().cast("array<string>"))
    out = dims.default_sections(shared(spark, sf, _NAMES, "documents").withColumn("sections", given), dims.templates(spark))
    return out.select("name", F.array_join("sections", "|").alias("sections"))


_CODES = [*(r[0] for r in dims.DEPARTMENTS), "yyy", "zzz"]
_ASKED = f"SELECT DISTINCT element_at(array({', '.join(map(repr, _CODES))}), CAST(doc_id % 10 + 1 AS INT)) AS code FROM documents"
SQL_CODES = f"WITH dep(code, name, site_domain) AS (VALUES {', '.join(f'({r[0]!r}, {r[1]!r}, {r[2]!r})' for r in dims.DEPARTMENTS)}), n AS (SELECT DISTINCT [{', '.join(map(repr, _CODES))}][doc_id % 10 + 1] AS code FROM documents)"


@query(SQL_CODES + " SELECT code, coalesce(name, code) AS name, coalesce(site_domain, '') AS site_domain FROM n LEFT JOIN dep USING (code)")
def department_resolve(spark, sf):
    return dims.resolve_department(shared(spark, sf, _ASKED, "documents"), dims.departments(spark))


@query(SQL_CODES + " SELECT code FROM n ANTI JOIN dep USING (code)")
def departments_unknown(spark, sf):
    return dims.unknown_departments(shared(spark, sf, _ASKED, "documents"), dims.departments(spark))


# --- decks ---------------------------------------------------------------------------------------------------

#: Slides of a template: number, kind, items, the title's capacity.
SLIDES = [(0, "cover", None, 8), (1, "toc", 4, None), (2, "section", None, 8), (3, "content", 1, 9), (4, "content", 3, 9), (5, "content", 5, 9), (6, "content", 4, 9), (7, "section", None, 9), (8, "content", 6, 10), (9, "content", 3, 10), (10, "content", 4, 13), (11, "closing", None, 8)]
SECTIONS = ["方针与责任", "辨识与管控", "一个很长的章节名称用来测试"]


def slides(spark):
    return spark.createDataFrame(SLIDES, "i int, kind string, items int, title_cap int")


def outline(spark, total: int = 14):
    return deck.allocate(slides(spark), SECTIONS, total)


#: Three templates: the slides as they are, without dividers and with single items alone, with two contents pages and no closing.
TEMPLATES = [("t0", *r) for r in SLIDES] + [("t1", *r) for r in SLIDES if r[1] != "section" and (r[2] or 1) < 2] + [("t2", 20, "toc", 2, None)] + [("t2", *r) for r in SLIDES if r[1] != "closing"]
#: A request for an outline from each document: its first words as sections, of a template by turns. Every ninth asks for a template that isn't there.
_REQUESTS = "SELECT doc_id AS deck, concat('t', CASE WHEN doc_id % 9 = 0 THEN 9 ELSE doc_id % 3 END) AS template, concat('Deck ', doc_id) AS title, CAST(3 + doc_id % 17 AS INT) AS total, {words} AS sections FROM documents"
_WORDS = "[a-zA-Z]{3,14}"


def templates(spark):
    return spark.createDataFrame(TEMPLATES, "template string, i int, kind string, items int, title_cap int")


def requests(spark, sf):
    return shared(spark, sf, _REQUESTS.format(words=f"slice(regexp_extract_all(text, '{_WORDS}', 0), 1, CAST(doc_id % 6 AS INT))"), "documents")


def outlines(spark, sf):
    return deck.outlines(templates(spark), requests(spark, sf))


_TEMPLATES = ", ".join(f"('{t}', {i}, '{k}', {'NULL' if n is None else n}, {'NULL' if c is None else c})" for t, i, k, n, c in TEMPLATES)
SQL_OUTLINES = f"""WITH sl(template, i, kind, items, title_cap) AS (VALUES {_TEMPLATES}), req AS ({_REQUESTS.format(words=f"coalesce(regexp_extract_all(text, '{_WORDS}')[1:doc_id % 6], [])")}), q AS (SELECT *, len(sections) AS n FROM req WHERE template IN (SELECT template FROM sl)),
fx AS (SELECT template, count(*) FILTER (kind = 'closing') + max(CAST(kind = 'toc' AS INT)) AS fixed, max(CAST(kind = 'section' AS INT)) AS divided FROM sl GROUP BY template),
c AS (SELECT deck, n, greatest(total - 1 - fixed - n * divided, n) AS body FROM q JOIN fx USING (template) WHERE n > 0), sec AS (SELECT deck, template, unnest(range(n)) AS s, unnest(sections) AS name FROM q),
b AS (SELECT deck, template, s, name, unnest(range(body // n + CASE WHEN s < body % n THEN 1 ELSE 0 END)) AS b FROM sec JOIN c USING (deck)), t AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY s, b) - 1 AS taken FROM b),
usable AS (SELECT *, max(items) OVER (PARTITION BY template) AS top FROM sl WHERE kind = 'content' AND items BETWEEN 1 AND 6), pool AS (SELECT template, i, items, title_cap FROM usable WHERE items >= 2 OR top < 2),
o AS (SELECT deck, s, i, items, coalesce(title_cap, 99) >= length(name) AS holds, bool_or(coalesce(title_cap, 99) >= length(name)) OVER (PARTITION BY deck, s) AS anyone FROM sec JOIN pool USING (template)),
f AS (SELECT *, row_number() OVER (PARTITION BY deck, s ORDER BY items, i) - 1 AS r, count(*) OVER (PARTITION BY deck, s) AS m FROM o WHERE holds OR NOT anyone),
d AS (SELECT template, i, row_number() OVER (PARTITION BY template ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY template) AS m FROM sl WHERE kind = 'section'),
p AS (SELECT deck, 0 AS a, 0 AS b, min(i) AS src, 'cover' AS kind, title, NULL AS items FROM q JOIN sl USING (template) WHERE kind = 'cover' GROUP BY deck, title
UNION ALL (SELECT deck, 1, 0, i, 'toc', '目录', least(coalesce(items, n), n) FROM q JOIN sl USING (template) WHERE kind = 'toc' QUALIFY row_number() OVER (PARTITION BY deck ORDER BY abs(coalesce(items, 0) - n), i) = 1)
UNION ALL SELECT deck, 2 * s + 2, 0, i, 'section', name, NULL FROM sec JOIN d ON d.template = sec.template AND s % m = r
UNION ALL SELECT t.deck, 2 * t.s + 3, t.b, i, 'content', name, items FROM t JOIN f ON t.deck = f.deck AND t.s = f.s AND taken % m = r
UNION ALL SELECT deck, 1000000, 0, min(i), 'closing', '{{致谢}}', NULL FROM q JOIN sl USING (template) WHERE kind = 'closing' GROUP BY deck),
x AS (SELECT row_number() OVER (PARTITION BY deck ORDER BY a, b) AS page, * FROM p),
o1 AS (SELECT deck, template, CAST(page AS INTEGER) AS page, src, x.kind, x.title, CAST(items AS INTEGER) AS items FROM x JOIN q USING (deck) WHERE page <= total)"""


@query(SQL_OUTLINES + " SELECT deck, page, src, kind, title, items FROM o1")
def outline_allocate(spark, sf):
    return outlines(spark, sf).drop("template")


def written(spark, sf):
    """The outlines with text in their items. Every fifth page has an item more than its slide, every seventh one less."""
    item = lambda k: F.struct(F.concat(F.lit("要点"), k.cast("string")).alias("head"), F.when(k % 2 == 0, F.lit("说明 __ 文字")).otherwise(F.lit("")).alias("body"))
    n = F.when(F.col("items") > 0, F.col("items") + F.when(F.col("page") % 5 == 0, 1).when(F.col("page") % 7 == 0, -1).otherwise(0)).otherwise(0)
    return outlines(spark, sf).select("deck", "page", "src", "kind", "title", F.when(F.col("kind") == "cover", F.lit("副标题")).alias("subtitle"), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), item)).otherwise(F.array().cast("array<struct<head:string,body:string>>")).alias("items"))


_LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in deck.LABELS.items()) + " END"
SQL_CARDS = SQL_OUTLINES + f""", n AS (SELECT deck, template, page, src, kind, title, coalesce(items, 0) AS had, CASE WHEN items > 0 THEN items + CASE WHEN page % 5 = 0 THEN 1 WHEN page % 7 = 0 THEN -1 ELSE 0 END ELSE 0 END AS m, sum(CAST(kind = 'section' AS INT)) OVER (PARTITION BY deck ORDER BY page) AS no, '**第 ' || page || ' 页**　`' || {_LABEL} || '`' AS head FROM o1)"""


@query(SQL_CARDS + """ SELECT deck, page, CASE kind WHEN 'cover' THEN head || chr(10) || '# ' || title || chr(10) || '副标题' WHEN 'closing' THEN head || chr(10) || '# ' || title WHEN 'section' THEN head || chr(10) || '### ' || lpad(CAST(no AS VARCHAR), 2, '0') || ' · ' || title
ELSE array_to_string(list_concat([head || '　' || title], list_transform(range(1, m + 1), lambda k: CASE WHEN kind = 'toc' THEN '- 要点' || k WHEN k % 2 = 0 THEN '- **要点' || k || '** — 说明 __ 文字' ELSE '- **要点' || k || '**' END)), chr(10)) END AS card FROM n""")
def outline_card(spark, sf):
    return deck.cards(written(spark, sf))


_ITEMS = """'[' || array_to_string(list_transform(range(1, {0} + 1), lambda k: CASE WHEN k > m THEN '{{"head":"","body":""}}' ELSE '{{"head":"要点' || k || '","body":"' || CASE WHEN k % 2 = 0 AND kind <> 'toc' THEN '说明 __ 文字' ELSE '' END || '"}}' END), ',') || ']'"""


@query(SQL_CARDS + f" SELECT deck, page, kind, title, {_ITEMS.format('m')} AS items FROM n")
def card_parse(spark, sf):
    return deck.parse_cards(deck.cards(written(spark, sf))).select("deck", "page", "kind", "title", F.to_json("items").alias("items"))


def outlines_rebuilt(spark, sf):
    return deck.rebuild(outlines(spark, sf), deck.parse_cards(deck.cards(written(spark, sf))), templates(spark))


SQL_REBUILD = SQL_CARDS + """, mv AS (SELECT deck, template, page, title, m AS need, row_number() OVER (PARTITION BY deck, m ORDER BY page) - 1 AS k FROM n WHERE kind = 'content' AND m <> had),
ex AS (SELECT mv.*, pool.i, coalesce(title_cap, 99) >= length(title) AS holds, bool_or(coalesce(title_cap, 99) >= length(title)) OVER (PARTITION BY deck, page) AS anyone FROM mv JOIN pool ON pool.template = mv.template AND pool.items = need),
tu AS (SELECT *, row_number() OVER (PARTITION BY deck, page ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY deck, page) AS mm FROM ex WHERE holds OR NOT anyone),
ch AS (SELECT deck, page, i, need AS room FROM tu WHERE k % mm = r UNION ALL (SELECT n.deck, n.page, sl.i, coalesce(sl.items, 0) FROM n JOIN sl ON sl.template = n.template AND sl.kind = 'toc' WHERE n.kind = 'toc' AND m <> had QUALIFY row_number() OVER (PARTITION BY deck, page ORDER BY abs(coalesce(sl.items, 0) - m), sl.i) = 1)),
re AS (SELECT n.*, coalesce(ch.i, n.src) AS slide, coalesce(room, had) AS room FROM n LEFT JOIN ch USING (deck, page))"""


@query(SQL_REBUILD + f" SELECT deck, page, slide AS src, kind, title, CASE WHEN kind = 'cover' THEN '副标题' END AS subtitle, {_ITEMS.format('room')} AS items FROM re WHERE m <= room")
def outline_rebuild(spark, sf):
    return outlines_rebuilt(spark, sf)[0].withColumn("items", F.to_json("items"))


@query(SQL_REBUILD + " SELECT deck, page, 'too many items' AS error FROM re WHERE m > room")
def outline_rebuild_errors(spark, sf):
    return outlines_rebuilt(spark, sf)[1]


#: Card texts with something wrong by turns: no head line, an unknown label, a divider without title, another number of pages.
_CARDS = """SELECT CAST(doc_id AS STRING) AS card, concat('noise', CHR(10), CASE WHEN doc_id % 5 = 0 THEN '**T** no head' ELSE concat('**T', doc_id, '**　模板：X　共 ', doc_id % 3 + 1, ' 页') END, CHR(10), '---', CHR(10), '**第 1 页**　`', CASE doc_id % 4 WHEN 0 THEN '封套' WHEN 1 THEN '封底' ELSE '封面' END, '`', CHR(10), '# A', CHR(10), 'sub', CHR(10), '- x', CHR(10), ' --- ', CHR(10), '**第 2 页** `章节`', CHR(10), CASE WHEN doc_id % 7 = 0 THEN 'no title' ELSE concat('### 01 · S', doc_id) END, CHR(10), '---', CHR(10), 'tail', CHR(10), '---', CHR(10), '**第 3 页** `要点` never read') AS text FROM documents"""
SQL_CARD_ERRORS = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no head line' WHEN doc_id % 4 = 0 THEN 'unknown label 封套' WHEN doc_id % 7 = 0 THEN 'divider without a title' WHEN doc_id % 3 <> 1 THEN 'head line says ' || (doc_id % 3 + 1) || ' pages, there are 2' END AS error FROM documents"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS card, error FROM ({SQL_CARD_ERRORS}) WHERE error IS NOT NULL")
def card_errors(spark, sf):
    return deck.read_cards(shared(spark, sf, _CARDS, "documents"))[1]


@query(f"WITH e AS ({SQL_CARD_ERRORS}) SELECT CAST(doc_id AS VARCHAR) AS card, 1 AS page, CASE WHEN doc_id % 4 = 1 THEN 'closing' ELSE 'cover' END AS kind, 'A' AS title, 'sub' AS subtitle FROM e WHERE error IS NULL UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'section', 'S' || doc_id, NULL FROM e WHERE error IS NULL")
def card_pages(spark, sf):
    return deck.read_cards(shared(spark, sf, _CARDS, "documents"))[0].select("card", "page", "kind", "title", "subtitle")


SLOTS = [(0, "cover", 1, "title", None), (0, "cover", 2, "subtitle", None), (0, "cover", 3, "decor", None), (2, "section", 1, "no", None), (2, "section", 2, "title", None), (4, "content", 1, "title", None), (4, "content", 2, "item_head", 0), (4, "content", 3, "item_body", 0), (4, "content", 4, "item_head", 7), (4, "content", 5, "no", None)]
_SLOTS = ", ".join(f"({i}, '{k}', {s}, '{r}', {'NULL' if x is None else x})" for i, k, s, r, x in SLOTS)
#: Decks of fourteen pages from documents; every seventh page names a slide that the index doesn't have.
_DECKS = "SELECT CAST(floor(doc_id / 14) AS BIGINT) AS deck, CAST(doc_id % 14 + 1 AS INT) AS page, doc_id, CAST(CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 99 ELSE 4 END AS INT) AS src, left(text, CAST(doc_id % 30 AS INT)) AS title, CASE WHEN doc_id % 3 = 0 THEN concat('Sub ', doc_id) END AS subtitle, doc_id % 5 > 0 AS has_item, concat('h', doc_id) AS head, CASE doc_id % 4 WHEN 0 THEN '单击此处' WHEN 1 THEN '{a} __ ___' ELSE 'body' END AS body FROM documents"
SQL_FILL = f"""WITH sl(i, kind, sid, role, idx) AS (VALUES {_SLOTS}), d AS ({_DECKS.replace('floor(doc_id / 14)', 'doc_id // 14')}), k AS (SELECT DISTINCT i, kind FROM sl), n AS (SELECT d.*, sum(CAST(kind = 'section' AS INT)) OVER (PARTITION BY deck ORDER BY page) AS no FROM d JOIN k ON src = i),
f AS (SELECT deck, page, sid, coalesce(CASE WHEN role = 'no' THEN lpad(CAST(no AS VARCHAR), 2, '0') WHEN role = 'title' THEN title WHEN role = 'subtitle' THEN subtitle WHEN has_item AND coalesce(idx, 0) = 0 THEN CASE WHEN role = 'item_head' THEN head ELSE body END END, '') AS text FROM n JOIN sl ON src = i WHERE role <> 'decor' AND (role <> 'no' OR kind = 'section'))"""


def decks_of_documents(spark, sf):
    items = F.when(F.col("has_item"), F.array(F.struct("head", "body"))).otherwise(F.array().cast("array<struct<head:string,body:string>>"))
    return shared(spark, sf, _DECKS, "documents").withColumn("items", items)


def filled(spark, sf):
    return deck.fill(decks_of_documents(spark, sf).select("deck", "page", "src", "title", "subtitle", "items"), spark.createDataFrame(SLOTS, "i int, kind string, sid int, role string, idx int"))


@query(SQL_FILL + " SELECT * FROM f")
def slot_fill(spark, sf):
    return filled(spark, sf)


@query(SQL_FILL + " SELECT deck, page, 'no slide 99' AS error FROM d WHERE src = 99")
def slides_unknown(spark, sf):
    return deck.unknown_slides(decks_of_documents(spark, sf), spark.createDataFrame(SLOTS, "i int, kind string, sid int, role string, idx int"))


def template_package() -> bytes:
    """A template of five slides with the shapes of SLOTS, whose texts are their slide and number."""
    import io
    import zipfile

    ns = " ".join(f'xmlns:{k}="{v}"' for k, v in decks.NS.items())
    rels = lambda *to: f'<Relationships xmlns="{writer.REL_NS}">' + "".join(f'<Relationship Id="rId{k}" Type="{decks.NS["r"]}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(to, 1)) + "</Relationships>"
    shape = '<p:sp><p:nvSpPr><p:cNvPr id="{sid}" name="s"/></p:nvSpPr><p:spPr/><p:txBody><a:p><a:r><a:rPr sz="1800"/><a:t>S{i}-{sid}</a:t></a:r><a:r><a:t> old</a:t></a:r></a:p></p:txBody></p:sp>'
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        each = "".join(f'<Override PartName="/ppt/slides/slide{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.slide+xml"/>' for k in range(1, 6))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>{each}</Types>')
        z.writestr("_rels/.rels", rels(("officeDocument", "ppt/presentation.xml")))
        z.writestr("ppt/presentation.xml", f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(1, 6)) + "</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", rels(*[("slide", f"slides/slide{k}.xml") for k in range(1, 6)]))
        for k in range(5):
            z.writestr(f"ppt/slides/slide{k + 1}.xml", f"<p:sld {ns}><p:cSld><p:spTree>" + "".join(shape.format(sid=sid, i=i) for i, _, sid, *_ in SLOTS if i == k) + "</p:spTree></p:cSld></p:sld>")
    return whole.getvalue()


def built(spark, sf, unknown: bool):
    """Packages of the decks, with their pages of unknown slides or without them."""
    whole = decks_of_documents(spark, sf).select("deck", F.lit("t").alias("package"), "page", "src")
    pages_ = whole if unknown else whole.where("src <> 99")
    return writer.build(pages_, filled(spark, sf), spark.createDataFrame([("t", bytearray(template_package()))], "package string, data binary"))


@query(SQL_FILL + f", o AS (SELECT deck, page, src, CAST(row_number() OVER (PARTITION BY deck ORDER BY page) AS INT) AS slide FROM d WHERE src <> 99), b AS (SELECT CAST(o.deck AS VARCHAR) AS package, slide, sl.sid, CASE WHEN f.sid IS NULL THEN 'S' || src || '-' || sl.sid || ' old' ELSE f.text END AS text FROM o JOIN sl ON i = src LEFT JOIN f ON f.deck = o.deck AND f.page = o.page AND f.sid = sl.sid) SELECT * FROM b WHERE {sql_strip('text')} <> ''")
def deck_build(spark, sf):
    return decks.shapes(built(spark, sf, False).select(F.col("deck").cast("string").alias("package"), "data")).select("package", "slide", "sid", "text")


@query(SQL_FILL + " SELECT deck, CASE WHEN bool_or(src = 99) THEN 'no slide 99' END AS error, bool_or(src = 99) AS lacks FROM d GROUP BY deck")
def deck_build_errors(spark, sf):
    return built(spark, sf, True).select("deck", "error", F.col("data").isNull().alias("lacks"))


_RESIDUE = " OR ".join(f"contains(text, '{w}')" for w in deck.RESIDUE)


@query(SQL_FILL + f", s AS (SELECT *, {sql_strip('text')} AS t FROM f) SELECT deck, page, sid, 'residue' AS category FROM s WHERE t <> '' AND ({_RESIDUE}) UNION ALL SELECT deck, page, sid, 'overflow' FROM s WHERE length(t) > CASE sid WHEN 1 THEN 13 WHEN 2 THEN 4 END * 1.15::DOUBLE")
def content_check(spark, sf):
    return deck.content_issues(filled(spark, sf), spark.createDataFrame([(1, 13), (2, 4)], "sid int, cap int"))


@query(SQL_FILL + ", t AS (SELECT deck, page, CAST(sum(len(regexp_extract_all(text, '_{2,}'))) AS BIGINT) AS todo FROM f GROUP BY ALL) SELECT * FROM t WHERE todo > 0")
def todo_slots(spark, sf):
    return deck.todo_slots(filled(spark, sf))


_CAPS = [(0, "title", 5), (0, "subtitle", 6), (2, "title", 20), (4, "title", 9), (4, "item_head", 3), (4, "item_body", 6)]


@query(f"""WITH d AS ({_DECKS.replace('floor(doc_id / 14)', 'doc_id // 14')}), c(i, role, cap) AS (VALUES {', '.join(map(str, _CAPS))}), t AS (SELECT doc_id, src, 'title' AS role, title AS text FROM d UNION ALL SELECT doc_id, src, 'subtitle', subtitle FROM d UNION ALL SELECT doc_id, src, 'item_head', head FROM d WHERE has_item UNION ALL SELECT doc_id, src, 'item_body', body FROM d WHERE has_item)
SELECT doc_id AS page, t.role, text, cap FROM t JOIN c ON src = i AND t.role = c.role WHERE length(text) > cap AND NOT starts_with(text, '{{')""")
def cap_warnings(spark, sf):
    return deck.cap_warnings(decks_of_documents(spark, sf).withColumn("page", F.col("doc_id")), spark.createDataFrame(_CAPS, "i int, role string, cap int"))


_OPS = "SELECT CAST(floor(doc_id / 14) AS BIGINT) AS deck, doc_id AS ord, CAST(doc_id * 5 % 14 + 1 AS INT) AS page, CASE doc_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' ELSE 'items[0].head' END AS field, concat('v', doc_id) AS value FROM documents WHERE doc_id % 4 = 0"


@query(f"""WITH d AS ({_DECKS.replace('floor(doc_id / 14)', 'doc_id // 14')}), o AS ({_OPS.replace('floor(doc_id / 14)', 'doc_id // 14')}), j AS (SELECT o.*, d.page IS NOT NULL AND (field <> 'items[0].head' OR has_item) AS fine FROM o LEFT JOIN d USING (deck, page)), bad AS (SELECT DISTINCT deck FROM j WHERE NOT fine),
w AS (SELECT deck, page, field, arg_max(value, ord) AS value FROM j WHERE deck NOT IN (SELECT deck FROM bad) GROUP BY ALL), v AS (SELECT deck, page, max(value) FILTER (field = 'title') AS t, max(value) FILTER (field = 'subtitle') AS s, max(value) FILTER (field = 'items[0].head') AS h FROM w GROUP BY ALL)
SELECT deck, page, coalesce(t, title) AS title, coalesce(s, subtitle) AS subtitle, CASE WHEN has_item THEN coalesce(h, head) END AS head FROM d LEFT JOIN v USING (deck, page)""")
def outline_patch(spark, sf):
    pages_ = decks_of_documents(spark, sf).select("deck", "page", F.lit("content").alias("kind"), "title", "subtitle", "items")
    out = deck.patch(pages_, shared(spark, sf, _OPS, "documents"))[0]
    return out.select("deck", "page", "title", "subtitle", F.get("items", F.lit(0))["head"].alias("head"))


@query("SELECT p_partkey, CAST(ceil(p_size / 3) AS INTEGER) AS rows, CAST((p_size - 1) // 3 AS INTEGER) AS last_row, CAST((p_size - 1) % 3 AS INTEGER) AS last_column FROM part")
def grid_places(spark, sf):
    g = deck.grid(F.col("p_size"), 3)
    last = F.element_at(g["cells"], -1)
    return table(spark, sf, "part").select("p_partkey", g["rows"].alias("rows"), last["row"].alias("last_row"), last["column"].alias("last_column"))


@query("""WITH a AS (SELECT p_partkey AS k, CAST(p_size * 90000 AS BIGINT) AS w, CAST((p_partkey % 9 + 1) * 150000 AS BIGINT) AS h, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CAST(p_partkey % 30 + 6 AS DOUBLE) END AS f, length(p_name) AS n, ['title', 'subtitle', 'item_head', 'item_body', 'decor'][p_partkey % 5 + 1] AS role FROM part),
b AS (SELECT *, CASE WHEN f = 0 THEN 18.0 ELSE f END AS s FROM a), c AS (SELECT *, greatest(1, CAST(round_even(CAST(w AS DOUBLE) / 12700 * 0.92::DOUBLE / s, 0) AS INTEGER)) * greatest(1, CAST(floor(CAST(h AS DOUBLE) / 12700 * 0.95::DOUBLE / (s * 1.25::DOUBLE)) AS INTEGER)) AS room FROM b)
SELECT k AS p_partkey, least(greatest(room, n), CASE role WHEN 'title' THEN 24 WHEN 'subtitle' THEN 34 WHEN 'item_head' THEN 14 WHEN 'item_body' THEN 80 ELSE 40 END) AS cap FROM c""")
def slot_cap(spark, sf):
    p = table(spark, sf, "part")
    font = F.when(F.col("p_partkey") % 4 == 0, 0.0).otherwise((F.col("p_partkey") % 30 + 6).cast("double"))
    role = F.element_at(F.array(*map(F.lit, ("title", "subtitle", "item_head", "item_body", "decor"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    room = deck.capacity((F.col("p_size") * 90000).cast("double"), ((F.col("p_partkey") % 9 + 1) * 150000).cast("double"), font)
    return p.select("p_partkey", deck.slot_cap(role, room, F.col("p_name")).cast("long").alias("cap"))


def shapes(spark, sf):
    """Text boxes from parts: ten to a slide."""
    k = F.col("p_partkey")
    text = F.when(k % 10 == 0, F.element_at(F.array(*map(F.lit, ("目 录", "01", "PROJECT", "谢谢"))), (k % 4 + 1).cast("int"))).when(k % 10 == 1, F.lit("第三")).otherwise(F.concat(F.lit("项 "), F.col("p_name")))
    return table(spark, sf, "part").select(F.floor(k / 10).cast("int").alias("slide"), (k % 10).cast("int").alias("pos"), text.alias("text"), F.when(k % 3 == 0, 0.0).otherwise((k % 30).cast("double")).alias("font_pt"), ((k * 7919) % 9000000).alias("left"), ((k * 104729) % 6000000).alias("top"), F.lit(900000).cast("long").alias("width"), ((k % 9 + 1) * 150000).alias("height"), (k % 97 == 0).alias("has_table"), F.lit("").alias("layout"))


_FLAT = rf"regexp_replace(text, '{WS}+', '', 'g')"
_DECOR = f"(contains(upper(f), '目录') OR contains(upper(f), 'CONTENT') OR regexp_matches(f, '{'|'.join(deck.DECOR)}'))"
SQL_SHAPES = f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN ['目 录', '01', 'PROJECT', '谢谢'][p_partkey % 4 + 1] WHEN p_partkey % 10 = 1 THEN '第三' ELSE '项 ' || p_name END AS text FROM part),
f AS (SELECT CAST(k // 10 AS INTEGER) AS slide, CAST(k % 10 AS INTEGER) AS pos, {_FLAT} AS f, CASE WHEN k % 3 = 0 THEN 0 ELSE CAST(k % 30 AS DOUBLE) END AS font, (k * 104729) % 6000000 AS top, (k % 9 + 1) * 150000 AS height, k % 97 = 0 AS has_table FROM p),
s AS (SELECT *, {_DECOR} AS decor, regexp_matches(f, '{deck.SECTION_NO}') AS numbered FROM f),
g AS (SELECT slide, upper(string_agg(f, '' ORDER BY pos)) AS u, bool_or(numbered) AS numbered, count(*) FILTER (NOT decor AND f <> '') AS bodies, bool_or(has_table) AS has_table, min(slide) OVER () AS first, max(slide) OVER () AS last FROM s GROUP BY slide),
kinds AS (SELECT slide, CASE WHEN slide = first THEN 'cover' WHEN contains(u, '目录') OR contains(u, 'CONTENT') THEN 'toc' WHEN contains(u, '谢谢') OR contains(u, '感谢') OR contains(u, 'THANKS') OR contains(u, 'THANK YOU') THEN 'closing'
 WHEN has_table THEN 'table' WHEN numbered AND bodies <= 2 THEN 'section' WHEN slide = last THEN 'closing' ELSE 'content' END AS kind FROM g)"""


@query(SQL_SHAPES + " SELECT slide, kind FROM kinds")
def slide_kind(spark, sf):
    return deck.slide_kinds(shapes(spark, sf))


@query(SQL_SHAPES + """, a AS (SELECT s.*, kind, CASE WHEN s.numbered THEN 'no' WHEN decor OR (font > 0 AND font < 9) THEN 'decor' END AS aside FROM s JOIN kinds USING (slide)),
r AS (SELECT *, row_number() OVER (PARTITION BY slide, aside IS NULL ORDER BY coalesce(nullif(font, 0), CAST(height AS DOUBLE) / 91440) DESC, pos) - 1 AS n, length(f) AS size FROM a)
SELECT slide, pos, CASE WHEN aside IS NOT NULL THEN aside WHEN kind IN ('cover', 'section', 'closing') THEN CASE n WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' ELSE 'item_body' END
 WHEN kind = 'toc' THEN 'item_head' WHEN n = 0 AND top < 2011680 AND size <= 20 THEN 'title' WHEN size <= 12 THEN 'item_head' ELSE 'item_body' END AS role FROM r""")
def slot_roles(spark, sf):
    s = shapes(spark, sf)
    return deck.slot_roles(s, deck.slide_kinds(s))


_ROLES = """, a AS (SELECT s.*, kind, CASE WHEN s.numbered THEN 'no' WHEN decor OR (font > 0 AND font < 9) THEN 'decor' END AS aside FROM s JOIN kinds USING (slide)),
r AS (SELECT *, row_number() OVER (PARTITION BY slide, aside IS NULL ORDER BY coalesce(nullif(font, 0), CAST(height AS DOUBLE) / 91440) DESC, pos) - 1 AS n, length(f) AS size FROM a),
roles AS (SELECT slide, pos, CASE WHEN aside IS NOT NULL THEN aside WHEN kind IN ('cover', 'section', 'closing') THEN CASE n WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' ELSE 'item_body' END
 WHEN kind = 'toc' THEN 'item_head' WHEN n = 0 AND top < 2011680 AND size <= 20 THEN 'title' WHEN size <= 12 THEN 'item_head' ELSE 'item_body' END AS role FROM r),
geo AS (SELECT CAST(k // 10 AS INTEGER) AS slide, CAST(k % 10 AS INTEGER) AS pos, k AS sid, text, CASE WHEN k % 3 = 0 THEN 0 ELSE CAST(k % 30 AS DOUBLE) END AS font, (k * 7919) % 9000000 AS l, (k * 104729) % 6000000 AS t, (k % 9 + 1) * 150000 AS height FROM p),
g2 AS (SELECT geo.*, role, t // 548640 AS band, CAST(l AS DOUBLE) + 450000 AS x, CAST(t AS DOUBLE) + CAST(height AS DOUBLE) / 2 AS y FROM geo JOIN roles USING (slide, pos)),
heads AS (SELECT slide, coalesce(list({'pos': pos, 'x': x, 'y': y} ORDER BY band, l, pos) FILTER (role = 'item_head'), []) AS h FROM g2 GROUP BY slide),
bodies AS (SELECT slide, pos, x, y, row_number() OVER (PARTITION BY slide ORDER BY band, l, pos) AS n FROM g2 WHERE role = 'item_body'),
pairs AS (SELECT slide, CAST(0 AS BIGINT) AS n, range(len(h)) AS free, CAST(len(h) AS BIGINT) AS nxt, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS BIGINT) AS idx FROM heads
 UNION ALL SELECT slide, n, list_filter(free, lambda z: z IS DISTINCT FROM best), nxt + CAST(best IS NULL AS BIGINT), pos, coalesce(best, nxt) FROM
 (SELECT c.slide, b.n, c.free, c.nxt, b.pos, list_sort(list_transform(c.free, lambda z: {'d': pow(g.h[z + 1].x - b.x, 2) + pow(g.h[z + 1].y - b.y, 2), 'z': z}))[1].z AS best FROM pairs c JOIN bodies b ON b.slide = c.slide AND b.n = c.n + 1 JOIN heads g ON g.slide = c.slide)),
numbers AS (SELECT slide, pos, CAST(idx AS INTEGER) AS idx FROM pairs WHERE pos IS NOT NULL UNION ALL SELECT slide, e.pos, CAST(k - 1 AS INTEGER) FROM (SELECT slide, unnest(h) AS e, unnest(range(1, len(h) + 1)) AS k FROM heads))"""
SQL_PAIRS = SQL_SHAPES.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + _ROLES


@query(SQL_PAIRS + " SELECT * FROM numbers")
def head_body_pairing(spark, sf):
    s = shapes(spark, sf)
    return deck.pair(s.join(deck.slot_roles(s, deck.slide_kinds(s)), ["slide", "pos"]))


SQL_INDEX = SQL_PAIRS + f""", c AS (SELECT g2.*, kind, idx, {sql_strip('text')} AS clean, CASE WHEN font = 0 THEN 18.0 ELSE font END AS size FROM g2 JOIN kinds USING (slide) LEFT JOIN numbers USING (slide, pos)),
slots AS (SELECT slide, kind, row_number() OVER (PARTITION BY slide ORDER BY band, l, pos) - 1 AS n, sid, role, left(clean, 24) AS sample, CASE WHEN role NOT IN ('decor', 'no') THEN least(greatest(greatest(1, CAST(round_even(900000::DOUBLE / 12700 * 0.92::DOUBLE / size, 0) AS INTEGER)) * greatest(1, CAST(floor(CAST(height AS DOUBLE) / 12700 * 0.95::DOUBLE / (size * 1.25::DOUBLE)) AS INTEGER)), length(clean)),
 CASE role WHEN 'title' THEN 24 WHEN 'subtitle' THEN 34 WHEN 'item_head' THEN 14 WHEN 'item_body' THEN 80 ELSE 40 END) END AS cap, idx FROM c),
per AS (SELECT slide, kind, CASE WHEN kind IN ('content', 'toc', 'cover', 'closing') THEN max(idx) + 1 END AS items FROM slots GROUP BY slide, kind)"""


def indexed(spark, sf):
    """The index of the template that the parts' shapes make up."""
    return deck.index_slides(shapes(spark, sf).withColumn("sid", F.col("slide") * 10 + F.col("pos")))


@query(SQL_INDEX + " SELECT slide, kind, items, CAST(n AS INTEGER) AS n, CAST(sid AS INTEGER) AS sid, role, sample, CAST(cap AS INTEGER) AS cap, idx FROM slots JOIN per USING (slide, kind)")
def template_index(spark, sf):
    return indexed(spark, sf).select("slide", "kind", "items", F.posexplode("slots").alias("n", "s")).select("slide", "kind", "items", "n", "s.*")


@query(SQL_SHAPES + f" SELECT CAST(list_position([{', '.join(map(repr, deck.KINDS))}], kind) AS INTEGER) AS ord, kind, count(*) AS n FROM kinds GROUP BY kind")
def kind_inventory(spark, sf):
    return deck.kind_counts(deck.slide_kinds(shapes(spark, sf)))


@query(SQL_INDEX + f""", k AS (SELECT list_position([{', '.join(map(repr, deck.KINDS))}], kind) AS ord, kind, count(*) AS n FROM per GROUP BY kind), room AS (SELECT coalesce(array_to_string(list_sort(list(DISTINCT items) FILTER (kind = 'content' AND items > 0)), '/'), '-') AS r FROM per), q AS (SELECT string_agg(kind || n, ' ' ORDER BY ord) AS kinds, CAST(sum(n) AS BIGINT) AS slides FROM k)
SELECT slides, kinds, slides || ' slides (' || kinds || '); items: ' || r AS line FROM q, room""")
def template_summary(spark, sf):
    return deck.summary(indexed(spark, sf)).drop("capacities")


@query(SQL_INDEX + " SELECT slide AS i, role, CAST(min(cap) AS INTEGER) AS cap FROM slots WHERE cap IS NOT NULL GROUP BY ALL")
def tightest_caps(spark, sf):
    slides_ = indexed(spark, sf).select(F.lit("t").alias("template"), F.col("slide").alias("i"), "slots")
    return decks.tightest_caps(slides_).select("i", F.explode("caps").alias("role", "cap"))


@query(SQL_INDEX + """, t AS (SELECT slide % 9 AS template, slide AS i, kind, role, sample, n FROM slots WHERE sample <> ''), u AS (SELECT t.* FROM t JOIN (SELECT template, bool_or(kind = 'section') AS divided, min(i) FILTER (kind = 'toc') AS toc FROM t WHERE (kind = 'section' AND role = 'title') OR (kind = 'toc' AND role = 'item_head') GROUP BY template) USING (template) WHERE CASE WHEN divided THEN kind = 'section' AND role = 'title' ELSE kind = 'toc' AND role = 'item_head' AND i = toc END),
named AS (SELECT template, sample AS name, min((i, n)) AS place FROM u GROUP BY ALL) SELECT template, CAST(row_number() OVER (PARTITION BY template ORDER BY place) AS INTEGER) AS ord, name FROM named""")
def section_defaults(spark, sf):
    return deck.default_sections(indexed(spark, sf).select((F.col("slide") % 9).alias("template"), F.col("slide").alias("i"), "kind", "slots"))


@query(SQL_INDEX + """, b AS (SELECT slide, kind, items, unnest(range(items)) AS k FROM per WHERE items > 0), w AS (SELECT b.slide, b.kind, k, bool_or(role = 'item_head') AS h, arg_min(sample, n) FILTER (role = 'item_body') AS s, bool_or(role = 'item_body') AS body FROM b LEFT JOIN slots ON slots.slide = b.slide AND idx = k GROUP BY ALL)
SELECT slide AS i, CAST(k AS INTEGER) AS k, CASE WHEN kind = 'toc' THEN '{章节名}' WHEN kind = 'content' AND h THEN '{要点}' END AS head, CASE WHEN kind IN ('cover', 'closing') THEN '{' || coalesce(s, '署名') || '}' WHEN kind = 'content' AND (body OR NOT coalesce(h, false)) THEN '{说明}' END AS body FROM w""")
def blank_pages(spark, sf):
    return deck.blank_pages(indexed(spark, sf)).select("i", F.posexplode("items").alias("k", "x")).select("i", "k", F.col("x.head").alias("head"), F.col("x.body").alias("body"))


#: Packages of parts, relationships and shapes from the parts table.
_PACK = "SELECT DISTINCT p_partkey % 40 AS package, {0} FROM part"
_PART, _CHART, _RID = "concat('/ppt/slides/s', p_partkey % 7, '.xml')", "concat('/ppt/charts/c', p_partkey % 9, '.xml')", "concat('r', p_partkey % 5)"
_RELS = f"""SELECT package, part, rid, min(type) AS type, min(target) AS target, min(mode) AS mode FROM (SELECT p_partkey % 40 AS package, {_PART} AS part, {_RID} AS rid, 'http://t/chart' AS type, {_CHART} AS target, CASE WHEN p_partkey % 11 = 0 THEN 'External' END AS mode FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey % 40, {_CHART}, {_RID}, CASE WHEN p_partkey % 2 = 0 THEN 'http://t/package' ELSE 'http://t/chartStyle' END, concat('/ppt/embeddings/e', p_partkey % 8, '.xlsx'), CAST(NULL AS STRING) FROM part WHERE p_partkey % 4 > 0) q GROUP BY package, part, rid"""
_USED = _PACK.format(f"{_PART} AS part, {_RID} AS rid")
_PARTS = _PACK.format("CASE WHEN p_partkey % 2 = 0 THEN concat('/ppt/charts/c', p_partkey % 6, '.xml') ELSE concat('/ppt/embeddings/e', p_partkey % 5, '.xlsx') END AS part")
_SHAPE_IDS = f"SELECT p_partkey % 40 AS package, {_PART} AS part, CAST(p_partkey % 4 AS INT) AS shape_id FROM part"
_CHARTS = _PACK.format(f"{_CHART} AS part, {_RID} AS rid")


@query(f"""WITH used AS ({_USED}), rels AS ({_RELS}), parts AS ({_PARTS}), shapes AS ({_SHAPE_IDS}), charts AS ({_CHARTS}), inside AS (SELECT * FROM rels WHERE mode IS DISTINCT FROM 'External')
SELECT package, 'dangling_rid' AS category, part, rid AS detail FROM used ANTI JOIN rels USING (package, part, rid)
UNION ALL SELECT package, 'missing_target', part, target FROM inside WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.package = inside.package AND parts.part = inside.target)
UNION ALL SELECT package, 'duplicate_id', part, CAST(shape_id AS VARCHAR) FROM shapes GROUP BY package, part, shape_id HAVING count(*) > 1
UNION ALL SELECT package, 'shared_part', target, CAST(count(*) AS VARCHAR) FROM inside WHERE regexp_matches(target, '/(tags|charts|embeddings|diagrams)/') GROUP BY package, target HAVING count(*) > 1
UNION ALL SELECT package, 'chart_data', part, coalesce(split_part(type, '/', -1), 'missing') FROM charts LEFT JOIN rels USING (package, part, rid) WHERE type IS NULL OR NOT ends_with(type, '/package')""")
def package_check(spark, sf):
    return deck.package_issues(*[shared(spark, sf, q, "part") for q in (_USED, _RELS, _PARTS, _SHAPE_IDS, _CHARTS)])


# --- streams, files and joins with tables ---------------------------------------------------------------------


@query(SQL_ACQUIRE + " SELECT url, engine_used, CASE WHEN won IS NOT NULL THEN 200 END AS status, n AS bytes, CASE WHEN won = 2 THEN 1 WHEN won IS NULL THEN 2 ELSE 0 END AS failed, CASE WHEN won IS NULL THEN details END AS error FROM g")
def stream_acquire(spark, sf):
    """tiered_acquire's outcomes from a stream of response files, each engine's in files of its own."""
    top = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    h, b = asked_in_turn(spark, sf)
    for r in (b, h):  # what comes first is what would be asked last
        r.withColumn("captured", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))).write.mode("append").parquet(f"{top}/in")
    # Both engines answer every visit, however many batches lie between: no wait ends before.
    stream.acquire_stream(spark, f"{top}/in", f"{top}/out", f"{top}/state", files=64, visit="page_id", wait="36500 days")
    got = gate.merged(spark.read.parquet(f"{top}/out"), "page_id")
    return got.select("url", "engine_used", "status", F.octet_length("data").cast("long").alias("bytes"), gate.engines_failed(F.col("attempts")).alias("failed"), "error")


@query(SQL_FILL + f", o AS (SELECT deck, page, src, CAST(row_number() OVER (PARTITION BY deck ORDER BY page) AS INT) AS slide FROM d WHERE src <> 99), b AS (SELECT CAST(o.deck AS VARCHAR) AS package, slide, sl.sid, CASE WHEN f.sid IS NULL THEN 'S' || src || '-' || sl.sid || ' old' ELSE f.text END AS text FROM o JOIN sl ON i = src LEFT JOIN f ON f.deck = o.deck AND f.page = o.page AND f.sid = sl.sid) SELECT * FROM b WHERE {sql_strip('text')} <> ''")
def deck_files(spark, sf):
    """deck_build's packages as files, written and read by the data source, of whose columns only these are read."""
    slide_source.register(spark)
    top = f"{scratch(spark)}/decks-{uuid.uuid4().hex}"
    built(spark, sf, False).select("deck", "data").write.format("slides").mode("append").save(top)
    got = spark.read.format("slides").schema("package string, slide int, sid int, text string").load(top)
    return got.withColumn("package", F.regexp_extract("package", r"([^/]*)\.pptx$", 1))


_KEYWORDS = r"SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[ \t\r\n]+')) AS word FROM documents) WHERE length(word) BETWEEN 6 AND 40"


@query(f"WITH k AS ({_KEYWORDS}), t AS (SELECT page_id, {SQL_TITLE} AS title FROM pages) SELECT page_id, word AS keyword FROM t JOIN k ON contains(title, word)")
def keyword_matches(spark, sf):
    """Which of the documents' words the pages' titles hold."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("word")).where(F.length("word").between(6, 40))
    return keywords.matches(page_title(spark, sf), words, "title", "word").select("page_id", "keyword")


_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
#: Domains that pages derive: the last two labels of every host, and every host of an even number of letters.
_DOMAINS = f"SELECT DISTINCT unnest([regexp_extract(host, '([^.]+[.])?[^.]+$'), CASE WHEN length(host) % 2 = 0 THEN host END]) AS domain FROM (SELECT {_HOST} AS host FROM pages)"


@query(f"WITH d AS (SELECT domain FROM ({_DOMAINS}) WHERE domain <> ''), p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, (SELECT arg_max(domain, length(domain)) FROM d WHERE host = domain OR ends_with(host, '.' || domain)) AS domain FROM p")
def domain_match(spark, sf):
    """The longest of a table's domains that each page's host lies in."""
    rows = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)).alias("host"))
    own = F.array(F.regexp_extract("host", "([^.]+[.])?[^.]+$", 0), F.when(F.length("host") % 2 == 0, F.col("host")))
    return domains.longest(rows, rows.select(F.explode(own).alias("domain")).distinct())


@query("""SELECT event_id, click_id, seconds FROM (SELECT e.event_id, c.event_id AS click_id, epoch_us(e.ts) - epoch_us(c.ts) AS seconds FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts)""")
def events_last_click(spark, sf):
    """Each event's last click of the same user at or before it, and how many micros ago."""
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.col("event_id").alias("click_id"))
    got = temporal.as_of(e.select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "clicked")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return got.select("event_id", "click_id", (micros("ts") - micros("clicked")).alias("seconds"))


@query("""WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT event_id, o_orderkey, o_orderdate FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def events_last_order(spark, sf):
    """Each event's last order of the same customer."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return temporal.as_of(table(spark, sf, "events").select("event_id", "user_id", "ts"), o, ["user_id"], "ts", "o_orderdate").select("event_id", "o_orderkey", "o_orderdate")


_OPEN = "SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@query(f"WITH o AS ({_OPEN}) SELECT a.k AS first_order, b.k AS second_order, a.c AS custkey FROM o a JOIN o b ON a.c = b.c AND a.k < b.k AND a.s < a.e AND b.s < b.e AND a.s < b.e AND b.s < a.e")
def orders_open_together(spark, sf):
    """Orders of one customer, of which one was placed before the other was shipped."""
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", F.col("o_custkey").alias("custkey"), "o_orderdate").agg(F.max("l_shipdate").alias("shipped"))
    side = lambda p: o.select("custkey", F.col("o_orderkey").alias(f"{p}_order"), F.col("o_orderdate").alias(f"{p}_from"), F.col("shipped").alias(f"{p}_to"))
    met = temporal.overlaps(side("first"), side("second"), ["custkey"], ("first_from", "first_to"), ("second_from", "second_to"))
    return met.where("first_order < second_order").select("first_order", "second_order", "custkey")


# --- rollups, frames over time, cards as lines ----------------------------------------------------------------

_DAY = "CAST(date_trunc('day', ts) AS DATE)"
_SETS = [["event_type", "day"], ["event_type"], ["day"], []]


@query(f"""WITH e AS (SELECT *, {_DAY} AS day FROM events) SELECT event_type, day, CAST(CASE grouping_id(event_type, day) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS level, count(*) AS rows, round(sum(value), 2) AS total, true AS users_near, true AS median_near FROM e GROUP BY GROUPING SETS ((event_type, day), (event_type), (day), ())""")
def events_cube(spark, sf):
    """Counts and sums of events by type and day and all that is coarser, from stored cells; whether distinct users and medians from sketches are within three per cent (of the count; of ranks) of exact ones."""
    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("date").alias("day"), "user_id", "value")
    path = f"{scratch(spark)}/cells-{uuid.uuid4().hex}"
    for half in (0, 1):  # cells of two loads, appended
        rollup.cells(e.where(F.col("user_id") % 2 == half), ["event_type", "day"], "user_id", "value").write.mode("append").parquet(path)
    got = rollup.merged(spark.read.parquet(path), ["event_type", "day"], _SETS).select("event_type", "day", "level", "rows", "total", rollup.distinct(F.col("users")).alias("about"), rollup.quantile(F.col("levels"), 0.5).alias("middle"))
    # The exact ones, for comparison: rows of each set, joined with its median.
    each = e.select(F.explode(F.array(*(F.struct(*((F.col(d) if d in s else F.lit(None).cast(t)).alias(d) for d, t in (("event_type", "string"), ("day", "date"))), F.lit(k).alias("level")) for k, s in enumerate(_SETS)))).alias("g"), "user_id", "value").select("g.*", "user_id", "value")
    by = [F.col("a.level") == F.col("b.level"), F.col("a.event_type").eqNullSafe(F.col("b.event_type")), F.col("a.day").eqNullSafe(F.col("b.day"))]
    ranked = each.alias("a").join(got.select("event_type", "day", "level", "middle").alias("b"), by).select("a.*", "middle")
    exact = ranked.groupBy("event_type", "day", "level").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") < F.col("middle")).alias("under"), F.count_if(F.col("value") <= F.col("middle")).alias("upto"), F.count("value").alias("n"))
    out = got.alias("a").join(exact.alias("b"), by)
    near = (F.col("under") <= 0.53 * F.col("n") + 1) & (F.col("upto") >= 0.47 * F.col("n") - 1)
    return out.select("a.event_type", "a.day", "a.level", "rows", F.round("total", 2).alias("total"), (F.abs(F.col("about") - F.col("users")) <= 0.03 * F.col("users") + 0.5).alias("users_near"), near.alias("median_near"))


_GAP = "6 hours"
SQL_SESSIONS = """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM m)
SELECT user_id, epoch_us(min(ts)) AS begun, epoch_us(max(ts)) + 21600000000 AS ended, count(*) AS rows, round(sum(value), 2) AS total FROM n GROUP BY user_id, no"""


def _sessions(e: DataFrame, late: str | None = None) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c))
    got = frames.sessions(e, "user_id", "ts", _GAP, late, total=F.sum("value"))
    return got.select("user_id", micros("start").alias("begun"), micros("end").alias("ended"), "rows", F.round("total", 2).alias("total"))


def timed(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(SQL_SESSIONS)
def events_sessions(spark, sf):
    return _sessions(timed(spark, sf))


@query(SQL_SESSIONS)
def stream_sessions(spark, sf):
    """The same sessions from a stream of files, closed by an event long after."""
    top = f"{scratch(spark)}/sessions-{uuid.uuid4().hex}"
    e = timed(spark, sf).select("user_id", "ts", "value")
    e.write.parquet(f"{top}/in")
    e.agg((F.max("ts") + F.expr("INTERVAL 900 days")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(0.0).alias("value")).where("ts IS NOT NULL").write.mode("append").parquet(f"{top}/in")
    rows = spark.readStream.schema(e.schema).parquet(f"{top}/in")
    ingest.run(_sessions(rows, "800 days"), f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.parquet(f"{top}/out").where("user_id >= 0")


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)")
def events_preceding(spark, sf):
    """How many events each user had in the twelve hours up to each event, and their sum."""
    got = frames.preceding(timed(spark, sf), "user_id", "ts", 12 * 3600, n=lambda w: F.count(F.lit(1)).over(w), total=lambda w: F.sum("value").over(w))
    return got.select("event_id", "n", F.round("total", 2).alias("total"))


def card_line_rows(spark, sf) -> DataFrame:
    """Card texts as tables of lines, as a text source gives them."""
    return shared(spark, sf, _CARDS, "documents").select("card", F.posexplode(F.split("text", "\n")).alias("no", "line"))


@query(ORACLE["card_pages"])
def card_lines(spark, sf):
    """card_pages() of cards whose lines are rows, by a table function."""
    return cardlines.read_card_lines(card_line_rows(spark, sf))[0].select("card", "page", "kind", "title", "subtitle")


@query(ORACLE["card_errors"])
def card_line_errors(spark, sf):
    return cardlines.read_card_lines(card_line_rows(spark, sf))[1]


# --- discovery by words, diagnosis and faults of packages -----------------------------------------------------

#: Searches are twenties of pages. By turns: answered at once; refused at first; refused by all; answered without results; asked of no engine.
_SEARCHES = "SELECT DISTINCT CAST(floor(page_id / 20) AS BIGINT) AS query FROM pages"


def asked(spark, sf) -> DataFrame:
    q = shared(spark, sf, _SEARCHES, "pages")
    return q.select("query", F.when(F.col("query") % 2 == 0, F.lit("site.org")).alias("site"), F.concat(F.lit("words "), F.col("query").cast("string")).alias("words"))


def answers(spark, sf) -> DataFrame:
    """Captured responses of both engines to the searches."""
    p = table(spark, sf, "pages").select(F.expr("page_id DIV 20").alias("query"), F.struct("page_id", F.expr(_HIT).alias("h")).alias("s"))
    # Twenty results a page.
    html = p.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["h"]), "\n").alias("hits"))
    q = asked(spark, sf).join(html, "query").withColumn("url", discover.search_url(F.col("site"), F.col("words"))).withColumn("k", F.col("query") % 5)
    page = lambda title, body: F.concat(F.lit(f"<html><title>{title}</title><!--{'x' * 600}-->"), body, F.lit("</html>"))
    good, refused, none = page("w_360搜索", F.col("hits")), page("访问异常页面", F.lit("")), page("w_360搜索", F.lit("nothing"))
    own = F.when(F.col("k") == 3, none).otherwise(good)
    one = lambda engine, html_: q.where("k <> 4").select("url", F.lit(engine).alias("engine"), F.encode(html_, "UTF-8").alias("data"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status"))
    return one("http", F.when(F.col("k").isin(1, 2), refused).otherwise(own)).unionByName(one("browser", F.when(F.col("k") == 2, refused).otherwise(own)))


SQL_ASKED = "WITH a AS (SELECT page_id // 20 AS query, page_id, url, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS rank FROM pages WHERE page_id % 4 <> 0), q AS (SELECT DISTINCT page_id // 20 AS query FROM pages), h AS (SELECT query, 'Hit ' || page_id || '&' AS title, url, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 10 AND query % 5 < 2)"


@query(SQL_ASKED + " SELECT * FROM h")
def word_discovery(spark, sf):
    return discover.by_words(asked(spark, sf), answers(spark, sf))[0]


@query(SQL_ASKED + """ SELECT query, CASE query % 5 WHEN 2 THEN 'blocked' WHEN 4 THEN 'invalid_response' ELSE 'no_match' END AS kind, CASE query % 5 WHEN 2 THEN 'challenge；challenge' WHEN 4 THEN 'no response' ELSE 'no results' END AS detail FROM q ANTI JOIN h USING (query)""")
def word_discovery_errors(spark, sf):
    return discover.by_words(asked(spark, sf), answers(spark, sf))[1]


@query("WITH q AS (SELECT page_id // 20 AS query, count(*) AS n FROM pages GROUP BY 1), e AS (SELECT unnest(['http', 'browser']) AS engine) SELECT 'https://www.so.com/s?q=' || CASE WHEN query % 2 = 0 THEN 'site%3Asite.org+' ELSE '' END || 'words+' || query AS url, engine, CASE WHEN query % 5 = 2 OR (query % 5 = 1 AND engine = 'http') THEN 'challenge' ELSE 'pass' END AS verdict, CASE WHEN query % 5 = 2 OR (query % 5 = 1 AND engine = 'http') OR query % 5 = 3 THEN 0 ELSE CAST(n AS INTEGER) END AS result_blocks FROM q, e WHERE query % 5 <> 4")
def diagnose_search(spark, sf):
    """What each engine's answer to each search holds."""
    r = answers(spark, sf)
    html = r.select("url", "engine", F.col("data").cast("string").alias("html"))
    return diagnose.search_steps(diagnose.describe(r), html).select("url", "engine", "verdict", F.col("result_blocks").cast("int").alias("result_blocks"))


_ROOTS = "SELECT site, unnest(CASE WHEN starts_with(site, 'www.') THEN ['https://' || site] ELSE ['https://' || site, 'https://www.' || site] END) AS root FROM s"


@query(f"""WITH s AS ({_SITES}), r AS ({_ROOTS}) SELECT r.site, root, CASE WHEN k = 0 THEN root || '/a.xml|' || root || '/gone.xml' END AS declared, CASE WHEN k = 1 THEN true END AS is_xml, CASE WHEN k = 2 AND first % 2 = 0 THEN 'challenge' END AS robots_kind, CAST(NULL AS VARCHAR) AS sitemap_kind FROM r LEFT JOIN s ON root = 'https://' || s.site""")
def diagnose_sitemaps(spark, sf):
    """What robots.txt and sitemap.xml of each site's roots are."""
    return diagnose.sitemap_steps(*sitemap_files(spark, sf)).withColumn("declared", F.array_join("declared", "|"))


@query(f"""WITH s AS ({_SITES}), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY length(root)) AS ord, length(root) % 3 = 0 AS here FROM ({_ROOTS}))
SELECT site, arg_min(root, (NOT here, CASE WHEN here THEN ord ELSE -ord END)) AS url, 'http' AS engine, CASE WHEN bool_or(here) THEN 200 END AS status, CASE WHEN bool_or(here) THEN 'pass' END AS verdict, CASE WHEN NOT bool_or(here) THEN 'ReadTimeout: timed out' END AS error FROM r GROUP BY site""")
def diagnose_entry(spark, sf):
    """By site the first root that answered, else the last one's error."""
    roots = shared(spark, sf, _SITES, "pages").select("site", F.posexplode(U.roots(F.col("site"))).alias("ord", "url"))
    here = F.length("url") % 3 == 0
    r = roots.select("url").distinct().select("url", F.lit("http").alias("engine"), F.when(here, F.encode(F.lit("<html>" + "x" * 600), "UTF-8")).alias("data"), F.lit("text/html").alias("content_type"), F.when(here, 200).alias("status"), F.when(~here, "ReadTimeout").alias("error_class"), F.lit("timed out").alias("error_message"))
    return diagnose.entry(diagnose.describe(r), roots)


_PDF_PAGES = "SELECT concat('p', CAST(floor(doc_id / 3) AS BIGINT)) AS url, CAST(doc_id % 3 + 1 AS INT) AS page, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 < 3 THEN concat('Short ', doc_id) ELSE concat('Title ', doc_id, '{nl}', regexp_replace(substr(text, 1, 900), '[^a-zA-Z]+', '-'{g})) END AS text, 3 AS total_pages, doc_id % 30 < 3 AS encrypted, CASE WHEN doc_id % 12 = 0 THEN concat(' Meta ', doc_id) END AS meta_title FROM documents"


@query(f"""WITH p AS ({_PDF_PAGES.format(nl="' || chr(10) || '", g=", 'g'")}), w AS (SELECT url, {sql_strip("string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page)")} AS whole, bool_or(encrypted) AS e, max(meta_title) AS m FROM p GROUP BY url)
SELECT url, 3 AS pages, CASE WHEN NOT e THEN coalesce(nullif({sql_strip('m')}, ''), left({sql_strip("split_part(whole, chr(10), 1)")}, 80)) END AS title, CASE WHEN e THEN '' ELSE left(whole, 600) END AS head, CASE WHEN e THEN 'encrypted' WHEN length(whole) < 50 THEN 'little text' ELSE '' END AS error FROM w""")
def diagnose_pdf(spark, sf):
    """The beginnings of PDF records made of page texts."""
    return diagnose.pdf_head(pages.pdf_records(shared(spark, sf, _PDF_PAGES.format(nl="\n", g=""), "documents")))


#: Parts of packages from documents: by turns XML that is broken, that declares entities, and that is right; every seventh has no presentation.
_PACKED = """SELECT package, x.part AS part, x.text AS text FROM (SELECT doc_id AS package, explode(array(struct('[Content_Types].xml' AS part, '<Types/>' AS text), struct(IF(doc_id % 7 = 0, 'ppt/none.xml', 'ppt/presentation.xml') AS part, '<p/>' AS text), struct('ppt/slides/slide1.xml' AS part, CASE doc_id % 4 WHEN 0 THEN '<a><b></a>' WHEN 1 THEN '<!DOCTYPE x><a/>' ELSE '<a/>' END AS text))) AS x FROM documents)"""


@query("""WITH d AS (SELECT doc_id AS package, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '/ppt/slides/slide1.xml' END AS part, CASE WHEN doc_id % 7 = 0 OR doc_id % 4 = 0 THEN 'broken' WHEN doc_id % 4 = 1 THEN 'unsafe' END AS fault FROM documents) SELECT CAST(package AS VARCHAR) AS package, part, fault FROM d WHERE fault IS NOT NULL""")
def package_faults(spark, sf):
    """Parts of packages that can't or mustn't be parsed, and packages that are none."""
    parts = shared(spark, sf, _PACKED, "documents").select(F.col("package").cast("string").alias("package"), "part", F.encode("text", "UTF-8").alias("data"))
    return decks.faults(writer.zipped(parts, "package"))
