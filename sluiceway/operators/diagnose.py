"""Diagnosis of a site from captured responses: facts and verdicts side by side, step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import html as H
from ..functions import url as U
from . import discover, gate, pages

MAX_LIST, HEAD_CHARS = 30, 600


def describe(responses: DataFrame, expect: str | None = None, native: bool = True) -> DataFrame:
    """(url, engine, elapsed, status, bytes, content_type, title, text_len, challenge_hit, verdict, error) of each response.

    PDFs have no title and no text; elapsed, if there is such a column, is rounded to tenths; a response with error_class
    has its error and nothing else. native=False decodes any charset and parses any markup.
    """
    data, kind = F.col("data"), F.col("content_type")
    pdf = gate.is_pdf(data, kind)
    html = F.when(~pdf, data.cast("string") if native else codec.decode(data, codec.charset(data, kind)))
    text = H.clean_text(html) if native else H.parse_page(html)["text"]
    lost = F.col("error_class").isNotNull() if "error_class" in responses.columns else F.lit(False)
    error = F.when(lost, F.concat_ws(": ", "error_class", "error_message")) if "error_class" in responses.columns else F.lit(None).cast("string")
    elapsed = F.bround(F.col("elapsed").cast("double"), 1) if "elapsed" in responses.columns else F.lit(None).cast("double")
    own = lambda x: F.when(~lost, x)
    return responses.select("url", "engine", elapsed.alias("elapsed"), own(F.col("status")).alias("status"), F.octet_length(data).alias("bytes"), own(kind).alias("content_type"), own(F.coalesce(H.title(html), F.lit(""))).alias("title"), own(F.coalesce(F.length(text), F.lit(0))).alias("text_len"), own(F.regexp_extract(gate.utf8_head(data), gate.CHALLENGE, 0)).alias("challenge_hit"), own(F.coalesce(gate.verdict(F.col("status"), data, kind, F.col("url"), expect), F.lit("pass"))).alias("verdict"), error.alias("error"))


def sitemap_steps(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """(site, root, declared, is_xml, robots_kind, sitemap_kind): each root's robots.txt and sitemap.xml."""
    roots = sites.select("site", F.explode(U.roots(F.col("site"))).alias("root"))
    of = lambda file, name: roots.select("site", "root", F.concat("root", F.lit(file)).alias("url")).join(fetched, "url", "left").select("site", "root", F.col("text").alias(f"{name}_text"), F.col("kind").alias(f"{name}_kind"))
    both = of("/robots.txt", "robots").join(of("/sitemap.xml", "sitemap"), ["site", "root"])
    return both.select("site", "root", discover.robots_sitemaps(F.col("robots_text")).alias("declared"), F.rlike("sitemap_text", F.lit(discover.XML)).alias("is_xml"), "robots_kind", "sitemap_kind")


def search_steps(described: DataFrame, html: DataFrame) -> DataFrame:
    """described with result_blocks: how many results a page (url, engine, html) holds."""
    blocks = html.select("url", "engine", F.regexp_count("html", F.lit(discover.RESULT)).alias("result_blocks"))
    return described.join(blocks, ["url", "engine"], "left")


def entry(described: DataFrame, candidates: DataFrame) -> DataFrame:
    """By site the first candidate (site, ord, url) that was answered at all, else the last one's error."""
    j = candidates.join(described, "url")
    best = F.min_by(F.struct("url", "engine", "status", "verdict", "error"), F.struct(F.col("error").isNotNull(), F.when(F.col("error").isNull(), F.col("ord")).otherwise(-F.col("ord"))))
    return j.groupBy("site").agg(best.alias("x")).select("site", "x.*")


def link_lists(attachments: DataFrame, inner: DataFrame, most: int = MAX_LIST) -> DataFrame:
    """(page_id, attachments_total, pages_total, attachments, pages): the totals of all, and the first of each in order."""
    def of(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
        numbered = pages.numbered(df)
        first = F.filter(F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", *cols)))), lambda x: x.isNotNull())
        return numbered.groupBy("page_id").agg(F.count(F.lit(1)).alias(f"{name}_total"), F.transform(first, lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias(name))

    both = of(attachments, "attachments", ["url", "ext", "text"]).join(of(inner, "pages", ["url", "text"]), "page_id", "full")
    return both.fillna(0, ["attachments_total", "pages_total"]).select("page_id", "attachments_total", "pages_total", "attachments", "pages")


def target(attachments: DataFrame, match: str) -> DataFrame:
    """(page_id, matched, url, text): how many attachments' texts a pattern finds, and the first of them."""
    hits = attachments.where(F.rlike("text", F.lit(f"(?i){match}")))
    return hits.groupBy("page_id").agg(F.count(F.lit(1)).alias("matched"), F.min_by(F.struct("url", "text"), "pos").alias("x")).select("page_id", "matched", "x.*")


def pdf_head(records: DataFrame, chars: int = HEAD_CHARS) -> DataFrame:
    """(url, pages, title, head, error) of PDF records."""
    return records.select("url", "pages", "title", F.left(F.coalesce("text", F.lit("")), F.lit(chars)).alias("head"), F.coalesce("error", F.lit("")).alias("error"))


def report(described: DataFrame) -> DataFrame:
    """(engine, verdict, n, bytes): what the engines' responses came to."""
    return described.groupBy("engine", F.coalesce("verdict", F.lit("error")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytes", F.lit(0)).cast("long")).alias("bytes"))


def query_url(base: str, site: Column, words: Column) -> Column:
    """The address of a search within a site."""
    return F.concat(F.lit(f"{base}?"), U.query_string(q=discover.site_query(site, words)))
