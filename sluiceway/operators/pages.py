"""Clean records and links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from .gate import MIN_TEXT, is_pdf

ATTACHMENT = r"(?i)\.(pdf|docx?|xlsx?|ofd|wps)$"
SKIPPED_SCHEMES = ("#", "javascript:", "mailto:", "tel:")


def clean_records(pages: DataFrame, max_chars: int = 8000, native: bool = True) -> DataFrame:
    """(page_id, url, type, title, length, truncated, text, error) per page; pages of under MIN_TEXT characters are errors without text.

    length is that of the whole text. native=False parses any markup; else expressions alone do.
    """
    text = H.clean_text(F.col("html")) if native else H.parse_page(F.col("html"))["text"]
    df = pages.select("page_id", "url", F.lit("html").alias("type"), H.title(F.col("html")).alias("title"), text.alias("whole"))
    n = F.length("whole")
    fine = n >= MIN_TEXT
    return df.select("page_id", "url", "type", F.when(fine, F.col("title")).alias("title"), F.when(fine, n).alias("length"), F.when(fine & (n > max_chars), F.lit(True)).alias("truncated"), F.when(fine, T.truncate(F.col("whole"), max_chars)).alias("text"), F.when(~fine, F.lit("body too short")).alias("error"))


def raw_links(pages: DataFrame, native: bool = True) -> DataFrame:
    """(page_id, base, pos, href, text) of all anchors in order. Pages whose anchors aren't all of the plain form go through the parser in any case, and no others."""
    rows = lambda df, links: df.select("page_id", F.col("url").alias("base"), F.explode(links).alias("x")).select("page_id", "base", F.col("x.pos").alias("pos"), F.col("x.href").alias("href"), F.col("x.text").alias("text"))
    parsed = H.parse_page(F.col("html"))["links"]
    if not native:
        return rows(pages, parsed)
    plain = F.transform(H.anchors(F.col("html")), lambda x, i: F.struct(i.cast("int").alias("pos"), x["href"].alias("href"), x["text"].alias("text")))
    opened = lambda x: F.regexp_count(x, F.lit(r"(?i)<a[\s>]"))
    quiet = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    regular = F.coalesce((opened(F.col("html")) == F.size(plain)) & (opened(quiet) == F.size(plain)), F.lit(False))
    return rows(pages.where(regular), plain).unionByName(rows(pages.where(~regular), parsed))


def absolute(base: Column, href: Column) -> Column:
    """Absolute paths and absolute URLs JVM-side; everything else by the resolver."""
    return F.when(F.rlike(href, F.lit("^/[^/]")), F.concat(F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1), href)).when(F.rlike(href, F.lit("^https?://")), href)


def resolve(links: DataFrame) -> DataFrame:
    """Links to http and https, with the absolute ``url``; by page and url the first place and the first text that isn't empty."""
    skip = F.lit(False)
    for s in SKIPPED_SCHEMES:
        skip = skip | F.startswith("href", F.lit(s))
    some = links.where(~skip & (F.col("href") != "")).withColumn("url", absolute(F.col("base"), F.col("href")))
    ok = some.withColumn("url", F.coalesce("url", U.join(F.col("base"), F.when(F.col("url").isNull(), F.col("href")))))  # the resolver gets nulls for the others
    ok = ok.where(F.rlike("url", F.lit("^https?://")))
    return ok.groupBy("page_id", "base", "url").agg(F.min("pos").alias("pos"), F.coalesce(F.min_by("text", F.when(F.col("text") != "", F.col("pos"))), F.lit("")).alias("text"))


def split_links(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attachments, page links): attachments of any host by the path's ending; pages of the same site that have text."""
    ext = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), ATTACHMENT, 1))
    df = resolved.withColumn("ext", ext)
    attachments = df.where("ext <> ''").select("page_id", "pos", "url", "ext", "text")
    inner = df.where((F.col("ext") == "") & (F.col("text") != "") & U.same_site(F.col("url"), F.col("base"))).select("page_id", "pos", "url", "text")
    return attachments, inner


def numbered(links: DataFrame) -> DataFrame:
    """rank instead of pos: 1, 2, ... by page."""
    return links.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).drop("pos")


def raw_records(outcomes: DataFrame) -> DataFrame:
    """(url, engine_used, status, content_type, degraded, length, raw, error): a response's text as it came; a PDF is an error, and so is what has no response."""
    text = codec.decode(F.col("data"), codec.charset(F.col("data"), F.col("content_type")))
    pdf = is_pdf(F.col("data"), F.col("content_type"))
    fine = F.col("error").isNull() & ~pdf
    df = outcomes.withColumn("raw", F.when(fine, text))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(pdf, F.lit("a PDF has no raw text"))
    return df.select("url", "engine_used", "status", "content_type", F.when(F.col("attempts").isNotNull(), F.lit(True)).alias("degraded"), F.length("raw").alias("length"), "raw", error.alias("error"))


def fetch(outcomes: DataFrame, max_chars: int = 8000, raw: bool = False, include_links: bool = False) -> DataFrame:
    """Records of acquired responses: raw ones, or clean ones, with their attachments and, if asked for, page links.

    attachments and links are null where there are none. One parse of each page.
    """
    if raw:
        return raw_records(outcomes)
    pdf = is_pdf(F.col("data"), F.col("content_type"))
    html = codec.decode(F.col("data"), codec.charset(F.col("data"), F.col("content_type")))
    df = outcomes.withColumn("html", F.when(F.col("error").isNull() & ~pdf, html)).withColumn("page", H.parse_page(F.col("html")))
    whole, n = F.col("page.text"), F.length("page.text")
    fine = F.coalesce(n >= MIN_TEXT, F.lit(False))
    records = df.select("url", "engine_used", F.when(fine, F.lit("html")).when(F.col("error").isNull() & pdf, F.lit("pdf")).alias("type"), F.when(fine, H.title(F.col("html"))).alias("title"), F.when(fine, n).alias("length"), F.when(F.col("attempts").isNotNull(), F.lit(True)).alias("degraded"), F.when(fine & (n > max_chars), F.lit(True)).alias("truncated"), F.when(fine, T.truncate(whole, max_chars)).alias("text"), F.when(F.col("error").isNotNull(), F.col("error")).when(~pdf & ~fine, F.lit("body too short")).alias("error"))
    each = df.where(F.col("html").isNotNull()).select(F.col("url").alias("page_id"), F.col("url").alias("base"), F.explode("page.links").alias("x")).select("page_id", "base", F.col("x.pos").alias("pos"), F.col("x.href").alias("href"), F.col("x.text").alias("text"))
    attachments, inner = split_links(resolve(each))
    lists = [("attachments", attachments, ("url", "ext", "text"))] + ([("links", inner, ("url", "text"))] if include_links else [])
    for name, found, cols in lists:
        own = found.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias(name))  # noqa: B023
        records = records.join(own, records["url"] == own["page_id"], "left").drop("page_id")
    return records


def pdf_records(pages: DataFrame, max_chars: int = 8000, max_pages: int = 30) -> DataFrame:
    """Clean records of PDFs from page texts (url, page, text, total_pages, encrypted, meta_title).

    Pages are joined by a blank line; under 50 characters the record is of low confidence and keeps its text; encrypted
    files have no text.
    """
    read = pages.where(F.col("page") <= max_pages).groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n").alias("whole"), F.count(F.lit(1)).alias("pages_read"), F.max("total_pages").alias("pages"), F.max("encrypted").alias("encrypted"), F.max("meta_title").alias("meta_title"))
    whole = T.strip(F.col("whole"))
    title = F.coalesce(F.nullif(T.strip(F.col("meta_title")), F.lit("")), F.left(T.strip(F.element_at(F.split(whole, "\n"), 1)), F.lit(80)))
    low = F.length(whole) < 50
    return read.select("url", F.lit("pdf").alias("type"), F.when(~F.col("encrypted"), title).alias("title"), "pages", F.when(~F.col("encrypted"), F.col("pages_read").cast("int")).alias("pages_read"), F.when(~F.col("encrypted"), F.length(whole)).alias("length"), F.when(~F.col("encrypted") & low, F.lit(True)).alias("low_confidence"), F.when(F.col("encrypted"), F.lit("encrypted")).when(low, F.lit("little text")).alias("error"), F.when(~F.col("encrypted"), T.truncate(whole, max_chars)).alias("text"))
