"""Two-tier policy search over captured responses: a JSON library and listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed
from .gate import keep_first

DAYS = {"d": 1, "w": 7, "m": 31, "y": 366}
LIBRARY = "struct<searchVO:struct<listVO:array<struct<title:string,url:string,pubtime:bigint,puborg:string,pcode:string>>>>"


def _answer(raw: DataFrame) -> Column:
    return (F.col("ord") if "ord" in raw.columns else F.lit(0)).cast("long").alias("answer")


def library_candidates(raw: DataFrame, limit: int = 5, timelimit: str = "all", as_of: str = "2024-01-01", native: bool = False) -> DataFrame:
    """Candidates of (dept, puborg_keys, raw JSON): with url and time, in time, of a publisher that holds a key; the first ``limit`` by dept.

    A department may have several answers, in the order of ``ord`` if there is such a column.
    """
    rows = F.coalesce(F.from_json("raw", LIBRARY)["searchVO"]["listVO"], F.array())
    df = raw.select("dept", "dept_name", "puborg_keys", _answer(raw), F.posexplode(rows).alias("pos", "x")).select("dept", "dept_name", "puborg_keys", "answer", "pos", "x.*")
    published = F.to_date(F.timestamp_millis("pubtime"))
    df = df.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("pubtime", F.lit(0)) != 0)).withColumn("published", published)
    if timelimit != "all":
        df = df.where(F.col("published") >= F.date_sub(F.lit(as_of).cast("date"), DAYS[timelimit]))
    keys = F.col("puborg_keys")
    df = df.where((F.size(keys) == 0) | F.exists(keys, lambda k: F.contains(F.coalesce("puborg", F.lit("")), k)))
    df = df.withColumn("n", F.row_number().over(Window.partitionBy("dept").orderBy("answer", "pos"))).where(F.col("n") <= limit)
    title = F.coalesce("title", F.lit(""))
    clean = T.strip(T.unescape_some(F.regexp_replace(title, "<[^>]+>", ""))) if native else T.strip_tags(title)
    return df.select("dept", "dept_name", clean.alias("title"), "url", F.date_format("published", "yyyy-MM-dd").alias("date"), "puborg", "pcode", F.lit("policy_library").alias("source_tier"), F.col("n").alias("pos"))


def normal_date(x: Column) -> Column:
    return F.when(F.length(x) == 8, F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).when(F.length(x) == 4, x)


def listing_links(raw: DataFrame, pattern: str | Column) -> DataFrame:
    """(dept, dept_name, list_url, answer, pos, href, hint, title) of listing pages, answer being ``ord`` or 0; the pattern, one or each row's own, has the last three as groups."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.arrays_zip(*[F.regexp_extract_all("raw", p, F.lit(k)).alias(n) for k, n in ((1, "href"), (2, "hint"), (3, "title"))])
    return raw.select("dept", "dept_name", "list_url", _answer(raw), F.posexplode(found).alias("pos", "x")).select("dept", "dept_name", "list_url", "answer", "pos", "x.*")


def listing_candidates(raw: DataFrame, pattern: str, keywords: list[str] | DataFrame, limit: int = 5, native: bool = False) -> DataFrame:
    """Candidates of (dept, dept_name, list_url, raw HTML) whose title holds any keyword, the first ``limit`` by dept. keywords: a list, or a table (keyword) of any size."""
    return link_candidates(listing_links(raw, pattern), keywords, limit, native)


def link_candidates(links: DataFrame, keywords: list[str] | DataFrame, limit: int = 5, native: bool = False) -> DataFrame:
    """Candidates of listing_links()'s rows."""
    from .keywords import holding
    from .pages import absolute

    title = T.strip(F.col("title"))
    if isinstance(keywords, DataFrame):
        rows = links.withColumn("id", F.concat_ws("|", "dept", "answer", "pos", "list_url")).withColumn("title", title)
        hits = holding(rows, keywords, "title", "keyword").drop("id")
    else:
        hit = F.lit(not keywords)
        for k in keywords:
            hit = hit | F.contains(title, F.lit(k))
        hits = links.where(hit)
    df = hits.withColumn("n", F.row_number().over(Window.partitionBy("dept").orderBy("answer", "pos"))).where(F.col("n") <= limit)
    url = absolute(F.col("list_url"), F.col("href"))
    if not native:
        from ..functions import url as U

        url = F.coalesce(url, U.join(F.col("list_url"), F.col("href")))
    return df.select("dept", "dept_name", title.alias("title"), url.alias("url"), normal_date(F.col("hint")).alias("date"), F.lit(None).cast("string").alias("puborg"), F.lit(None).cast("string").alias("pcode"), F.lit("official_site").alias("source_tier"), F.col("n").alias("pos"))


def union_first(tiers: list[DataFrame], plan: DataFrame) -> DataFrame:
    """All tiers in plan order (plan_no, dept, source_tier), keeping the first row of each url."""
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return keep_first(out.join(plan, ["dept", "source_tier"]), ["url"], ["plan_no", "pos"]).drop("plan_no", "pos")


def tier_errors(state: DataFrame) -> DataFrame:
    """(dept, tier, kind, detail) of plan rows without candidates: (dept, tier, fetched, fetch_error, links, matched).

    A listing without a single link has a stale pattern; one with links of which none matched is empty, not broken.
    """
    text = F.col("fetch_error")
    classified = F.when(F.startswith(text, F.lit("HTTP ")), "http_error").when(F.contains(F.lower(text), F.lit("timed out")) | F.contains(text, F.lit("超时")), "network_unreachable").when(F.rlike(text, F.lit("疑似反爬|验证|访问异常")), "blocked").otherwise("invalid_response")
    kind = F.when(~F.col("fetched"), "invalid_response").when(text.isNotNull(), classified).when((F.col("tier") == "official_site") & (F.col("links") == 0), "invalid_response").when(F.col("matched") == 0, "no_match")
    detail = F.when(~F.col("fetched"), "missing").when(text.isNotNull(), text).when((F.col("tier") == "official_site") & (F.col("links") == 0), "stale pattern").when(F.col("matched") == 0, "no match")
    return state.select("dept", "tier", kind.alias("kind"), detail.alias("detail")).where("kind IS NOT NULL")


def plan(depts: DataFrame, departments: DataFrame) -> DataFrame:
    """(plan_no, dept, tier, url): by department (code, ord) its library's address, then its listing's if it has one."""
    d = depts.join(departments, "code")
    urls = F.array(F.struct(F.lit("policy_library").alias("tier"), F.concat(F.lit("library:"), F.col("code")).alias("url")), F.struct(F.lit("official_site").alias("tier"), F.col("list_url").alias("url")))
    each = d.select("ord", F.col("code").alias("dept"), F.posexplode(urls).alias("k", "x")).where(F.col("x.url").isNotNull())
    return each.select((F.col("ord") * 2 + F.col("k")).alias("plan_no"), "dept", F.col("x.tier").alias("tier"), F.col("x.url").alias("url"))


def search(plan_: DataFrame, fetched: DataFrame, departments: DataFrame, keywords: list[str] | DataFrame, limit: int = 5, timelimit: str = "all", as_of: str = "2024-01-01", native: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tiers from a plan: (candidates, errors). fetched: (url, raw, error) and, where a department has several answers, ord.

    Candidates are those of all tiers in plan order, each url once. Errors (dept, dept_name, tier, kind, detail,
    site_domain) are of plan rows without answer, with a failed one, with a page whose links its pattern doesn't find, or with none that fits.
    """
    answers = plan_.join(fetched, "url", "left").join(departments.select(F.col("code").alias("dept"), F.col("name").alias("dept_name"), "puborg_keys", "list_url", "link_pattern"), "dept")
    fine = answers.where(F.col("raw").isNotNull() & F.col("error").isNull())
    # Every department's pages by its own pattern, parsed once for the counts and the candidates.
    links = checkpointed(listing_links(fine.where("tier = 'official_site' AND link_pattern IS NOT NULL"), F.col("link_pattern")))
    found = links.groupBy("dept").agg(F.count(F.lit(1)).cast("int").alias("links"))
    tiers = [library_candidates(fine.where("tier = 'policy_library'"), limit, timelimit, as_of, native), link_candidates(links, keywords, limit, native)]
    matched = tiers[0].unionByName(tiers[1]).groupBy("dept", F.col("source_tier").alias("tier")).agg(F.count(F.lit(1)).cast("int").alias("matched"))
    per = answers.groupBy("dept", "tier").agg(F.max(F.col("raw").isNotNull() | F.col("error").isNotNull()).alias("fetched"), F.max("error").alias("fetch_error"))
    state = per.join(found, "dept", "left").join(matched, ["dept", "tier"], "left").fillna(0, ["links", "matched"])
    errors = tier_errors(state).join(departments.select(F.col("code").alias("dept"), F.col("name").alias("dept_name"), "site_domain"), "dept", "left")
    errors = errors.select("dept", F.coalesce("dept_name", "dept").alias("dept_name"), "tier", "kind", "detail", F.coalesce("site_domain", F.lit("")).alias("site_domain"))
    return union_first(tiers, plan_.select("plan_no", "dept", F.col("tier").alias("source_tier"))), errors


def counts(candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """(what, n): candidates by tier, and errors but those that say that nothing matched."""
    return candidates.groupBy(F.col("source_tier").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(errors.agg(F.lit("errors").alias("what"), F.count_if(F.col("kind") != "no_match").alias("n")))
