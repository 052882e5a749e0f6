"""Odd tables for the URL filter and the extraction: clashing columns with rows, ties, nulls, repeats, one key that most rows share."""

from pyspark.sql import functions as F

from sluiceway.llm import htmltext, urlfilter

CLASH = ["host", "path", "token", "best", "rank", "name", "verdict", "pattern", "rule", "listed", "text", "n_chars", "deal", "deals", "side", "kind", "value", "importance"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def test_url_filter_clashes_ties_and_bare_rows(spark):
    rules = [urlfilter.Rule("a", "block", "^[^/]*/x", ("x",), 5, True), urlfilter.Rule("b", "allow", "^[^/]*/x/y", ("x", "y"), 5, False), urlfilter.Rule("c", "block", "^[^/]*/z", ("z",), 9, False)]
    rows = [(1, "http://h/x"), (2, "http://h/x/y"), (2, "http://h/x/y"), (3, None), (4, "no scheme /x"), (None, "http://h/z"), (5, ""), (6, "http://h/other"), (7, "http://"), (8, "http://h" + "/x" * 50_000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    got = sorted(((r.page_id, r.rule, r.verdict, r.pattern) for r in urlfilter.url_filter(df, rules).collect()), key=repr)
    # Of equal ranks the last name wins; a rule that isn't listed is no ``rule``.
    want = [(1, "a", "block", "a"), (2, None, "allow", "b"), (2, None, "allow", "b"), (3, None, "allow", None), (4, None, "allow", None), (None, None, "block", "c"), (5, None, "allow", None), (6, None, "allow", None), (7, None, "allow", None), (8, "a", "block", "a")]
    assert got == sorted(want, key=repr)


def test_url_filter_many_bare_rows_pass_round_the_join(spark):
    """Rows without a URL, which are most, are in no join."""
    df = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 10 = 0 THEN concat('http://h', id, '.net/') END AS url")
    got = urlfilter.url_filter(df)
    assert got.count() == 3000 and got.where("rule = 'net/'").count() == 300 and got.where("verdict = 'allow' AND host = ''").count() == 2700


def test_html_clashes_and_repeats(spark):
    page = "<article><h1>T</h1><p>Body text here.</p></article><footer>foot</footer>"
    rows = [(1, "http://h/a", page), (1, "http://h/a", page), (2, None, page), (None, "http://h/b", page), (3, "http://h/c", None), (4, "http://h/d", ""), (5, "http://h/e", "<p>" + "long " * 100_000 + "</p>")]
    got = sorted(((r.page_id, r.url, r.text[:20], r.n_chars) for r in htmltext.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()), key=repr)
    text = "T\n\nBody text here."
    assert got == sorted([(1, "http://h/a", text, len(text))] * 2 + [(2, None, text, len(text)), (None, "http://h/b", text, len(text)), (3, "http://h/c", "", 0), (4, "http://h/d", "", 0), (5, "http://h/e", ("long " * 4), 499_999)], key=repr)
