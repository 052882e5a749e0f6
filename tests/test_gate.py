import gzip

from pyspark.sql import functions as F

from sluiceway.functions import codec, text, url
from sluiceway.operators import discover, gate, pages

BIG = b"<html>" + b"x" * 600


def test_verdicts(spark):
    rows = [
        (200, BIG + b"$_ts", "text/html", "http://a", "challenge"), (412, BIG, "text/html", "http://a", "http_error"), (200, b"tiny", "text/html", "http://a", "empty_body"),
        (200, BIG, "text/html", "http://a", None), (200, b"%PDF-1", "application/octet-stream", "http://a", None), (200, BIG, "text/html", "http://a/b.pdf?x", "wrong_content_type"), (0, BIG, "text/html", "http://a", None),
        (200, b"<title>" + "访问异常".encode() + b"</title>" + BIG, None, "http://a", "challenge"),
    ]
    df = spark.createDataFrame(rows, "status int, data binary, content_type string, url string, want string")
    for r in df.select("*", gate.verdict(*map(F.col, ("status", "data", "content_type", "url"))).alias("got")).collect():
        assert r.got == r.want, r


def test_expected_structure(spark):
    df = spark.createDataFrame([(bytearray(BIG + b"<title>Results_360</title>"),), (bytearray(BIG),)], "data binary")
    got = df.select(gate.verdict(F.lit(200), F.col("data"), F.lit("text/html"), F.lit("http://a"), expect="Results_360").alias("v")).collect()
    assert [r.v for r in got] == [None, "unexpected_structure"]


def test_error_kinds(spark):
    df = spark.createDataFrame([("ReadTimeout", "x", "timeout"), ("E", "it timed out", "timeout"), ("E", "response too large", "too_large"), ("ConnectionError", "refused", "network")], "c string, m string, want string")
    assert all(r.got == r.want for r in df.select("want", gate.error_kind(F.col("c"), F.col("m")).alias("got")).collect())


def test_codec(spark):
    zh = "<meta charset=gb2312>中文内容"
    rows = [(gzip.compress(b"hi"), "gzip", None, "hi"), (gzip.compress(b"hi"), None, None, "hi"), (b"plain", "gzip", None, "plain"), (zh.encode("gb18030"), None, "text/html", zh), ("é".encode("latin-1"), None, "text/html", "é"), (b"\xe4\xb8\xad", None, None, "中")]
    df = spark.createDataFrame(rows, "data binary, encoding string, content_type string, want string")
    raw = df.withColumn("raw", codec.inflate("data", "encoding"))
    for r in raw.select("want", codec.decode("raw", codec.charset(F.col("raw"), F.col("content_type"))).alias("got")).collect():
        assert r.got == r.want


def test_text(spark):
    df = spark.createDataFrame([("　 a   b\n",)], "x string")
    r = df.select(text.strip(F.col("x")).alias("s"), text.collapse(F.col("x")).alias("c"), text.flatten(F.col("x")).alias("f")).first()
    assert (r.s, r.c, r.f) == ("a   b", "a b", "ab")


def test_anchor_text_never_leaks(spark):
    html = '<a href="/1">one<a href="/2"><img alt="two"></a><a href="/3"></a><a href="javascript:x">j</a><a href="https://sub.site.com/4">four</a><a href="https://other.com/5">five</a>'
    one = spark.createDataFrame([(1, "https://www.site.com/x", html)], "page_id long, url string, html string")
    got = pages.split_links(pages.resolve(pages.raw_links(one, native=False)))[1]
    assert {(r.url, r.text) for r in got.collect()} == {("https://www.site.com/1", "one"), ("https://www.site.com/2", "two"), ("https://sub.site.com/4", "four")}


def test_roots(spark):
    df = spark.createDataFrame([("iea.org",), ("http://www.x.cn",)], "s string")
    assert [r[0] for r in df.select(url.roots(F.col("s"))).collect()] == [["https://iea.org", "https://www.iea.org"], ["http://www.x.cn"]]


def test_expansion_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("c", "d", 0), ("b", "d", 1)], "parent string, child string, pos int")
    got = discover.expand(spark.createDataFrame([("a", 0)], "url string, ord int"), edges)
    assert [r.url for r in got.orderBy("n").collect()] == ["a", "b", "c", "d"]


def test_pdf_records(spark):
    rows = [("u", 1, "Title line\n" + "x" * 60, 3, False, None), ("u", 2, None, 3, False, None), ("e", 1, "x", 1, True, None), ("s", 1, "short", 1, False, "Meta")]
    got = {r.url: r for r in pages.pdf_records(spark.createDataFrame(rows, "url string, page int, text string, total_pages int, encrypted boolean, meta_title string")).collect()}
    assert got["u"].title == "Title line" and got["u"].error is None and got["u"].pages_read == 2
    assert got["e"].text is None and got["e"].error == "encrypted"
    assert got["s"].low_confidence and got["s"].text == "short" and got["s"].title == "Meta"
