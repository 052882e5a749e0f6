import gzip
import io
import zipfile

from pyspark.sql import functions as F
from test_deck import written

from sluiceway.functions import text
from sluiceway.operators import deck, diagnose, discover, gate, pages
from sluiceway.plans import queries as Q
from sluiceway.sources import decks, responses

RESPONSE = "url string, engine string, status int, data binary, content_type string"
PAGE = "<html><title>T</title><body><p>" + "long text " * 60 + "</p><a href=/a.pdf>A</a><a class=x href='/b.html'>B</a><a href='http://other.org/c'>C</a><a href='sub/d.html?x=1#y'>D</a></body></html>"


def test_fetch_gives_clean_raw_and_link_bearing_records(spark):
    rows = [("http://a.org/x/", "http", 200, bytearray(PAGE.encode()), "text/html"), ("http://a.org/p", "http", 200, bytearray(b"%PDF-1.4"), "application/pdf"), ("http://a.org/s", "http", 200, bytearray(b"<html>" + b" " * 600), "text/html"), ("http://a.org/n", "http", 404, bytearray(b"x" * 600), "text/html")]
    got = gate.acquire(spark.createDataFrame(rows, RESPONSE))
    clean = {r.url[13:]: r for r in pages.fetch(got, include_links=True).collect()}
    assert clean["x/"].title == "T" and clean["x/"].error is None and [tuple(a) for a in clean["x/"].attachments] == [("http://a.org/a.pdf", "pdf", "A")]
    assert [tuple(a) for a in clean["x/"].links] == [("http://a.org/b.html", "B"), ("http://a.org/x/sub/d.html?x=1#y", "D")]
    assert clean["s"].error == "body too short" and clean["s"].attachments is None and clean["n"].error == "HTTP 404"
    assert "links" not in pages.fetch(got).columns
    raw = {r.url[13:]: r for r in pages.fetch(got, raw=True).collect()}
    assert raw["x/"].raw == PAGE and raw["x/"].length == len(PAGE) and raw["p"].error == "a PDF has no raw text" and raw["n"].raw is None


def test_links_of_any_markup_take_the_parser(spark):
    odd = [(1, "http://a.org/x/", PAGE), (2, "http://a.org/", '<a href="/p">P</a>'), (3, "http://a.org/y/", '<a href="q">Q</a><A HREF="/r">R</A>')]
    df = spark.createDataFrame(odd, "page_id long, url string, html string")
    rows = lambda native: sorted((r.page_id, r.url, r.text) for r in pages.resolve(pages.raw_links(df, native)).collect())
    assert rows(True) == rows(False) and (3, "http://a.org/y/q", "Q") in rows(True) and (3, "http://a.org/r", "R") in rows(True)


def test_engines_and_failures(spark):
    rows = [("u", "http", 200, bytearray(b"tiny"), "text/html"), ("u", "browser", 200, bytearray(b"x" * 600), "text/html"), ("v", "http", 0, None, None)]
    df = spark.createDataFrame(rows, RESPONSE).withColumn("error_class", F.when(F.col("url") == "v", "TooLarge"))
    got = {r.url: r for r in gate.acquire(df).collect()}
    assert got["u"].engine_used == "browser" and got["v"].error == "too_large"
    assert {r.url: r.error for r in gate.acquire(df, engine="http").collect()} == {"u": "empty_body", "v": "too_large"}
    assert [(r.url, r.kind) for r in gate.failures(gate.acquire(df)).collect()] == [("v", "too_large")]
    assert gate.public(df.withColumn("_own", F.lit(1))).columns == df.columns


def test_large_files_are_failures(spark, tmp_path, monkeypatch):
    (tmp_path / "a.html").write_bytes(b"x" * 700)
    (tmp_path / "b.html").write_bytes(b"x" * 2000)
    monkeypatch.setattr(responses, "MAX_BYTES", 1000)
    got = {r.url[-6:]: (r.error, r.engine_used) for r in gate.acquire(responses.files(spark, str(tmp_path))).collect()}
    assert got == {"a.html": (None, "http"), "b.html": ("too_large", None)}


def test_sites_without_robots_or_sitemap(spark):
    xml = "<urlset><url><loc>http://x/{}</loc><lastmod>2024-0{}-01</lastmod></url></urlset>"
    fetched = [("https://a.org/robots.txt", "Sitemap: https://a.org/s.xml", None), ("https://a.org/s.xml", xml.format("a", 1), None), ("https://a.org/sitemap.xml", xml.format("never", 1), None), ("https://www.b.org/sitemap.xml", xml.format("b", 2), None), ("https://b.org/robots.txt", None, "challenge"), ("https://c.org/sitemap.xml", "<html>not found</html>", None), ("https://d.org/robots.txt", None, "empty_body"), ("https://e.org/sitemap.xml", xml.format("e", 3), None)]
    sites = spark.createDataFrame([(s,) for s in ("a.org", "b.org", "c.org", "d.org", "e.org")], "site string")
    results, errors = discover.collect(sites, spark.createDataFrame(fetched, "url string, text string, kind string"), since="2024-01-01", match="/[abx]$")
    assert {(r.site, r.url, r["rank"]) for r in results.collect()} == {("a.org", "http://x/a", 1), ("b.org", "http://x/b", 1)}
    assert {(r.site, r.kind) for r in errors.collect()} == {("c.org", "no_sitemap"), ("d.org", "blocked"), ("e.org", "no_match")}


def test_diagnosis_steps(spark):
    rows = [("https://www.a.org/", "http", 403, bytearray(b"x" * 600), "text/html", None, None, 1.26), ("https://a.org/", "http", 200, bytearray(PAGE.encode()), "text/html", None, None, 0.34), ("https://b.org/", "http", None, None, None, "Timeout", "slow", None)]
    got = diagnose.describe(spark.createDataFrame(rows, RESPONSE + ", error_class string, error_message string, elapsed double"))
    by = {r.url: r for r in got.collect()}
    assert (by["https://www.a.org/"].verdict, by["https://www.a.org/"].elapsed) == ("http_error", 1.3) and by["https://a.org/"].title == "T" and by["https://b.org/"].error == "Timeout: slow"
    tried = spark.createDataFrame([("a", 0, "https://www.a.org/"), ("a", 1, "https://a.org/"), ("b", 0, "https://b.org/")], "site string, ord int, url string")
    assert {r.site: (r.url, r.error) for r in diagnose.entry(got, tried).collect()} == {"a": ("https://www.a.org/", None), "b": ("https://b.org/", "Timeout: slow")}
    fetched = spark.createDataFrame([("https://a.org/robots.txt", "Sitemap: https://a.org/s.xml", None), ("https://a.org/sitemap.xml", "<html>", None)], "url string, text string, kind string")
    steps = {r.root: (r.declared, r.is_xml) for r in diagnose.sitemap_steps(spark.createDataFrame([("a.org",)], "site string"), fetched).collect()}
    assert steps["https://a.org"] == (["https://a.org/s.xml"], False) and steps["https://www.a.org"] == (None, None)


def test_page_numbers_and_words(spark):
    r = spark.range(1).select(text.page_numbers(F.lit("1, 3-5,9,x,5-2,4"), F.lit(6)).alias("p"), text.words(F.lit(" a, b  c,,")).alias("w")).first()
    assert r.p == [1, 3, 4, 5] and r.w == ["a", "b", "c"]


def test_slides_in_the_presentations_order(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    box = '<p:sp><p:nvSpPr><p:cNvPr id="{0}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="10" y="20"/><a:ext cx="30" cy="40"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{1}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{{}}</p:spTree></p:cSld></p:sld>"
    group = "<p:grpSp><p:grpSpPr><a:xfrm><a:off x='100' y='200'/><a:ext cx='60' cy='80'/><a:chOff x='10' y='20'/><a:chExt cx='30' cy='40'/></a:xfrm></p:grpSpPr>" + box.format(7, "grouped") + "</p:grpSp>"
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Type="t/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="t/slide" Target="slides/slide2.xml"/></Relationships>')
        z.writestr("ppt/slides/slide1.xml", slide.format(box.format(5, "second") + group))
        z.writestr("ppt/slides/slide2.xml", slide.format(box.format(6, "first")))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Id="r1" Type="t/slideLayout" Target="../slideLayouts/slideLayout1.xml"/></Relationships>')
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f'<p:sldLayout {ns}><p:cSld name="节标题"><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr></p:sp></p:spTree></p:cSld></p:sldLayout>')
    p = decks.packages(spark, str(tmp_path))
    got = decks.shapes(p).orderBy("slide", "pos").collect()
    assert [(r.slide, r.text, r.layout) for r in got] == [(1, "first", ""), (2, "second", "节标题"), (2, "grouped", "节标题")]
    assert (got[2].left, got[2].top, got[2].width, got[2].height) == (100, 200, 60, 80)
    seen = decks.inspect(p).first()
    assert (seen.slides, seen.layouts, seen.width, seen.names) == (2, 1, 9144000, ["节标题 0:title"]) and seen.samples == [": first", "节标题: second / grouped"]
    (tmp_path / "b.pptx").write_bytes(b"no")
    good, bad = decks.acquire(decks.packages(spark, str(tmp_path)))
    assert good.count() == 1 and [r.error for r in bad.collect()] == ["invalid"]


def test_whole_cards_round_trip_and_errors(spark):
    pages_ = written(spark)
    whole = deck.preview(deck.cards(pages_), "X", "Deck").select(F.lit("c").alias("card"), "text")
    back, errors = deck.read_cards(whole)
    parsed = deck.parse_cards(deck.cards(pages_))
    assert errors.count() == 0 and deck.same(back.drop("card"), parsed).count() == 0
    narrow = whole.withColumn("text", F.concat(F.lit("noise\n"), F.replace("text", F.lit("　"), F.lit("  ")), F.lit("\ntail")))
    assert deck.same(deck.read_cards(narrow)[0].drop("card"), parsed).count() == 0
    assert deck.same(parsed.where("page > 1"), parsed).collect()[0].side == "second"
    long = "**T**　模板：X　共 1 页\n\n---\n\n**第 1 页**　`要点`　Many\n" + "\n".join(f"- item {k}" for k in range(3000)) + "\n---\n"
    got = deck.read_cards(spark.createDataFrame([("l", long)], "card string, text string"))[0].first()
    assert len(got["items"]) == 3000
    bad = [("a", "hand written"), ("b", "**T**　模板：X　共 1 页\n---\nno page\n---"), ("c", None)]
    assert {r.card: r.error for r in deck.read_cards(spark.createDataFrame(bad, "card string, text string"))[1].collect()} == {"a": "no head line", "b": "no pages", "c": "no head line"}


def test_decks_are_kept_apart(spark):
    item = "array<struct<head:string,body:string>>"
    rows = [(d, p, k, f"{k}{p}", None, []) for d in (1, 2) for p, k in ((1, "section"), (2, "section"))]
    df = spark.createDataFrame(rows, f"deck int, page int, kind string, title string, subtitle string, items {item}")
    assert sorted((r.deck, r.page, r.card.split("\n")[1][:6]) for r in deck.cards(df).collect()) == [(d, p, f"### 0{p}") for d in (1, 2) for p in (1, 2)]
    ops = spark.createDataFrame([(1, 1, 1, "title", "New"), (2, 2, 9, "title", "x"), (2, 3, 1, "title", "y")], "deck int, ord int, page int, field string, value string")
    assert sorted(r.title for r in deck.patch(df, ops)[0].collect()) == ["New", "section1", "section2", "section2"]


def test_gzipped_sitemaps_are_read(spark):
    from sluiceway.functions import codec

    raw = gzip.compress(b"<urlset><url><loc>http://x/1</loc></url></urlset>")
    df = spark.createDataFrame([("u", bytearray(raw))], "url string, data binary")
    xml = df.select("url", codec.inflate("data", F.lit(None).cast("string")).cast("string").alias("text"))
    assert [r["loc"] for r in discover.sitemap_rows(xml).collect()] == ["http://x/1"] and io.BytesIO(raw).read(2) == b"\x1f\x8b"
