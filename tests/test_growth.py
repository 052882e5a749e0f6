"""What work grows with: plans in which something is done again for each row of a larger thing."""

from xml.dom import minidom

from pyspark.sql import functions as F

from sluiceway.operators import deck, discover, keywords
from sluiceway.plans.queries import template_package
from sluiceway.sources import decks, writer


def test_a_sitemap_is_judged_once_not_for_each_entry(spark):
    xml = "<urlset>" + "".join(f"<url><loc>http://a.org/{k}</loc></url>" for k in range(5)) + "</urlset>"
    rows = discover.sitemap_rows(spark.createDataFrame([("s", xml), ("n", None), ("h", "<html>")], "url string, text string"))
    assert [(r.sitemap, r.pos, r["loc"], r.child) for r in rows.collect()] == [("s", k, f"http://a.org/{k}", False) for k in range(5)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "sitemapindex" not in above and "sitemapindex" in plan


def test_a_card_is_read_once_not_for_each_use_of_its_lines(spark):
    card = "**T**　模板：X　共 1 页\n---\n**第 1 页** `封面`\n# A\nsub"
    cards = spark.createDataFrame([("a", card), ("b", card.replace("共 1", "共 2")), ("c", "none"), ("d", None)], "card string, text string")
    pages, errors = deck.read_cards(cards)
    assert {r.card: r.error for r in errors.collect()} == {"b": "head line says 2 pages, there are 1", "c": "no head line", "d": "no head line"}
    assert [(r.card, r.page, r.kind, r.title, r.subtitle) for r in pages.collect()] == [("a", 1, "cover", "A", "sub")]
    for df in (pages, errors):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_texts_are_worked_out_once_whatever_the_number_of_keyword_blocks(spark, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK", 40)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        read.add(1)
        return x

    texts = spark.createDataFrame([(k, f"alpha{k} beta") for k in range(20)] + [(99, None)], "id int, text string").withColumn("text", told("text"))
    words = spark.createDataFrame([(w,) for w in ("alpha1", "beta", "alpha19", "gamma", "ta", None, "beta") + tuple(f"no{k}" for k in range(12))], "keyword string")
    got = sorted((r.id, r.keyword) for r in keywords.matches(texts, words).collect())
    want = sorted((k, w) for k in range(20) for w in ("alpha1", "beta", "alpha19", "ta") if w in f"alpha{k} beta")
    assert got == want and read.value == 21


def test_a_template_slide_is_parsed_once_not_for_each_page(monkeypatch):
    builder, parsed, parse = writer.Builder(template_package()), [], minidom.parseString
    monkeypatch.setattr(writer.minidom, "parseString", lambda x: parsed.append(x) or parse(x))
    made = [builder.deck([(2, {1: f"{k}", 2: "a <&> \x01"}), (2, {1: "7", 2: f'"é" {k}'})]) for k in range(3)]
    assert sum(b"S2-1" in x for x in parsed) == 1
    for k, data in enumerate(made):
        assert [(r[0], r[3]) for r in decks.slide_rows(decks._open(data))] == [(n, x) for n, x in ((1, str(k)), (1, "a <&> _x0001_"), (2, "7"), (2, f'"é" {k}'))]
