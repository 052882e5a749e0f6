import io
import zipfile

from pyspark.sql import functions as F

from sluiceway.operators import deck
from sluiceway.sources import decks, writer

NS = " ".join(f'xmlns:{k}="{v}"' for k, v in decks.NS.items())
R = decks.NS["r"]
SP = '<p:sp><p:nvSpPr><p:cNvPr id="{0}" name="x">{2}</p:cNvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/><a:p>{1}<a:endParaRPr/></a:p><a:p><a:r><a:t>second</a:t></a:r></a:p></p:txBody></p:sp>'
RUNS = '<a:r><a:rPr sz="2400"/><a:t>one</a:t></a:r><a:r><a:t>two</a:t></a:r>'


def rels(*to):
    return f'<Relationships xmlns="{writer.REL_NS}">' + "".join(f'<Relationship Id="{i}" Type="{t if "://" in t else R + "/" + t}" Target="{x}"{m}/>' for i, t, x, m in ((*r, "")[:4] for r in to)) + "</Relationships>"


def template(**other):
    """Two slides: a chart with its workbook, a picture, a link out, a jump to slide 2, notes, a background and timing on the first."""
    away = ' TargetMode="External"'
    link = lambda rid: f'<a:hlinkClick r:id="{rid}"/>'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/ppt/{p}.xml" ContentType="t/{p.rstrip("0123456789")}"/>' for p in ("presentation", "slides/slide1", "slides/slide2", "charts/chart7", "notesSlides/notesSlide1")) + "</Types>",
        "_rels/.rels": rels(("rId1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {NS} xmlns:p14="http://x/p14"><p:sldMasterIdLst/><p:sldIdLst><p:sldId id="300" r:id="rId2"/><p:sldId id="301" r:id="rId3"/></p:sldIdLst><p:sldSz cx="1" cy="1"/><p:extLst><p:ext uri="u"><p14:sectionLst/></p:ext></p:extLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "theme", "theme/theme1.xml"), ("rId2", "slide", "slides/slide2.xml"), ("rId3", "slide", "slides/slide1.xml"), ("rId4", "viewProps", "viewProps.xml")),
        "ppt/theme/theme1.xml": "<t/>",
        "ppt/viewProps.xml": "<v/>",
        "ppt/_rels/viewProps.xml.rels": rels(("rId1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f'<p:sld {NS} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:c="http://x/c" xmlns:p14="http://x/p14" mc:Ignorable="p14"><p:cSld><p:bg r:embed="rId9"/><p:spTree>{SP.format(4, RUNS, link("rId5"))}<p:grpSp>{SP.format(5, "", link("rId6"))}</p:grpSp><p:pic r:embed="rId2"/><p:graphicFrame><c:chart r:id="rId3"/></p:graphicFrame></p:spTree></p:cSld><p:timing/></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": rels(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "image", "../media/image1.png"), ("rId3", "chart", "../charts/chart7.xml"), ("rId4", "notesSlide", "../notesSlides/notesSlide1.xml"), ("rId5", "hyperlink", "http://x/?a=1&amp;b", away), ("rId6", "slide", "slide2.xml"), ("rId9", "image", "../media/image2.png")),
        "ppt/slides/slide2.xml": f'<p:sld {NS}><p:cSld><p:spTree>{SP.format(8, RUNS, "")}</p:spTree></p:cSld></p:sld>',
        "ppt/slideLayouts/slideLayout1.xml": f'<p:sldLayout {NS}><p:cSld name="L"/></p:sldLayout>',
        "ppt/notesSlides/notesSlide1.xml": "<n/>",
        "ppt/notesSlides/_rels/notesSlide1.xml.rels": rels(("rId1", "slide", "../slides/slide1.xml")),
        "ppt/charts/chart7.xml": f'<c:chartSpace {NS} xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:externalData r:id="rId8"/></c:chartSpace>',
        "ppt/charts/_rels/chart7.xml.rels": rels(("rId8", "package", "../embeddings/book1.xlsx")),
        "ppt/embeddings/book1.xlsx": "x",
        "ppt/media/image1.png": "1",
        "ppt/media/image2.png": "2",
    } | other
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return b.getvalue()


def opened(data):
    return zipfile.ZipFile(io.BytesIO(data))


def test_slides_are_copied_with_what_is_theirs():
    b = writer.Builder(template())
    pages = [(1, {4: "A & <b>\x01", 5: ""}), (0, {8: "Z"}), (1, {5: "new run"})]
    data = b.deck(pages)
    assert data == b.deck(pages) == writer.Builder(template()).deck(pages)
    z = opened(data)
    names = set(z.namelist())
    assert {n for n in names if "slides/slide" in n or "charts/chart" in n} == {f"ppt/slides/slide{k}.xml" for k in (3, 4, 5)} | {"ppt/charts/chart8.xml", "ppt/charts/chart9.xml"}
    assert {n for n in names if "embeddings" in n or "media" in n} == {"ppt/embeddings/book2.xlsx", "ppt/embeddings/book3.xlsx", "ppt/media/image1.png"}
    assert not any(x in n for n in names for x in ("notes", "viewProps"))
    assert decks._slides(z) == ["ppt/slides/slide3.xml", "ppt/slides/slide4.xml", "ppt/slides/slide5.xml"]
    assert decks._layout(z, "ppt/slides/slide5.xml") == "L"
    first = decks._related(z, "ppt/slides/slide3.xml")
    assert first == {"rId1": "ppt/slideLayouts/slideLayout1.xml", "rId2": "ppt/media/image1.png", "rId3": "ppt/charts/chart8.xml", "rId6": "ppt/slides/slide4.xml"}
    assert decks._related(z, "ppt/charts/chart9.xml") == {"rId8": "ppt/embeddings/book3.xlsx"}
    slide = z.read("ppt/slides/slide3.xml").decode()
    assert "A &amp; &lt;b&gt;_x0001_" in slide and "second" not in slide and "two" not in slide and 'sz="2400"' in slide
    assert 'mc:Ignorable="p14"' in slide and "xmlns:p14=" in slide and "timing" not in slide and "p:bg" not in slide
    assert "one" in z.read("ppt/slides/slide5.xml").decode() and "new run" in z.read("ppt/slides/slide5.xml").decode()
    assert 'Target="http://x/?a=1&amp;b"' in z.read("ppt/slides/_rels/slide3.xml.rels").decode()
    show = z.read("ppt/presentation.xml").decode()
    assert "sectionLst" not in show and [f'id="{k}"' in show for k in (300, 301, 302, 303, 304, 305)] == [False, False, True, True, True, False]
    assert show.index("sldMasterIdLst") < show.index("sldIdLst") < show.index("sldSz")
    types = z.read("[Content_Types].xml").decode()
    assert types.count('"t/slides/slide"') == 3 and types.count('"t/charts/chart"') == 2 and "slide1.xml" not in types and "notes" not in types


def test_jumps_to_slides_that_are_not_in_the_deck_go():
    z = opened(writer.Builder(template()).deck([(1, {})]))
    assert "rId6" not in z.read("ppt/slides/slide3.xml").decode() and "rId5" in z.read("ppt/slides/slide3.xml").decode()
    assert "rId6" not in decks._related(z, "ppt/slides/slide3.xml")


def test_build_and_save(spark, tmp_path):
    templates = spark.createDataFrame([("t", bytearray(template())), ("bad", bytearray(b"no archive")), ("large", None), ("cut", bytearray(template(**{"ppt/slides/slide1.xml": "<a><b></a>"})))], "package string, data binary")
    rows = [("d/1", "t", 2, 1), ("d/1", "t", 1, 0), (None, "t", 1, 0), ("e1", "bad", 1, 0), ("e2", "large", 1, 0), ("e3", "none", 1, 0), ("e4", None, 1, 0), ("e5", "t", 1, 7), ("e6", "t", 1, None), ("e7", "cut", 1, 1), ("ok", "cut", 1, 0), ("e8", "t", 1, -1)]
    rows += [(f"m{k}", "t", 1, 0) for k in range(150)]
    pages = spark.createDataFrame(rows, "deck string, package string, page int, src int")
    filled = spark.createDataFrame([("d/1", 1, 8, "Title"), ("d/1", 2, 4, None), ("d/1", 2, 5, "x"), (None, 1, 8, "null deck"), ("d/1", 9, 8, "no such page"), ("lone", 1, 8, "no such deck"), ("m7", 1, 8, "seven")], "deck string, page int, sid int, text string")
    built = writer.build(pages, filled, templates).cache()
    got = {r.deck: r.error for r in built.collect()}
    assert {k: v for k, v in got.items() if v} == {"e1": "invalid template", "e2": "invalid template", "e3": "no template", "e4": "no template", "e5": "no slide 7", "e6": "no slide given", "e7": "no slide 1", "e8": "no slide -1"}
    assert set(got) == {r[0] for r in rows} and built.where("data IS NULL AND error IS NULL").count() == 0
    writer.save(built, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"d%2F1.pptx", "output.pptx", "ok.pptx"} | {f"m{k}.pptx" for k in range(150)}
    back = decks.packages(spark, str(tmp_path / "out"))
    texts = {(r.package.rsplit("/", 1)[1], r.slide, r.sid): r.text for r in decks.shapes(back).collect()}
    assert texts["m7.pptx", 1, 8] == "seven" and texts["m8.pptx", 1, 8] == "onetwo\nsecond" and texts["output.pptx", 1, 8] == "null deck"
    assert {k[1:]: v for k, v in texts.items() if "F1" in k[0]} == {(1, 8): "Title", (2, 5): "x"}
    parts, links, used = decks.relationships(back)
    ids = decks.shapes(back).select("package", F.concat(F.lit("/ppt/slides/slide"), "slide", F.lit(".xml")).alias("part"), F.col("sid").alias("shape_id"))
    assert deck.package_issues(used, links, parts, ids, decks.chart_data(back)).collect() == []
    assert writer.build(pages.limit(0), filled, templates).count() == 0
