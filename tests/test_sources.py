import datetime
import io
import json
import zipfile

from pyspark.sql import functions as F

from sluiceway.operators import deck
from sluiceway.sources import decks, responses
from sluiceway.streaming import ingest

SHAPE = '<p:sp><p:nvSpPr><p:cNvPr id="{id}" name="x"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="5"/><a:ext cx="7" cy="8"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:rPr sz="2400"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
HEAD = '<p:sld xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'


def package():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("ppt/presentation.xml", "<x/>")
        z.writestr("ppt/slides/slide1.xml", HEAD + SHAPE.format(id=4, x=1, text="Hello") + "<p:grpSp>" + SHAPE.format(id=4, x=2, text="In a group") + "</p:grpSp>" + SHAPE.format(id=6, x=3, text=" ") + '<p:pic r:embed="rId9"/></p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Id="rId1" Type="t/chart" Target="../charts/c1.xml"/><Relationship Id="rId2" Type="l" Target="http://x" TargetMode="External"/></Relationships>')
    return b.getvalue()


def test_packages(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(package())
    (tmp_path / "b.pptx").write_bytes(b"no archive")
    p = decks.packages(spark, str(tmp_path))
    got = decks.shapes(p).orderBy("pos").collect()
    assert [(r.slide, r.sid, r.text, r.font_pt, r.left) for r in got] == [(1, 4, "Hello", 24.0, 1), (1, 4, "In a group", 24.0, 2)]
    parts, rels, used = decks.relationships(p)
    ids = decks.shapes(p).select(F.concat(F.lit("/ppt/slides/slide"), "slide", F.lit(".xml")).alias("part"), F.col("sid").alias("shape_id"))
    found = {(r.category, r.detail) for r in deck.package_issues(used.drop("package"), rels.drop("package"), parts.drop("package"), ids).collect()}
    assert found == {("dangling_rid", "rId9"), ("missing_target", "/ppt/charts/c1.xml"), ("duplicate_id", "4")}


def test_index_and_outline(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"template": "t", "slides": [{"i": 3, "kind": "content", "items": 1, "slots": [{"sid": 1, "role": "title", "sample": "s", "cap": 9}, {"sid": 2, "role": "title", "sample": "s", "cap": 7}, {"sid": 3, "role": "item_body", "sample": "hint", "cap": 40, "idx": 0}]}]}))
    slides = decks.index(spark, str(tmp_path / "i.json"))
    assert decks.tightest_caps(slides).first().caps == {"title": 7, "item_body": 40}
    assert decks.hints(slides).first().hints == {0: "hint"}
    (tmp_path / "o.json").write_text(json.dumps({"template": "t", "title": "d", "pages": [{"src": 0, "kind": "cover", "title": "d"}, {"src": 3, "kind": "content", "title": "x", "items": [{"head": "h"}]}]}))
    assert [(r.page, r.kind) for r in decks.outlines(spark, str(tmp_path / "o.json")).orderBy("page").collect()] == [(1, "cover"), (2, "content")]
    (tmp_path / "c.md").write_text("noise\n---\n**第 1 页**　`封面`\n# T\n- x\n---\n**第 2 页** `要点` Name\n- **h** — b\n---\ntail")
    got = deck.parse_cards(decks.cards(spark, str(tmp_path / "c.md"))).orderBy("page").collect()
    assert [(r.page, r.kind, r.title) for r in got] == [(1, "cover", "T"), (2, "content", "Name")] and got[1]["items"][0].body == "b"


def test_url_list_and_files(spark, tmp_path):
    assert [r.url for r in responses.url_list(spark, '["b", "a", "b"]').orderBy("ord").collect()] == ["b", "a"]
    assert responses.url_list(spark, "[]").count() == 0
    (tmp_path / "x.html").write_text("<html>")
    assert responses.files(spark, str(tmp_path)).first().content_type == "text/html"
    responses.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a"]


def test_stream(spark, tmp_path):
    now, body = datetime.datetime(2024, 1, 1), bytearray(b"x" * 600)
    rows = [("u", "http", body, "text/html", 200, now), ("u", "http", body, "text/html", 200, now), ("v", "http", bytearray(b"tiny"), "text/html", 200, now)]
    spark.createDataFrame(rows, ingest.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = ingest.run(ingest.accepted(ingest.incoming(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["u"]


def test_package_faults_and_chart_data(spark, tmp_path):
    ns = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships><Relationship Id="rId1" Type="http://t/{}" Target="../embeddings/b.xlsx"/></Relationships>'
    for name, kind in (("a", "package"), ("b", "chartStyle")):
        with zipfile.ZipFile(tmp_path / f"{name}.pptx", "w") as z:
            z.writestr("ppt/presentation.xml", "<p/>")
            z.writestr("ppt/charts/chart1.xml", f'<c:chartSpace {ns}><c:externalData r:id="rId1"/></c:chartSpace>')
            z.writestr("ppt/charts/_rels/chart1.xml.rels", rel.format(kind))
            z.writestr("ppt/embeddings/b.xlsx", "x")
            z.writestr("ppt/bad.xml", "<a><b></a>" if name == "b" else "<a/>")
            z.writestr("ppt/dtd.xml", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>' if name == "b" else "<a/>")
    (tmp_path / "c.pptx").write_bytes(b"no archive")
    p = decks.packages(spark, str(tmp_path))
    short = lambda s: s[-6:]
    assert {(short(r.package), r.part, r.fault) for r in decks.faults(p).collect()} == {("b.pptx", "/ppt/bad.xml", "broken"), ("b.pptx", "/ppt/dtd.xml", "unsafe"), ("c.pptx", None, "broken")}
    parts, rels, used = decks.relationships(p)
    ids = decks.shapes(p).select("package", F.lit("x").alias("part"), F.col("sid").alias("shape_id"))
    found = {(short(r.package), r.category, r.detail) for r in deck.package_issues(used, rels, parts, ids, decks.chart_data(p)).collect()}
    assert found == {("b.pptx", "chart_data", "chartStyle")}
