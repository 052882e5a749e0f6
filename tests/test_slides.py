"""The data source of slide packages: what is read, what is written, and what failed tasks leave."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_writer import template

from sluiceway.sources import decks, slides, writer


@pytest.fixture(scope="module")
def source(spark):
    slides.register(spark)
    return spark


@pytest.fixture
def folder(tmp_path):
    """Packages with a large picture, one that is none, one below another folder, and files that don't count."""
    top = tmp_path / "in"
    (top / "below").mkdir(parents=True)
    (top / "_temporary").mkdir()
    for k in range(3):
        (top / f"d{k}.pptx").write_bytes(template(**{"ppt/media/image1.png": os.urandom(300_000), "ppt/slides/slide3.xml": "<a><b></a>"}))
    (top / "below" / "e.pptx").write_bytes(template())
    (top / "none.pptx").write_bytes(b"no archive")
    (top / "x.txt").write_bytes(b"x")
    (top / "_temporary" / "f.pptx").write_bytes(template())
    (top / ".g.pptx").write_bytes(template())
    return str(top)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_as_whole_files(source, folder):
    name = lambda df: df.withColumn("package", F.regexp_replace("package", "^file:/*", "/"))
    whole = decks.packages(source, folder).where("package NOT LIKE '%/_temporary/%' AND package NOT LIKE '%/.%'")
    read = lambda t: source.read.format("slides").option("table", t).load(folder)
    assert rows(source.read.format("slides").load(folder)) == rows(name(decks.shapes(whole)))
    parts, rels, _ = decks.relationships(whole)
    assert rows(read("relationships")) == rows(name(rels))
    assert rows(read("parts").select("package", "part")) == rows(name(parts))
    got = {r.package.rsplit("/", 1)[1]: r for r in read("packages").collect()}
    assert set(got) == {"d0.pptx", "d1.pptx", "d2.pptx", "e.pptx", "none.pptx"}
    assert got["none.pptx"].error == "invalid" and got["none.pptx"].slides is None and got["d0.pptx"].slides == 3 and got["d0.pptx"].error is None
    data = {r.part: bytes(r.data) for r in read("parts").where(F.col("package").endswith("/e.pptx")).collect()}
    with zipfile.ZipFile(f"{folder}/below/e.pptx") as z:
        assert data == {"/" + n: z.read(n) for n in z.namelist()}


def bytes_read(folder, table, columns, **options):
    r = slides.SlideReader({"path": folder, "table": table, **options}, StructType.fromDDL(columns))
    found = sum(b.num_rows for p in r.partitions() for b in r.read(p))
    return r.count, found


def test_only_what_columns_and_options_need(folder):
    size = sum(os.path.getsize(f"{folder}/d{k}.pptx") for k in range(3))
    all_, n = bytes_read(folder, "shapes", decks.SHAPES)
    assert all_ < size / 10  # no pictures
    lean, m = bytes_read(folder, "shapes", "package string, text string")
    assert lean < all_ and m == n
    one, k = bytes_read(folder, "shapes", "package string, slide int, text string", slide="1")
    assert one < lean and 0 < k < n
    names, parts = bytes_read(folder, "parts", "package string, part string, size long")
    whole, same = bytes_read(folder, "parts", slides.TABLES["parts"])
    assert names < 30_000 < size < whole and parts == same
    show, p = bytes_read(folder, "parts", slides.TABLES["parts"], part="/ppt/presentation.xml|/none")
    assert show < 40_000 and p == 4
    single, q = bytes_read(folder, "shapes", decks.SHAPES, package=f"{folder}/d1.pptx")
    assert single < all_ / 2 and 0 < q < n


def test_options_and_filters(source, folder):
    read = source.read.format("slides").schema("package string, slide int, text string")
    df = read.load(folder)
    want = [r for r in rows(df) if r[1] == 1]
    assert rows(read.option("slide", "1").load(folder)) == want
    assert rows(df.where("slide = 1")) == want and len(rows(df)) > len(want) > 0
    with pytest.raises(Exception, match="has no colour"):
        source.read.format("slides").schema("package string, colour string").load(folder).collect()


def test_large_files_and_sizes(folder, monkeypatch):
    monkeypatch.setattr(decks, "MAX_PACKAGE", 100_000)
    r = slides.SlideReader({"path": folder, "table": "packages"}, StructType.fromDDL(slides.TABLES["packages"]))
    got = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert sorted(x["error"] or "" for x in got) == ["", "invalid", "too_large", "too_large", "too_large"]
    files = [(f"f{k}", 10 << 20) for k in range(20)] + [("huge", 1 << 30)]
    dealt = slides.deal(files, 64 << 20, 1)
    assert sorted(f for p in dealt for f in p) == sorted(files)
    assert all(len(p) == 1 or sum(s + slides.OPEN for _, s in p) <= 64 << 20 for p in dealt) and len(dealt) == 5
    assert len(slides.deal(files[:20], 64 << 20, 8)) >= 8 and slides.deal([], 1, 8) == []


def written(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_write_and_read_back(source, tmp_path):
    out = str(tmp_path / "out")
    long = "n" * 300
    rows_ = [("a/b", template()), (None, template()), ("_x", template()), ("none", None), (long + "1", template()), (long + "2", template())]
    df = source.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in rows_], "deck string, data binary").repartition(3)
    df.write.format("slides").mode("append").save(out)
    names = [p.rsplit("/", 1)[1] for p in written(out)]
    assert len(names) == 5 and {"a%2Fb.pptx", "output.pptx", "%5Fx.pptx"} < set(names) and not os.path.exists(f"{out}/_temporary")
    assert source.read.format("slides").option("table", "packages").load(out).where("error IS NULL").count() == 5
    df.limit(0).write.format("slides").mode("append").save(out)
    df.where("deck = 'a/b'").write.format("slides").mode("append").save(out)
    assert len(written(out)) == 6
    df.where("deck = 'a/b'").write.format("slides").mode("overwrite").save(out)
    assert [p.rsplit("/", 1)[1] for p in written(out)] == ["a%2Fb.pptx"]
    with pytest.raises(Exception, match="deck and data"):
        df.select("deck").write.format("slides").mode("append").save(out)


def test_a_failed_job_leaves_nothing(source, tmp_path):
    out = str(tmp_path / "out")

    @F.udf("binary")
    def spoiled(k):
        if k == 7:
            raise RuntimeError("on purpose")
        return b"x"

    bad = source.range(10).repartition(5).select(F.col("id").alias("deck"), spoiled("id").alias("data"))
    with pytest.raises(Exception, match="on purpose"):
        bad.write.format("slides").mode("append").save(out)
    assert not os.path.exists(out) or written(out) == []


def test_an_attempt_that_ran_twice_counts_once(tmp_path):
    import pyarrow as pa

    out = str(tmp_path / "out")
    w = slides.SlideWriter(out, StructType.fromDDL("deck long, data binary"), False)
    batch = lambda *k: pa.RecordBatch.from_pydict({"deck": list(k), "data": [b"x"] * len(k)})
    first, again, other = w.write([batch(1, 2), batch(2)]), w.write([batch(1, 2), batch(2)]), w.write([batch(3)])
    lost = w.write([batch(1)])  # its task died after writing
    other.place = other.place.replace("part-00000", "part-00001")
    assert written(out) and not any("part-" in p.split("/")[0] for p in written(out)) and again.files == lost.files + 2
    w.commit([first, None, other])
    assert sorted(p.rsplit("/", 1)[1] for p in written(out)) == ["1.pptx", "2-2.pptx", "2.pptx", "3.pptx"]
    v = slides.SlideWriter(out, StructType.fromDDL("deck long, data binary"), True)
    v.write([batch(9)])
    v.abort([])
    assert len(written(out)) == 4 and not os.path.exists(f"{out}/_temporary")


def test_decks_through_the_source(source, tmp_path):
    out = str(tmp_path / "out")
    pages = source.createDataFrame([(d, "t", 1, 0) for d in range(20)], "deck long, package string, page int, src int")
    filled = source.createDataFrame([(d, 1, 8, f"deck {d}") for d in range(20)], "deck long, page int, sid int, text string")
    made = writer.build(pages, filled, source.createDataFrame([("t", bytearray(template()))], "package string, data binary"))
    made.select("deck", "data").write.format("slides").mode("append").save(out)
    got = source.read.format("slides").schema("text string").load(out)
    assert sorted(r.text for r in got.collect()) == sorted(f"deck {d}" for d in range(20))
