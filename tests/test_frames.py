"""Sketches merged over grouping sets, frames over time, and cards read as lines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.functions import cardlines
from sluiceway.operators import deck, frames, rollup

START = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- sketches ------------------------------------------------------------------------------------------------


def test_sketches_of_cells_merge(spark, tmp_path):
    """Cells of several loads, appended and merged: exact counts, distinct counts and medians near the exact ones."""
    rng = random.Random(7)
    data = [(rng.choice("abc"), rng.choice([None, "x", "y"]), rng.randrange(20_000), rng.gauss(0, 10)) for _ in range(60_000)]
    df = spark.createDataFrame(data, "d string, e string, who long, v double")
    path = str(tmp_path / "cells")
    for k in range(4):
        rollup.cells(df.where(F.col("who") % 4 == k), ["d", "e"], "who", "v").write.mode("append").parquet(path)
    cells = spark.read.parquet(path)
    assert cells.count() == 36
    got = rollup.merged(cells, ["d", "e"]).select("d", "e", "level", "rows", "total", rollup.distinct(F.col("users")).alias("u"), rollup.quantile(F.col("levels"), 0.5).alias("m"), rollup.quantile(F.col("levels"), 0.9).alias("p")).collect()
    assert len(got) == 9 + 3 + 3 + 1 and sorted({r.level for r in got}) == [0, 1, 2, 3]
    worst = 0.0
    for r in got:
        mine = [x for x in data if (r.level & 1 or x[0] == r.d) and (r.level & 2 or x[1] == r.e)]
        assert r.rows == len(mine) and abs(r.total - sum(x[3] for x in mine)) < 1e-6
        exact = len({x[2] for x in mine})
        worst = max(worst, abs(r.u - exact) / exact)
        for q, v in ((0.5, r.m), (0.9, r.p)):
            assert abs(sum(x[3] <= v for x in mine) / len(mine) - q) < 0.02
    assert worst < 0.03, worst
    some = rollup.merged(cells, ["d", "e"], [["e"], []])
    assert some.count() == 4 and {r.level for r in some.collect()} == {0, 1}


def test_sketches_odd(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, None), ("a", 1, None), (None, 2, 5.0), (None, 2, 5.0)], "d string, who long, v double").withColumn("rows", F.lit("x")).withColumn("level", F.lit(1))
    got = {r.d: r for r in rollup.merged(rollup.cells(df, ["d"], "who", "v"), ["d"], [["d"]]).select("d", "rows", "total", rollup.distinct(F.col("users")).alias("u"), rollup.quantile(F.col("levels"), 0.5).alias("m")).collect()}
    assert (got["a"]["rows"], got["a"].total, got["a"].u, got["a"].m) == (3, None, 1, None)
    assert (got[None]["rows"], got[None].total, got[None].u, got[None].m) == (2, 10.0, 1, 5.0)
    assert rollup.cells(df.limit(0), ["d"], "who", "v").count() == 0


# --- sessions and frames -------------------------------------------------------------------------------------


def moments(n, seed, keys="ab"):
    rng = random.Random(seed)
    return [(i, rng.choice([*keys, None]), None if rng.random() < 0.03 else START + dt.timedelta(seconds=rng.randrange(20_000)), rng.randrange(100)) for i in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "id long, who string, at timestamp, v long")


def sessions_plain(data, gap):
    out = []
    for k in {x[1] for x in data if x[1]}:
        mine = sorted((x[2], x[3]) for x in data if x[1] == k and x[2])
        run = []
        for at, v in mine:
            if run and (at - run[-1][0]).total_seconds() > gap:
                out.append((k, run[0][0], run[-1][0] + dt.timedelta(seconds=gap), len(run), sum(x[1] for x in run)))
                run = []
            run.append((at, v))
        out.append((k, run[0][0], run[-1][0] + dt.timedelta(seconds=gap), len(run), sum(x[1] for x in run)))
    return sorted(out, key=repr)


def test_sessions_of_tables_and_streams(spark, tmp_path):
    data = moments(300, 1) + [(900, "a", START, 1), (901, "a", START + dt.timedelta(seconds=30_000), 1), (902, "a", START + dt.timedelta(seconds=30_120), 1), (903, "a", START + dt.timedelta(seconds=30_239), 1)]
    make = lambda df: frames.sessions(df, "who", "at", "120 seconds", late="3 days", total=F.sum("v"))
    want = sessions_plain(data, 120)
    assert rows(make(table(spark, data)), "who", "start", "end", "rows", "total") == want
    source, last = str(tmp_path / "in"), table(spark, [(1, "last", START + dt.timedelta(days=9), 0)])
    table(spark, data).repartition(6).write.parquet(source)  # in no order
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 2).parquet(source)
    make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "who", "start", "end", "rows", "total") == want
    assert make(table(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_preceding(spark, slices):
    data = moments(300, 2) + [(900, "a", START, 1), (900, "a", START, 1), (901, "b", dt.datetime(1969, 12, 31, 23, 59, 59), 5), (902, "b", dt.datetime(1970, 1, 1, 0, 1, 39), 7)]
    got = frames.preceding(table(spark, data), "who", "at", 100, slices, n=lambda w: F.count(F.lit(1)).over(w), s=lambda w: F.sum("v").over(w))
    span = dt.timedelta(seconds=100)
    want = []
    for i, k, at, v in data:
        fit = [x[3] for x in data if at and x[2] and x[1] == k and at - span <= x[2] <= at]
        want.append((i, k, at, v, len(fit) if at else None, sum(fit) if at else None))
    assert rows(got, "*") == sorted(want, key=repr)
    assert got.columns == ["id", "who", "at", "v", "n", "s"]


def test_a_hot_key_is_cut_by_time(spark):
    df = spark.range(4000).select("id", F.lit("hot").alias("who"), F.timestamp_seconds("id").alias("at"))
    got = frames.preceding(df, "who", "at", 10, 16, n=lambda w: F.count(F.lit(1)).over(w), part=lambda w: F.max(F.spark_partition_id()).over(w))
    assert got.where("n = 11").count() == 3990 and got.select("part").distinct().count() > 4


# --- cards as lines ------------------------------------------------------------------------------------------


def lines_of(texts):
    return texts.select("card", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("no", "line"))


def test_card_lines_equal_whole_texts(spark):
    page = "**第 {0} 页**　`{1}`{2}"
    good = "\n".join(["noise", "**T**　模板：X　共 3 页", "---", page.format(1, "封面", ""), "# A", "sub", "", " --- ", page.format(2, "要点", "　Heads"), "- **h** — b", "- plain", "---", "", "---", page.format(3, "章节", "　Part"), "---", "tail", "---", page.format(4, "要点", ""), "never"])
    texts = [("good", good), ("windows", good.replace("\n", "\r\n")), ("none", "just\ntext"), ("empty", ""), ("null", None), ("short", good.replace("共 3", "共 4")), ("label", good.replace("封面", "封套")), ("bare", good.replace("　Part", "")), ("headless", "**T**　模板：X　共 0 页\n---\ntail"), ("spaces", good.replace("\n", "  　\n"))]
    df = spark.createDataFrame(texts, "card string, text string")
    # Lines in no order, among other columns.
    lines = lines_of(df.where("text IS NOT NULL")).withColumn("k", F.lit("x")).withColumn("error", F.lit("y")).orderBy(F.rand(3))
    pages, errors = cardlines.read_card_lines(lines)
    same_pages, same_errors = deck.read_cards(df.where("text IS NOT NULL"))
    plain = lambda d: sorted(map(str, d.collect()))
    assert plain(pages) == plain(same_pages) and pages.where("card = 'good'").count() == 3
    assert plain(errors) == plain(same_errors)
    assert {r.card for r in errors.collect()} == {"none", "empty", "short", "label", "bare", "headless"}


def test_card_lines_keys_and_schemas(spark):
    """The function takes the key's name and type from the call."""
    df = spark.createDataFrame([(7, 1, "**T**　模板：X　共 1 页"), (7, 2, "---"), (7, 3, "**第 1 页**　`封面`"), (7, 4, None), (8, 1, "x")], "doc long, no int, line string")
    pages, errors = cardlines.read_card_lines(df, "doc")
    assert [(r.doc, r.page, r.kind) for r in pages.collect()] == [(7, 1, "cover")] and [(r.doc, r.error) for r in errors.collect()] == [(8, "no head line")]
    assert pages.schema["doc"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="has no no"):
        spark.sql(f"SELECT * FROM {cardlines.NAME}(TABLE(SELECT doc, line FROM {{df}}), 'doc')", df=df).collect()

