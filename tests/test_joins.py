"""Joins with keywords, with domains and over time, against plain Python or DuckDB, and on odd tables."""

import datetime as dt
import random

import pytest
from oracle import connect, plain
from pyspark.sql import functions as F

from sluiceway.operators import domains, keywords, temporal

START = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def rows(df, *cols):
    return sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)


# --- keywords ------------------------------------------------------------------------------------------------


def test_keywords_odd(spark):
    texts = [(1, "she hushes usher"), (2, None), (3, ""), (4, "安全生产管理 安全"), (4, "安全生产管理 安全"), (5, "x" * 300 + "y"), (6, "x" * 400)]
    words = ["she", "he", "usher", "he", None, "hush", "安全", "安全生产", "x" * 300 + "y", "x" * 300, "absent"]
    t = spark.createDataFrame(texts, "id long, text string").withColumn("k", F.lit(1)).withColumn("b", F.lit("c"))
    k = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted([(i, w) for i, x in texts if x is not None for w in {w for w in words if w is not None} if w in x], key=repr)
    got = keywords.matches(t, k, keyword="word")
    assert rows(got, "id", "keyword") == want and got.columns == ["id", "text", "k", "b", "keyword"]
    assert rows(keywords.holding(t, k, keyword="word"), "id") == sorted([(1,), (4,), (4,), (5,), (6,)])
    empty = k.limit(0)
    assert keywords.matches(t, empty, keyword="word").count() == 0 and keywords.holding(t, empty, keyword="word").count() == len(texts)
    every = keywords.matches(t, spark.createDataFrame([("",), ("she",)], "word string"), keyword="word")
    assert rows(every, "id", "keyword") == sorted([(i, "") for i, x in texts if x is not None] + [(1, "she")], key=repr)
    assert keywords.matches(t.limit(0), k, keyword="word").count() == 0


@pytest.mark.parametrize("block", [keywords.BLOCK, 100_000])
def test_keywords_100000(spark, monkeypatch, block):
    """As DuckDB's contains() with 100,000 keywords, in one block and in many."""
    monkeypatch.setattr(keywords, "BLOCK", block)
    con = connect()
    con.execute("CREATE TABLE k AS SELECT DISTINCT substr(text, CAST(1 + i * 17 % 400 AS INT), CAST(3 + i % 9 AS INT)) AS word FROM documents, range(150) r(i) WHERE length(text) > 420")
    con.execute("DELETE FROM k WHERE rowid >= 100000")
    con.execute("CREATE TABLE t AS SELECT item_id, text FROM benchmark WHERE text IS NOT NULL ORDER BY item_id LIMIT 60")
    k = spark.createDataFrame(con.execute("SELECT * FROM k").fetchall(), "word string")
    t = spark.createDataFrame(con.execute("SELECT * FROM t").fetchall(), "item_id long, text string")
    assert k.count() > 80_000
    want = sorted(con.execute("SELECT item_id, word FROM t JOIN k ON contains(text, word)").fetchall(), key=repr)
    assert rows(keywords.matches(t, k, keyword="word"), "item_id", "keyword") == want and len(want) > 1000


# --- domains -------------------------------------------------------------------------------------------------


def test_domains_odd(spark):
    hosts = [(1, "a.b.org"), (2, "B.org."), (3, "ab.org"), (4, None), (5, ""), (6, "x.a.b.org"), (7, "org"), (7, "org"), (8, "10.0.0.1"), (9, ".".join("abcdefgh" * 10) + ".net")]
    table = [("b.org", 1), (".A.b.org", 2), ("net", 3), (None, 4), ("", 5), ("b.org", 0), ("g.h.net", 6)]
    r = spark.createDataFrame(hosts, "id long, host string").withColumn("rest", F.lit("r"))
    d = spark.createDataFrame(table, "domain string, no int")
    got = domains.longest(r, d)
    assert rows(got, "id", "domain", "no") == sorted([(1, ".A.b.org", 2), (2, "b.org", 0), (3, None, None), (4, None, None), (5, None, None), (6, ".A.b.org", 2), (7, None, None), (7, None, None), (8, None, None), (9, "g.h.net", 6)], key=repr)
    assert got.columns == ["id", "host", "rest", "domain", "no"]
    assert rows(domains.outside(r, d), "id") == [(3,), (4,), (5,), (7,), (7,), (8,)]
    assert not any(x in plan_of(got) for x in ("NestedLoop", "Cartesian"))
    assert rows(domains.longest(r, d.limit(0)), "id", "domain") == sorted([(i, None) for i, _ in hosts], key=repr)
    with pytest.raises(ValueError):
        domains.longest(r, d.withColumnRenamed("no", "rest"))


def test_domains_random(spark):
    rng = random.Random(3)
    name = lambda n: ".".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    hosts, table = [(i, name(6)) for i in range(300)], sorted({name(4) for _ in range(12)})
    fits = lambda h: max((d for d in table if h == d or h.endswith("." + d)), key=len, default=None)
    got = domains.longest(spark.createDataFrame(hosts, "id long, host string"), spark.createDataFrame([(d,) for d in table], "domain string"))
    assert rows(got, "id", "domain") == sorted([(i, fits(h)) for i, h in hosts], key=repr)


# --- as-of ---------------------------------------------------------------------------------------------------


def moment(k):
    return None if k is None else START + dt.timedelta(seconds=k)


def as_of_plain(left, right, tolerance=None):
    out = []
    for i, key, t in left:
        fit = [(u, v) for k2, u, v in right if key is not None and t is not None and k2 == key and u is not None and u <= t and (tolerance is None or t - u <= tolerance)]
        out.append((i, max(fit)[1] if fit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "hot", "tolerance"), [(1, 0.0, None), (2, 0.6, None), (3, 0.6, 40), (4, 1.0, None)])
def test_as_of_random(spark, seed, hot, tolerance):
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.03 else "hot" if rng.random() < hot else f"k{rng.randint(0, 30)}"
    left = [(i, key(), rng.choice([None, *range(2000)])) for i in range(400)]
    right = [(key(), u, i) for i, u in enumerate(rng.sample(range(2000), 120))]
    a = spark.createDataFrame([(i, k, moment(t)) for i, k, t in left], "id long, who string, at timestamp").repartition(5)
    b = spark.createDataFrame([(k, moment(u), v) for k, u, v in right], "who string, seen timestamp, value long").repartition(3)
    got = temporal.as_of(a, b, ["who"], "at", "seen", f"{tolerance} seconds" if tolerance else None)
    assert rows(got, "id", "value") == as_of_plain(left, right, tolerance)
    assert got.columns == ["id", "who", "at", "seen", "value"]


def test_as_of_sparse_right(spark):
    """The only right rows of a key lie many tasks before most of its left rows."""
    a = spark.range(4000).select("id", F.lit(1).alias("who"), F.timestamp_seconds(F.col("id") + 10).alias("at"))
    b = spark.createDataFrame([(1, moment(None) or dt.datetime(1970, 1, 1, 0, 0, 5), "first")], "who int, seen timestamp, value string")
    got = temporal.as_of(a, b, ["who"], "at", "seen")
    assert got.where("value = 'first'").count() == got.count() == 4000
    assert temporal.as_of(a, b.limit(0), ["who"], "at", "seen").where("value IS NULL").count() == 4000
    assert temporal.as_of(a.limit(0), b, ["who"], "at", "seen").count() == 0


# --- spans ---------------------------------------------------------------------------------------------------


def test_overlaps_random(spark):
    rng = random.Random(5)

    def spans(n):
        out = []
        for i in range(n):
            s = rng.randint(0, 5000)
            e = s + rng.choice([0, -5, 1, 2, 7, 64, 900, 4000])
            out.append((i, rng.choice(["a", "b", None]), rng.choice([s, s, s, s, None]), e))
        return out

    x, y = spans(150), spans(150)
    table = lambda r, p: spark.createDataFrame([(i, k, moment(s), moment(e)) for i, k, s, e in r], f"{p}id long, k string, {p}s timestamp, {p}e timestamp")
    good = lambda r: [v for v in r if v[2] is not None and v[2] < v[3]]
    pairs = [(a[0], b[0], a[1] == b[1] and a[1] is not None) for a in good(x) for b in good(y) if a[2] < b[3] and b[2] < a[3]]
    keyed = temporal.overlaps(table(x, "x"), table(y, "y"), ["k"], ("xs", "xe"), ("ys", "ye"))
    assert rows(keyed, "xid", "yid") == sorted([(a, b) for a, b, same in pairs if same], key=repr)
    free = temporal.overlaps(table(x, "x").drop("k"), table(y, "y").drop("k"), [], ("xs", "xe"), ("ys", "ye"))
    assert rows(free, "xid", "yid") == sorted([(a, b) for a, b, _ in pairs], key=repr)
    assert not any(n in plan_of(keyed) for n in ("NestedLoop", "Cartesian"))
    assert keyed.columns == ["k", "xid", "xs", "xe", "yid", "ys", "ye"]
    assert temporal.overlaps(table(x, "x").limit(0), table(y, "y"), ["k"], ("xs", "xe"), ("ys", "ye")).count() == 0


def test_overlaps_rows_stay_few(spark):
    """Very long spans beside very short ones: a row for each level that the other side has, not for each short bin."""
    a = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("s"), F.timestamp_seconds(F.col("id") * 60 + 1).alias("e"))
    b = spark.createDataFrame([(1, dt.datetime(1970, 1, 1), dt.datetime(2070, 1, 1))], "wid long, ws timestamp, we timestamp")
    got = temporal.overlaps(a, b, [], ("s", "e"), ("ws", "we"))
    assert got.count() == 1000
