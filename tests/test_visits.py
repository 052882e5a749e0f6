"""Several visits of a url: acquisition against its SQL, in batch and over a stream. DuckDB breaks the SQL's ties in the table's order on one thread only."""

import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from sluiceway.operators import gate
from sluiceway.plans.queries import ORACLE, QUERIES, asked_in_turn
from sluiceway.streaming import acquire


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Pages of which up to five have the same url."""
    top = str(tmp_path_factory.mktemp("visits"))
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    url = p.select((F.col("page_id") * 3 % 83).alias("k"), "url").groupBy("k").agg(F.min("url").alias("first"))
    p = p.withColumn("k", F.col("page_id") * 3 % 83).join(url, "k").withColumn("url", F.col("first")).select("page_id", "url", "html")
    p.coalesce(1).sortWithinPartitions("page_id").toPandas().to_parquet(f"{top}/pages.parquet")
    return top


def compared(spark, top, name):
    con = connect(top)
    con.execute("SET threads = 1")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, top)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", ["acquire_failures", "fetch_summary", "raw_record", "tiered_acquire"])
def test_visits_of_one_url(spark, repeated, name):
    compared(spark, repeated, name)


def test_stream_of_visits(spark, repeated):
    compared(spark, repeated, "stream_acquire")


def test_visits_over_many_batches(spark, repeated, tmp_path):
    h, b = asked_in_turn(spark, repeated)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for r in (b, h):
        timed = r.withColumn("captured", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 3600))
        timed.repartition(2).write.mode("append").parquet(source)
    acquire.acquire_stream(spark, source, target, checkpoint, files=1, visit="page_id", wait="36500 days")
    as_text = lambda df: sorted(str(r) for r in df.collect())
    assert as_text(gate.merged(spark.read.parquet(target), "page_id")) == as_text(gate.acquire(h.unionByName(b), visit="page_id"))
