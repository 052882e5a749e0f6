"""Stateful acquisition over a stream against the batch operator."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import gate
from sluiceway.streaming import acquire
from sluiceway.streaming.ingest import SCHEMA

GOOD = b"<html>" + b"x" * 600
START = dt.datetime(2024, 1, 1)


def answers(n: int):
    """Responses of n urls: every mix of engines that pass, fail in one of several ways, or don't answer."""
    kinds = [(200, GOOD), (404, GOOD), (200, b"tiny"), (200, b"Just a moment" + GOOD), (412, GOOD), None]
    out = []
    for k in range(n):
        for e, engine in enumerate(gate.ENGINES):
            if r := kinds[k // len(kinds) ** e % len(kinds)]:
                out.append((f"http://h{k}.org/", engine, bytearray(r[1] + str(k).encode()), "text/html", r[0], START + dt.timedelta(seconds=k)))
    return out


#: Moves the watermark on, so that waits end.
LATE = [("http://last.org/", "http", bytearray(GOOD), "text/html", 200, START + dt.timedelta(days=d)) for d in (1, 2)]


def feed(spark, rows, folder, names):
    for k, name in enumerate(names):
        spark.createDataFrame(rows[k :: len(names)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def plain(df):
    cols = ("url", "engine_used", "status", "data", "content_type", "attempts", "error")
    return sorted(((r.url, r.engine_used, r.status, None if r.data is None else bytes(r.data), r.content_type, None if r.attempts is None else [tuple(a) for a in r.attempts], r.error) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_in_any_order_with_restarts(spark, tmp_path, seed):
    rows = answers(72)
    random.Random(seed).shuffle(rows)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    want = plain(gate.acquire(spark.createDataFrame([*rows, LATE[0]], SCHEMA)))
    for lo in range(0, len(rows), 40):  # each part in a run of its own, from the checkpoint on
        for k in range(lo, min(lo + 40, len(rows)), 20):
            spark.createDataFrame(rows[k : k + 20], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        acquire.acquire_stream(spark, source, target, checkpoint, files=1)
    early = spark.read.parquet(target).count()
    for row in LATE:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        acquire.acquire_stream(spark, source, target, checkpoint, files=1)
    got = spark.read.parquet(target)
    assert plain(got) == want
    # Decided at once: what passed first, and what all engines failed at.
    waits = sum(1 for k in range(72) if k % 6 == 5 and k // 6 % 6 != 5 or k % 6 not in (0, 5) and k // 6 % 6 == 5)
    assert early == len(want) - 1 - waits


def test_once_and_late(spark, tmp_path):
    """A url's outcome comes once; what follows is dropped, rows without url or time and unknown engines as well."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = lambda url, engine, data, at: (url, engine, bytearray(data), "text/html", 200, at)
    rounds = [
        [one("u", "browser", GOOD + b"b", START), one(None, "http", GOOD, START), one("t", "http", GOOD, None), one("e", "carrier pigeon", GOOD, START)],
        [one("u", "http", b"tiny", START), one("u", "http", b"tiny", START)],
        [one("u", "http", GOOD + b"too late", START), one("v", "http", b"tiny", START), one("v", "http", GOOD + b"second", START)],
    ]
    for rows in rounds:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        acquire.acquire_stream(spark, source, target, checkpoint)
    got = {r.url: r for r in spark.read.parquet(target).collect()}
    assert set(got) == {"u", "v"} and spark.read.parquet(target).count() == 2
    assert got["u"].engine_used == "browser" and bytes(got["u"].data)[-1:] == b"b" and len(got["u"].attempts) == 1
    assert got["v"].engine_used == "http" and got["v"].attempts is None


def test_state_is_forgotten(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in (answers(36), LATE[:1], LATE[1:]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        acquire.acquire_stream(spark, source, target, checkpoint)
    left = spark.read.format("statestore").option("stateVarName", "known").load(checkpoint)
    assert left.count() == 0
    assert spark.read.format("statestore").option("stateVarName", "best").load(checkpoint).count() == 0
    assert spark.read.parquet(target).select("url").distinct().count() == spark.read.parquet(target).count() == 36


def test_expected_structure(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [("u", e, bytearray(GOOD + x), "text/html", 200, START) for e, x in (("http", b""), ("browser", b"<title>Results_360</title>"))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    acquire.acquire_stream(spark, source, target, checkpoint, expect="Results_360")
    r = spark.read.parquet(target).select("engine_used", F.element_at("attempts", 1)["kind"].alias("kind")).first()
    assert (r.engine_used, r.kind) == ("browser", "unexpected_structure")
