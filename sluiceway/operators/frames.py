"""Frames over time: sessions, from tables and streams by one definition, and sums over a preceding span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str | None = None, **aggs: Column) -> DataFrame:
    """(key, start, end, rows, aggs) of sessions: runs of a key's events, each no more than a gap after the one before. ``end`` is the last event's time and a gap.

    The same for a table and a stream; of a stream, ``late`` is how long a session waits for events that come late before it is
    given. Defined results: null keys and times are in no session; repeated rows count each; events of one time lie in one session.
    """
    df = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if df.isStreaming:
        df = df.withWatermark(time, late or gap)
    got = df.groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in aggs.items()])
    return got.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "rows", *aggs)


def preceding(events: DataFrame, key: str, time: str, seconds: int, slices: int = 16, **aggs) -> DataFrame:
    """events with aggregates over the rows of the same key from ``seconds`` before to the row's own time, both included.

    aggs: name = function of a column of what the frame holds, as ``n=lambda w: F.count("id").over(w)``. A key's rows are cut into
    slices of ``slices`` spans, each windowed by itself; a row that the next slice may look back to goes there as well,
    as a row that counts and is not given. So a hot key is as many tasks' work as its time has slices, for at most one row more in ``slices``
    if rows come evenly.

    Defined results: rows of a null key are one group, as for any window; a null time has a null in each aggregate; of rows with one time each counts for all.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = seconds * 1_000_000
    size = span * slices
    own = F.floor(at / size)
    # The slices whose rows look back to this one: its own, and the next if it is near enough.
    into = F.when(at.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array(own, F.floor((at + span) / size))))
    rows = events.withColumn("__at", at).withColumn("__own", own).withColumn("__slice", F.explode(into))
    w = Window.partitionBy(key, "__slice").orderBy("__at").rangeBetween(-span, 0)
    got = rows.select("*", *[F.when(F.col("__at").isNotNull(), f(w)).alias(n) for n, f in aggs.items()])
    return got.where(F.col("__slice").eqNullSafe(F.col("__own"))).drop("__at", "__own", "__slice")
