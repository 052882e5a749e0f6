"""Tiered acquisition over a stream: attempts are kept for each url from micro-batch to micro-batch until one engine has won or all have failed.

The batch operator needs all responses of a url at once. Here they come as they come, in any order. A response that passes
wins as soon as every engine ahead of it has failed; failures are joined once every engine has; what is still open when the wait is
over is decided on what there is. Verdicts are columns, taken before the shuffle, so that only responses that pass carry
bytes into it; state holds one response's bytes at most, and none once the url is decided.

State (RocksDB): the ranks that have answered, the best response so far, and the different failures. A timer for each
url ends the wait and, once more, forgets the url: until then what comes late is known to be late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gate import ENGINES, MIN_BYTES, decided, judged

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINNER = "won int, engine string, status int, data binary, content_type string"
FAILURE = "rank int, engine string, kind string, detail string"
OUT = f"won int, w struct<engine:string,status:int,data:binary,content_type:string>, failed array<struct<{FAILURE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"


class Acquirer(StatefulProcessor):
    """``engines`` ranks there are; a url waits ``wait`` milliseconds of event time from its first response on, and is forgotten after as many more. ``keys`` names what is waited for."""

    def __init__(self, engines: int, wait: int, keys: tuple[str, ...] = ("url",)):
        self.engines, self.wait, self.keys = engines, wait, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Bits of the ranks that have failed; whether the url is decided.
        self.known = handle.getValueState("known", "failed long, done boolean")
        self.best = handle.getValueState("best", WINNER)
        self.failures = handle.getMapState("failures", FAILURE, "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.known.exists()
        failed, done = (0, False) if first else self.known.get()
        best, won = None, self.best.get()[0] if self.best.exists() else None
        earliest = None
        for frame in rows:
            if first:
                least = int(frame["at"].min())
                earliest = least if earliest is None else min(earliest, least)
            if done:
                continue
            bad = frame[frame["kind"].notna()]
            if len(bad):
                for r, e, k, d in set(zip(bad["rank"], bad["engine"], bad["kind"], bad["detail"])):
                    self.failures.updateValue((int(r), e, k, d), (True,))
                for r in set(bad["rank"]):
                    failed |= 1 << int(r)
            for r in frame[frame["kind"].isna()].itertuples(index=False):
                if won is None or r.rank < won:
                    won, best = int(r.rank), (int(r.rank), r.engine, None if pd.isna(r.status) else int(r.status), r.data, r.content_type)
        if best is not None:
            self.best.update(best)
        if first:
            self.handle.registerTimer(earliest + self.wait)
        if not done:
            ahead = sum(1 << k for k in range(1, won if won is not None else self.engines + 1))
            done = failed & ahead == ahead
            self.known.update((failed, done))
            if done:
                yield self._outcome(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failed, done = self.known.get()
        if done:
            self.known.clear()
            return
        self.known.update((failed, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.wait)
        yield self._outcome(key)

    def _outcome(self, key) -> pd.DataFrame:
        names = [x.split(" ")[0] for x in FAILURE.split(", ")]
        failed = [dict(zip(names, x)) for x in sorted(self.failures.keys())] if self.failures.exists() else []
        won, w = None, None
        if self.best.exists():
            won, engine, status, data, content_type = self.best.get()
            w = {"engine": engine, "status": status, "data": data, "content_type": content_type}
        self.best.clear()
        self.failures.clear()
        return pd.DataFrame({**{k: [x] for k, x in zip(self.keys, key)}, "won": pd.array([won], "Int32"), "w": [w], "failed": [failed]})

    def close(self) -> None:
        pass


def acquired(stream: DataFrame, time: str = "captured", wait: str = "10 minutes", expect: str | None = None, min_bytes: int = MIN_BYTES, visit: str | None = None) -> DataFrame:
    """The outcomes of gate.acquire() over a stream of responses with an event time, each once, as soon as it is known.

    ``visit`` names a column that tells a url's visits apart: outcomes are then (url, visit, ...), for gate.merged() to put together.

    Defined results: responses of engines that aren't known and rows without url or time are left out; a second response of an engine that has failed
    can still win while the url is open; what comes after the outcome is dropped.
    """
    ms = _ms(stream.sparkSession, wait)
    keys = ("url", visit) if visit else ("url",)
    rows = judged(stream.where(F.col("url").isNotNull() & F.col(time).isNotNull() & F.col("engine").isin(*ENGINES)).withWatermark(time, wait), expect, min_bytes)
    rows = rows.select(*keys, time, F.unix_millis(time).alias("at"), F.col("rank").cast("int").alias("rank"), "engine", "status", "data", "content_type", "kind", "detail")
    named = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.groupBy(*keys).transformWithStateInPandas(Acquirer(len(ENGINES), ms, keys), f"{named}, {OUT}", "Append", "EventTime")
    return decided(out, *keys)


def _ms(spark: SparkSession, interval: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {interval})").first()[0])


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def acquire_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 1000, **how) -> None:
    """Decides what response files in source allow, appends outcomes to target and stops; the next call goes on from the checkpoint."""
    from .ingest import incoming, run

    with rocks(spark):
        run(acquired(incoming(spark, source, files, how.get("visit")), **how), target, checkpoint).awaitTermination()
