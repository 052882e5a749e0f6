"""Joins over time: the last row before (as-of), and spans that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, tolerance: str | None = None) -> DataFrame:
    """left's rows, each with the columns of right's last row of the same key at or before its time; null without one (within tolerance, an interval).

    Both tables are sorted together by range of (key, time), so a hot key is cut by time, and each task carries the last right row on as it
    reads. What a task's first key had before its range is carried over the border: each task leaves one row, its last right row, and rows of
    left that found none in their task take it from the nearest task before that has one. So one shuffle, and a join with a row a task.

    Defined results: null keys and times match nothing, their rows stay; of right rows with one key and time that with the
    largest hash counts; repeated left rows stay each; columns of right must not be named as columns of left, but for the keys.
    """
    import uuid

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = left.sparkSession
    if clash := set(left.columns) & set(right.columns) - set(on):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    own = [c for c in right.columns if c not in on]
    lefts, rights = left.schema, right.select(*own).schema
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
    fit = lambda df, t: df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*on, t])))
    r = fit(right, right_time).select(*key, F.col(right_time).cast("timestamp").alias("t"), F.lit(0).alias("side"), F.xxhash64(*own).alias("tie"), F.lit(None).cast(lefts).alias("l"), F.struct(*own).alias("r"))
    a = fit(left, left_time).select(*key, F.col(left_time).cast("timestamp").alias("t"), F.lit(1).alias("side"), F.xxhash64(*left.columns).alias("tie"), F.struct(*left.columns).alias("l"), F.lit(None).cast(rights).alias("r"))
    keys = [f"k{i}" for i in range(len(on))]
    order = [*keys, "t", "side", "tie"]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = r.unionByName(a).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("key", F.xxhash64(*keys)).select("key", "side", "l", "r")
    schema = T.StructType().add("part", "integer").add("open", "boolean").add("key", "long").add("l", lefts).add("r", rights)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, first, held, last = TaskContext.get().partitionId(), None, None, None

        def rows(n, open_, k, l, r):
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), open_, k, l, r], ["part", "open", "key", "l", "r"])

        for batch in batches:
            k, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            first = k[0] if first is None else first
            if last is not None and k[0] != last:
                held = None
            n = len(k)
            # Row 0 of ``all_`` is what was held; right rows follow in place.
            place = np.maximum.accumulate(np.where(side == 0, np.arange(1, n + 1), 0))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(1, n + 1), 0))
            own_ = place >= start
            held_fits = (k == k[0]) & (held is not None)
            at = np.where(own_, place, 0)
            none = ~own_ & ~held_fits
            all_ = pa.concat_arrays([held if held is not None else pa.nulls(1, batch.column(3).type), batch.column(3)])
            mine = np.flatnonzero(side == 1)
            if len(mine):
                got = all_.take(pa.array(at[mine], pa.int64(), mask=none[mine]))
                open_ = none[mine] & (k[mine] == first)
                yield rows(len(mine), pa.array(open_), pa.array(k[mine]), batch.column(2).take(pa.array(mine)), got)
            last = k[-1]
            end = n - 1
            held = all_.slice(int(at[end]), 1) if not none[end] else None
        if held is not None:
            yield rows(1, pa.array([None], pa.bool_()), pa.array([last]), pa.nulls(1, left_type), held)

    left_type = to_arrow_schema(schema).field("l").type
    path = f"{scratch(spark)}/asof-{uuid.uuid4().hex}"
    dealt.mapInArrow(run, schema).write.parquet(path)
    met = spark.read.schema(schema).parquet(path)
    # Two rows a task at most: its last right row, and that its first key wants one from before.
    ends = met.where("open IS NULL").select("part", "key", F.lit(1).alias("end"), F.col("r").alias("before"))
    wants = met.where("open").select("part", "key").distinct().select("part", "key", F.lit(0).alias("end"), F.lit(None).cast(rights).alias("before"))
    near = ends.unionByName(wants).withColumn("before", F.last("before", True).over(Window.partitionBy("key").orderBy("part", "end"))).where("end = 0").select("part", "key", "before")
    carried = met.where("open").join(near, ["part", "key"]).select("l", F.col("before").alias("r"))
    found = met.where("NOT open").select("l", "r").unionByName(carried)
    late = F.lit(False) if tolerance is None else F.coalesce(F.col("l")[left_time].cast("timestamp") - F.expr(f"INTERVAL {tolerance}") > F.col("r")[right_time].cast("timestamp"), F.lit(False))
    got = found.select("l.*", *[F.when(~late, F.col("r")[c]).alias(c) for c in own])
    bare = left.where(~F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*on, left_time])))
    return got.unionByName(bare.select("*", *[F.lit(None).cast(rights[c].dataType).alias(c) for c in own]))


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def _level(start: Column, end: Column) -> Column:
    """The least level whose bins, of 2 ** level micros, are as long as a span."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def overlaps(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b with equal keys whose spans [start, end) overlap: all columns of a, then those of b but the keys.

    A span lies in at most two bins of its own level, the least power of two that is as long as it is. Two spans that overlap
    meet at the level of the longer: that one gives its bins there, the shorter is found in the bins that it touches there. So each span is
    exploded to two bins for each level that the other table has, at most, and pairs come from an equi-join on
    (keys, level, bin); of two bins that hold a pair, the one in which the later start lies counts, so no pair comes twice.

    Defined results: a span that is empty, ends before it starts or has a null end or key overlaps nothing; repeated rows pair
    each; without keys (an empty ``on``) spans alone decide.
    """
    if clash := set(a.columns) & set(b.columns) - set(on):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")

    def side(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        keep = [c for c in df.columns if c not in on]
        df = df.select(*on, F.struct(*keep).alias(name), _micros(F.col(span[0])).alias(f"{name}_s"), _micros(F.col(span[1])).alias(f"{name}_e"))
        some = " AND ".join([f"`{c}` IS NOT NULL" for c in on] + [f"{name}_s < {name}_e"])
        return df.where(some).withColumn(f"{name}_l", _level(F.col(f"{name}_s"), F.col(f"{name}_e")))

    x, y = side(a, a_span, "x"), side(b, b_span, "y")
    # 64 numbers at most.
    levels = lambda df, n: sorted(r[0] for r in df.select(f"{n}_l").distinct().collect())
    xs, ys = levels(x, "x"), levels(y, "y")

    def binned(df: DataFrame, n: str, others: list[int]) -> DataFrame:
        """A row for each bin of the span's own level, and of the coarser levels among the others'."""
        s, e, own = F.col(f"{n}_s"), F.col(f"{n}_e"), F.col(f"{n}_l")
        up = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda v: v > own)
        lv = df.withColumn("level", F.explode(F.array_union(F.array(own), up)))
        width = lambda v: F.call_function("shiftright", v, F.col("level"))
        return lv.withColumn("bin", F.explode(F.sequence(width(s), width(e - 1))))

    bx, by = binned(x, "x", ys), binned(y, "y", xs)
    later = F.call_function("shiftright", F.greatest("x_s", "y_s"), F.col("level"))
    met = bx.join(by, [*on, "level", "bin"]).where("x_s < y_e AND y_s < x_e").where(F.col("bin") == later)
    # There the longer of the two is at home; at coarser levels neither is.
    met = met.where(F.col("level") == F.greatest("x_l", "y_l"))
    return met.select(*on, "x.*", "y.*")
