"""Rollups with sketches: counts, sums, distinct counts and quantiles by any set of dimensions, from cells that are stored and merged.

A cell is the finest group. Its sketches are built where rows are read and merged once by a shuffle of cells, not rows. All coarser groups
come from stored cells: grouping sets expand cells, a handful of which stand for millions of rows, and merge sketches. New data give
new cells, which are appended; a table of cells may hold a group many times.

Distinct counts are HyperLogLog sketches of 2 ** LG registers, whose error is about 1.04 / 2 ** (LG / 2) (one standard deviation: 0.8 per
cent at 14); quantiles are KLL sketches, whose rank is off by about 1.7 / K (0.9 per cent at 200, the library's default).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 14, 200


def cells(df: DataFrame, dims: list[str], distinct: str, measure: str, lg: int = LG, k: int = K) -> DataFrame:
    """(dims, rows, total, users, levels): for each finest group how many rows, the measure's sum, and sketches of distinct values and of the measure.

    Defined results: null dimensions are a group; null values count as rows, and for nothing else; a group without a measure has a null
    sum and no quantiles; an empty table has no cells.
    """
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("rows"), F.sum(measure).alias("total"), F.hll_sketch_agg(F.col(distinct), F.lit(lg)).alias("users"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(k)).alias("levels"))


def merged(stored: DataFrame, dims: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """(dims, level, rows, total, users, levels) for each of the grouping sets (all subsets by default), from cells; sketches stay sketches.

    level is the number of the set among sets; a dimension that a set leaves out is null.
    """
    sets = [[d for i, d in enumerate(dims) if not m >> i & 1] for m in range(1 << len(dims))] if sets is None else sets
    which = F.grouping_id(*dims)
    number = reduce(lambda out, x: F.when(which == sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in x[1]), x[0]).otherwise(out), enumerate(sets), F.lit(None).cast("int"))
    got = stored.groupingSets([[F.col(d) for d in s] for s in sets], *dims)
    return got.agg(number.alias("level"), F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("levels").alias("levels"))


def distinct(users: Column) -> Column:
    return F.hll_sketch_estimate(users)


def quantile(levels: Column, rank: float) -> Column:
    """The value at a rank; null if there is none."""
    return F.when(F.kll_sketch_get_n_double(levels) > 0, F.kll_sketch_get_quantile_double(levels, F.lit(rank)))
