"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split.

A row's bits are BITS of its key's MD5, then BITS of its text's. A bucket is all rows that share the first d bits; it
splits on the next bit as long as its bytes exceed the limit and it has two rows or more. So the buckets are the
shallowest prefixes that fit, whatever the distribution, and a hot key is split by text as any other bucket is by key.

Rows are added up by a prefix a few bits deeper than even filling would need; these sums are rolled up STEP bits at a time,
so that no sum has more than 2 ** STEP parts. A prefix that fits whose parent does not is a bucket (what holds of a prefix
holds of all longer ones, so there is one such on each way down): a join of each prefix with its parent finds them all.
Only buckets that are still too large go to a next pass, with the rows of theirs alone and more bits. Rows equal in key
and text can't be told apart by any hash: if they exceed the limit together they go to overflow buckets by count, so no
row is lost and none is moved to one task.

Native: aggregations and equi-joins of narrow rows (id, bits, bytes); texts are measured where they are read and not
shuffled; the directory is broadcast by Spark only if its written size allows.

Defined results: null key counts as the empty string, null text as 0 bytes; an empty table has no rows and no buckets; a
row that alone exceeds the limit, as one with a very long text may, is a bucket of its own, with fits = false; repeated rows are rows of their own; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BITS, LIMIT, AHEAD, STEP = 60, 1 << 20, 5, 8


def bits_of(x: Column) -> Column:
    """The first 60 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(F.encode(x, "UTF-8")), 1, 15), 16, 10).cast("long")


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def prefix(depth: Column | int) -> Column:
    """The first ``depth`` of 2 * BITS bits, as a string of two numbers."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    # Bits beyond BITS come from the text.
    first = _shift(F.col("h1"), F.lit(BITS) - F.least(d, F.lit(BITS)))
    return F.concat_ws(".", first.cast("string"), F.when(d > BITS, _shift(F.col("h2"), F.lit(2 * BITS) - d).cast("string")))


def bit_string(depth: Column) -> Column:
    """The bucket's bits as text."""
    one = F.lpad(F.conv(F.col("h1").cast("string"), 10, 2), BITS, "0")
    two = F.lpad(F.conv(F.col("h2").cast("string"), 10, 2), BITS, "0")
    return F.substr(F.when(depth > BITS, F.concat(one, two)).otherwise(one), F.lit(1), depth)


def roll_up(cells: DataFrame, low: int, depth: int) -> DataFrame:
    """(d, p, bytes, rows, h1, h2) of all prefixes of low to depth bits, from those of depth bits."""
    now, out = cells.withColumn("d", F.lit(depth)).withColumn("p", prefix(depth)), []
    while True:
        out.append(now)
        if depth == low:
            return reduce(DataFrame.unionByName, out).select("d", "p", "bytes", "rows", "h1", "h2")
        base = max(low, depth - STEP)
        up = now.drop("d", "p").withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(depth - 1)))).withColumn("p", prefix(F.col("d")))
        up = up.groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
        up, _ = C.write_out(cells.sparkSession, up, "shard-sums")
        if base < depth - 1:
            out.append(up.where(F.col("d") > base))
        now, depth = up.where(F.col("d") == base), base


def shard(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, overflow, shard_bytes, shard_rows, fits) per row; shard is the bucket's bits."""
    spark = docs.sparkSession
    text = C.text_of()
    rows = docs.select(F.col(key).alias("doc_id"), bits_of(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h1"), bits_of(text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, low, left, done = max(1, (max(1, total) // limit).bit_length() + AHEAD), 0, rows, []
    more = 8
    while True:
        depth = min(depth, 2 * BITS)
        cells = left.groupBy(prefix(depth).alias("cell")).agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        cells, _ = C.write_out(spark, cells, "shard-cells")
        fit = (F.col("bytes") <= limit) | (F.col("rows") == 1)
        sizes = roll_up(cells.drop("cell"), low, depth).withColumn("fit", fit)
        above = sizes.where((F.col("d") < depth) & F.col("fit")).select((F.col("d") + 1).alias("d"), F.col("p").alias("of"))
        # What fits below a parent that fits is part of the parent's bucket.
        buckets = sizes.where("fit").withColumn("of", prefix(F.greatest(F.col("d") - 1, F.lit(0)))).join(above, ["d", "of"], "left_anti").select("d", "p", "bytes", "rows")
        buckets, _ = C.write_out(spark, buckets, "shard-buckets")
        depths = sorted(r["d"] for r in buckets.select("d").distinct().collect())  # 2 * BITS + 1 rows at most
        own = cells.select("cell", "h1", "h2", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("d")).withColumn("p", prefix(F.col("d")))
        found = own.join(buckets, ["d", "p"]).select("cell", F.col("d").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
        directory, _ = C.write_out(spark, cells.select("cell").join(found, "cell", "left"), "shard-directory")
        placed = left.withColumn("cell", prefix(depth)).join(directory, "cell")
        done.append(placed.where("depth IS NOT NULL").select("doc_id", "n_bytes", bit_string(F.col("depth")).alias("shard"), "depth", F.lit(0).cast("long").alias("overflow"), "shard_bytes", "shard_rows"))
        if not directory.where("depth IS NULL").limit(1).count():
            break
        left = placed.where("depth IS NULL").select("doc_id", "h1", "h2", "n_bytes")
        if depth == 2 * BITS:
            # Equal rows: as many to an overflow bucket as fit. A null key and an empty one share their bits, and number their buckets one after the other.
            each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))).cast("long")
            same = left.groupBy("h1", "h2", "doc_id", "n_bytes").agg(F.count(F.lit(1)).alias("n")).withColumn("each", each).withColumn("runs", F.floor((F.col("n") - 1) / F.col("each")).cast("long") + 1)
            before = F.sum("runs").over(Window.partitionBy("h1", "h2").orderBy("doc_id", "n_bytes")) - F.col("runs")
            runs = same.withColumn("before", before).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
            runs = runs.withColumn("overflow", F.col("before") + F.col("run")).withColumn("shard_rows", F.least("each", F.col("n") - F.col("run") * F.col("each")))
            out = runs.select("doc_id", "n_bytes", bit_string(F.lit(2 * BITS)).alias("shard"), F.lit(2 * BITS).alias("depth"), "overflow", (F.col("n_bytes") * F.col("shard_rows")).alias("shard_bytes"), "shard_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shard_rows"))).alias("copy"))
            done.append(out.drop("copy"))
            break
        low, depth, more = depth + 1, depth + more, 3 * more
    return reduce(DataFrame.unionByName, done).withColumn("fits", F.col("shard_bytes") <= limit)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = f"""
WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
d AS (SELECT d FROM generate_series(0, 30) t(d)),
s AS (SELECT d, h >> CAST({BITS} - d AS INTEGER) AS p, sum(n_bytes) AS b, count(*) AS n FROM r, d GROUP BY ALL HAVING sum(n_bytes) <= {LIMIT} OR count(*) = 1),
m AS (SELECT doc_id, h, n_bytes, min(d) AS depth FROM r JOIN s ON h >> CAST({BITS} - d AS INTEGER) = p GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS overflow, CAST(b AS BIGINT) AS shard_bytes, n AS shard_rows, b <= {LIMIT} AS fits
FROM m JOIN s ON depth = d AND h >> CAST({BITS} - d AS INTEGER) = p
"""
