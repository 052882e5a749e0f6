"""What the operators of this subpackage share: tables in the shared folder, connected components, hashing of word shingles."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one (tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sluiceway-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The session's own folder in the shared one. It is deleted when the driver ends; what is known to be read no more is dropped before."""
    sc = spark.sparkContext
    found = f"{shared_dir(spark)}/sluiceway/{sc.applicationId}"
    if getattr(sc, "_sluiceway_scratch", None) != found:
        path = sc._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc._sluiceway_scratch = found
    return found


def write_out(spark: SparkSession, df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Removes tables of write_out() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tables(spark: SparkSession) -> set[str]:
    """The paths of the session's tables that are there now."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().toString() for x in fs.listStatus(top)} if fs.exists(top) else set()


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a driver's list without Python workers, RDDs or Arrow: JSON in the plan."""
    import json

    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def smallest(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows of df with the smallest hashes of keys (then the smallest keys), as a bounded sample.

    Rows are counted first, so that only those below a cut that lets about twice as many through are sorted, however many
    partitions there are; if that comes out short all the same (as rows that share a hash may make it), all are.
    """
    n = df.count()
    mark = fresh(df, "hash")
    hashed = df.withColumn(mark, F.xxhash64(*keys))
    cut = int(min(1.0, (2 * rows + 40) / max(n, 1)) * 2.0**64) - (1 << 63)
    low = hashed.where(F.col(mark) <= min(cut, (1 << 63) - 1))
    if low.limit(min(rows, n)).count() < min(rows, n):
        low = hashed
    return low.orderBy(mark, *keys).limit(rows).drop(mark)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    while name in df.columns:
        name += "_"
    return name


def wide(df: DataFrame, size_of: int = 1) -> DataFrame:
    """Deals rows of a single-file table over the cluster's cores; keeps as is what has partitions enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism * size_of
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def components(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of edges (u, v) as (node, comp), comp being the smallest node reachable; nodes without edges are absent.

    Alternating large-star and small-star steps: every step is an aggregation and an equi-join of edges, so nothing of
    the graph reaches the driver but a checksum, and the edge count never grows. Each step is written to the shared folder.
    """
    e, path = write_out(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new, new_path = write_out(spark, small.select("x.*").where("u <> v").distinct(), "cc")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        e, path = new, new_path
        if tuple(now) == mark:
            break
        mark = tuple(now)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
    return out, path


#: Marks matches within a text. Texts that hold the character themselves are read twice.
MARK = "\ufdd0"


def cut(text: Column, pattern: str, grouped: str | None = None) -> Column:
    """A text cut at the matches of a pattern, in one pass: what stands before the first, the first, what stands between, and so on; one element without matches.

    ``grouped`` is the pattern with back references a number higher, if it has any.
    """
    marked = F.split(F.regexp_replace(text, f"({grouped or pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.slice(F.flatten(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda p, e: F.array(p, e))), 1, F.size(between) * 2 - 1)
    return F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- word shingles, vectorised over the bytes of a text -------------------------------------------------------

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, MASK, 256, dtype=np.uint64, endpoint=True)
BYTE = BYTE[LOWER]  # A-Z hash as a-z
BASE = np.uint64(0x9E3779B97F4A7C15)
POW = np.ones(4096, np.uint64)
POW[1:] = BASE
POW = np.multiply.accumulate(POW)
K1, K2, K3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global POW
    if n > len(POW):
        p = np.full(max(n, 2 * len(POW)), BASE, np.uint64)
        p[0] = 1
        POW = np.multiply.accumulate(p)
    return POW


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes; words are runs of [^\\x20\\x09-\\x0D], A-Z count as a-z."""
    word = ~SEP[data]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    at = np.flatnonzero(word)
    first = np.cumsum(size) - size
    pos = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(BYTE[data[at]] * powers(int(size.max()))[pos], first)
        return mix(h + size.astype(np.uint64) * K1)


def shingle_set(text: bytes, n: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; of all its words if there are fewer than n; empty without words."""
    w = word_hashes(np.frombuffer(text, np.uint8))
    if not len(w):
        return w
    m = min(n, len(w))
    k = len(w) - m + 1
    h = np.full(k, np.uint64(m), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            h = h * K2 + w[j : j + k]
    return np.unique(mix(h))
