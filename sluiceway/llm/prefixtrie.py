"""The prefix trie of rebuilt conversations: what they share, by chained digests of their turns.

A conversation's digests are a chain: D(0) stands for no turn, D(d) is the SHA-256 of D(d - 1) and turn d's own digest. So a
prefix is its last digest, texts are hashed where they are read and never shuffled, and a task that streams turns in
order holds one digest at a time, whatever a conversation's length. Every prefix is a row; grouped by (depth, digest) the rows are the
trie's nodes. Counting and minima are combined before the shuffle, so the root, which all share, and hot first turns
come to a row a task.

Subtree sums: what a node adds goes to all its ancestors. The node's ancestors are the prefixes of its smallest member, which
owns it; nodes of one owner are a stretch of its chain, so their amounts are added up along the chain, from the end on, before they
are exploded to the ancestors: a row for each prefix instead of one for each pair of prefixes. Nodes that add nothing
(one member, and turns after) send nothing.

The ids of the conversations that end at a node are sorted by range of (digest, id), which splits a hot node, and joined
to strings of up to CHUNK ids by the tasks; who hashes a node's strings in order reads a row for CHUNK ids and holds one.

Rebuilding: the first h turns of the conversation at the next lower multiple of BASE, then the own turns after
the first h; h is the CRC-32 of the decimal id modulo HEADS.

Defined results: rows with a null conv_id belong to no conversation and are left out; a null turn comes first; turns that share a number are
ordered by their digests, repeated rows are turns each; null role or text is empty; texts of any length are hashed whole; an
empty table has no nodes, not even a root; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .merkle import CRC_SQL

BASE, HEADS, CHUNK = 100, 6, 4096


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, h, n): turns in order from 1 on, their digests and code points."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # The role's length keeps the two apart.
    h = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), h.alias("h"), F.length(text).cast("long").alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h")
    return rows.withColumn("no", F.row_number().over(w).cast("long")).drop("turn")


def rebuilt(turns: DataFrame, base: int = BASE, heads: int = HEADS) -> DataFrame:
    """(conv_id, part, no, h, n): part 0 is a row for each conversation, part 1 its head's turns, part 2 its own after those."""
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.where("no = 1").select("conv_id", own.alias("k"), (F.col("conv_id") - F.col("conv_id") % base).alias("of"))
    # At most heads - 1 turns of each base, and at most 2 * base conversations that want them.
    first = turns.where((F.col("no") < heads) & (F.col("conv_id") % base == 0)).groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("no", "h", "n"))).alias("head"))
    head = convs.join(first, "of").where("k > 0").select("conv_id", F.explode(F.expr("slice(head, 1, CAST(k AS INT))")).alias("x")).select("conv_id", F.lit(1).alias("part"), "x.*")
    mark = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"), F.lit(None).cast("binary").alias("h"), F.lit(0).cast("long").alias("n"))
    rest = turns.where(F.col("no") > own).select("conv_id", F.lit(2).alias("part"), "no", "h", "n")
    return mark.unionByName(head).unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, n, last) of every prefix of every conversation; parent is the digest before."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        names = ["conv_id", "depth", "digest", "parent", "n", "last"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        held, root = None, hashlib.sha256(b"").digest()

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        for batch in batches:
            found = []
            for conv, part, h, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held:
                    found.append((*held, part == 0))
                held = (conv, 0, root, None, 0) if part == 0 else (conv, held[1] + 1, hashlib.sha256(held[2] + h).digest(), held[2], n)
            if found:
                yield out(found)
        if held:
            yield out([(*held, True)])

    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "no").select("conv_id", "part", "h", "n")
    return dealt.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, n long, last boolean")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the SHA-256 of the ids of each digest, ascending, comma-joined; ends is a table of (digest, conv_id)."""
    import pyarrow as pa

    def join(batches: Iterator) -> Iterator:
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], ["digest", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == CHUNK):
                    yield out()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield out()

    def hashed(batches: Iterator) -> Iterator:
        key, state = None, None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([s for _, s in found])], ["digest", "ends_sha256"])

        for batch in batches:
            found = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state:
                        found.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if found:
                yield out(found)
        if state:
            yield out([(key, state.hexdigest())])

    spark = ends.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, ends.rdd.getNumPartitions())
    chunks = ends.repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").select("digest", "conv_id").mapInArrow(join, "digest binary, first long, ids string")
    return chunks.repartition(F.col("digest")).sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, base: int = BASE, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest) of each node."""
    spark = conversations.sparkSession
    turns, _ = C.write_out(spark, turn_rows(conversations), "trie-turns")
    rows, _ = C.write_out(spark, prefixes(rebuilt(turns, base, heads)), "trie-prefixes")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n"), F.max("parent").alias("parent"), F.every("last").alias("leaf"))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n"))
    nodes, _ = C.write_out(spark, nodes, "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    # What owners' nodes add, at each of their prefixes: their own and all later ones'.
    adds = nodes.where("leaf OR saved > 0").select("conv_id", "depth", F.col("leaf").cast("long").alias("one"), "saved")
    owners = adds.select("conv_id").distinct()
    along = rows.select("conv_id", "depth", "digest").join(owners, "conv_id", "left_semi").join(adds, ["conv_id", "depth"], "left")
    w = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    sums = along.select("depth", "digest", F.coalesce(F.sum("one").over(w), F.lit(0)).alias("one"), F.coalesce(F.sum("saved").over(w), F.lit(0)).alias("saved")).where("one > 0 OR saved > 0")
    sums = sums.groupBy("depth", "digest").agg(F.sum("one").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends, _ = C.write_out(spark, end_hashes(rows.where("last").select("digest", "conv_id")), "trie-ends")
    # All keys once on both sides.
    out = nodes.select("depth", "digest", "parent", "conv_id", "n_convs").join(children, ["depth", "digest"], "left").join(sums, ["depth", "digest"], "left").join(ends, "digest", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    out, _ = C.write_out(spark, out.select("depth", "digest", "parent", "conv_id", "n_convs", *zero, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie-sums")
    # A parent of very many children: nothing is shuffled after this join, so that adaptive execution can split it.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(above, ["depth", "parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.hex("digest").alias("digest"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")


OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS no FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % {BASE} AS of, {CRC_SQL.format("conv_id")} % {HEADS} AS h FROM t),
r AS (SELECT c, 1 AS part, no, role, text FROM c JOIN t ON t.conv_id = of AND no <= h UNION ALL SELECT c, 2, no, role, text FROM c JOIN t ON t.conv_id = c AND no > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, no) AS d, length(text) AS n, sha256(length(role) || ':' || role || text) AS x FROM r),
p AS (SELECT c, d, n, string_agg(x, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS k FROM o UNION ALL SELECT c, 0, 0, '' FROM c),
m AS (SELECT *, max(d) OVER (PARTITION BY c) = d AS last FROM p),
b AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n, min(c) AS owner, bool_and(last) AS leaf, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM m GROUP BY d, k),
s AS (SELECT a.d, a.k, sum(CAST(y.leaf AS INT)) AS n_leaves, sum((y.n_convs - 1) * y.n) AS saved FROM b y JOIN m a ON a.c = y.owner AND a.d <= y.d GROUP BY a.d, a.k),
q AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN '' ELSE k[:64 * (d - 1)] END AS k, count(*) AS n_children FROM b WHERE d > 0 GROUP BY ALL)
SELECT b.conv_id, CAST(b.d AS BIGINT) AS depth, z.conv_id AS parent_conv_id, b.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(b.ends) AS ends_sha256
FROM b JOIN s USING (d, k) LEFT JOIN q USING (d, k) LEFT JOIN b z ON b.d > 0 AND z.d = b.d - 1 AND z.k = CASE WHEN b.d = 1 THEN '' ELSE b.k[:64 * (b.d - 1)] END
"""
