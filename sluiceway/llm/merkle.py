"""A Merkle manifest of a table, with inclusion proofs looked up by coordinate.

Rows are leaves of their group's tree, and the groups' roots, in order of group, are leaves of the tree above. A node's
coordinate is (group, level, place). Where a leaf's siblings stand follows from its place and the group's size alone, so
a proof needs no walk: the leaf explodes the coordinates of the siblings it needs, an equi-join with the written node
table brings their digests, and in order of level and place they are concatenated (the proof) or folded into the
leaf (the check).

Places are two-level prefix sums: digests, once written, are sorted by range of (group, key, digest, row), which splits
hot groups and repeated rows, and counted by task and group. Nodes are made STEP levels at a time from blocks of
ARITY ** STEP consecutive nodes, each within one task; block and coordinate keys hold at most as many rows.

Near the root a node is wanted by half of all leaves. So only coordinates of the lowest STEP levels are exploded by
leaves. Those further up are exploded by the leaf's ancestors at levels STEP, 2 STEP, ..., whose proofs hold for all
leaves below; a leaf takes its ancestor's by a join on (group, block). So each proof is still the leaf's own coordinates,
looked up, but no key of a join is hot and the rows exploded stay at STEP a leaf at any size.

Defined results: a null field is ``-`` in the leaf, which no value looks like; a null group is a group of its own, before all others; a null key comes
first; rows that share group and key are ordered by their digests, repeated rows are leaves each; a lone leaf is its group's root; an
empty table has no leaves and gives no rows; texts of any length are hashed whole; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

ARITY, STEP, PATH = 2, 8, "array<struct<left:string,right:string>>"


def field(x: Column) -> Column:
    """A value's UTF-8 byte count, a colon and the value; ``-`` if it is null."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(x: Column) -> Column:
    """The hex SHA-256 of a string."""
    return F.sha2(x.cast("binary"), 256)


def placed(spark: SparkSession, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (read from a table) with ``pos``, a row's place in its group ``g`` in the given order, and ``n``, the group's size."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    by = ["g", *(F.col(c).asc_nulls_first() for c in order), "row"]
    dealt = rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), *by).sortWithinPartitions(*by)
    # The number of a row within its task, the task in the upper bits.
    dealt, _ = C.write_out(spark, dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("row"), "merkle-sorted")
    # A row for each task and group that meet: tasks and groups together at most.
    chunks = dealt.groupBy("part", "g").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    w = Window.partitionBy("g").orderBy("part")
    chunks = chunks.select("part", "g", "first", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    return dealt.join(chunks, ["part", "g"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def width(n: Column, level: int | Column, arity: int) -> Column:
    """How many nodes a level has above n leaves."""
    return F.ceil(n / F.pow(F.lit(arity), F.lit(level) if isinstance(level, int) else level)).cast("long")


def depth_of(n: int, arity: int) -> int:
    d = 0
    while n > 1:
        n, d = -(-n // arity), d + 1
    return d


def _up(nodes: Column, arity: int) -> Column:
    """The digests of the next level's nodes within a block."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: digest(F.concat_ws("", F.slice(nodes, i * arity + 1, F.lit(arity)))))


def build(spark: SparkSession, leaves: DataFrame, arity: int = ARITY, step: int = STEP) -> tuple[DataFrame, int]:
    """All nodes (g, level, pos, h, n) above leaves (g, pos, h, n), leaves included; and the depth of the deepest tree."""
    top = leaves.agg(F.max("n")).first()[0] or 0
    depth, block, now, out = depth_of(top, arity), arity**step, leaves.select("g", "pos", "h", "n"), [leaves.select("g", F.lit(0).alias("level"), "pos", "h", "n")]
    for base in range(0, depth, step):
        # Trees whose root is there already have nothing above.
        open_ = now.where(width(F.col("n"), base, arity) > 1)
        blocks = open_.groupBy("g", "n", F.floor(F.col("pos") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("x"))
        levels = [F.transform("x", lambda x: x["h"])]
        cols = blocks.select("g", "n", "b", levels[0].alias("l0"))
        for k in range(1, step + 1):
            # A block of one node, as at a tree's right edge, still goes up while its tree has other nodes.
            here = width(F.col("n"), base + k - 1, arity) > 1
            cols = cols.withColumn(f"l{k}", F.when(here, _up(F.col(f"l{k - 1}"), arity)))
        each = F.array(*(F.struct(F.lit(base + k).alias("level"), (F.col("b") * arity ** (step - k)).cast("long").alias("first"), F.coalesce(F.col(f"l{k}"), F.array().cast("array<string>")).alias("hs")) for k in range(1, step + 1)))
        made = cols.select("g", "n", F.explode(each).alias("x")).select("g", "n", "x.level", "x.first", F.posexplode("x.hs").alias("i", "h"))
        made, _ = C.write_out(spark, made.select("g", "level", (F.col("first") + F.col("i")).alias("pos"), "h", "n"), "merkle-nodes")
        out.append(made)
        now = made.where(F.col("level") == base + step).select("g", "pos", "h", "n")
    return reduce(DataFrame.unionByName, out), depth


def root_of(nodes: DataFrame, arity: int) -> DataFrame:
    """(g, h): the digest at the lowest level that has one node."""
    return nodes.where(width(F.col("n"), F.col("level"), arity) == 1).groupBy("g").agg(F.min_by("h", "level").alias("h"))


def coordinates(base: int, arity: int, step: int) -> Column:
    """The siblings' (level, at, left) for a node at level base, place pos, in a tree of n leaves, up to step levels further; left: it stands before one's own."""

    def others(level: int) -> Column:
        own = F.floor(F.col("pos") / arity ** (level - base)).cast("long")
        first = own - own % arity
        run = F.sequence(first, F.least(first + arity, width(F.col("n"), level, arity)) - 1)
        return F.transform(F.filter(run, lambda p: p != own), lambda p: F.struct(F.lit(level).alias("level"), p.alias("at"), (p < own).alias("left")))

    return F.flatten(F.array(*(others(base + k) for k in range(step))))


def steps(base: int, arity: int, step: int) -> Column:
    """The siblings ``x`` as (left, right) for each level that has one above it: the digests before one's own and after it."""

    def side(level: int, left: bool) -> Column:
        return F.concat_ws("", F.transform(F.filter("x", lambda s: (s["level"] == level) & (s["left"] == left)), lambda s: s["h"]))

    each = (F.struct((width(F.col("n"), base + k, arity) > 1).alias("open"), side(base + k, True).alias("left"), side(base + k, False).alias("right")) for k in range(step))
    return F.transform(F.filter(F.array(*each), lambda v: v["open"]), lambda v: F.struct(v["left"].alias("left"), v["right"].alias("right")))


def paths(spark: SparkSession, leaves: DataFrame, nodes: DataFrame, depth: int, above: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """leaves, each with its group's columns of ``above``, path and siblings among them, to which its own are added.

    path has a (left, right) for each level up to the root, what stands before and after one's own in its run; siblings is all of them as a string.
    """
    carried, block, found = [c for c in above.columns if c not in ("g", "path", "siblings")], arity**step, None
    for base in range(max(0, depth - 1) // step * step, -1, -step):
        level = nodes.where(F.col("level") == base).where(width(F.col("n"), base, arity) > 1).select("g", "pos", "n")
        want = level.select("g", "pos", F.explode(coordinates(base, arity, step)).alias("c")).select("g", "pos", "c.*")
        got = want.join(nodes.where(F.col("level").between(base, base + step - 1)).select("g", "level", F.col("pos").alias("at"), "h"), ["g", "level", "at"])
        got = got.groupBy("g", "pos").agg(F.array_sort(F.collect_list(F.struct("level", "at", "left", "h"))).alias("x"))
        own = (level if base else leaves).join(got, ["g", "pos"], "left")
        # Trees that end within these levels take what stands above their root, others what the ancestor step levels further up has.
        ends = width(F.col("n"), base + step, arity) <= 1
        tops = (level if base else leaves).where(ends).select("g").distinct().join(above, "g").select("g", F.lit(0).cast("long").alias("b"), "path", "siblings", *carried)
        parents = tops if found is None else tops.unionByName(found.select("g", F.col("pos").alias("b"), "path", "siblings", *carried))
        joined = own.withColumn("b", F.floor(F.col("pos") / block)).join(parents, ["g", "b"])
        # One that is its run alone at all these levels has no siblings, yet a step for each.
        joined = joined.withColumn("x", F.coalesce("x", F.array().cast("array<struct<level:int,at:bigint,left:boolean,h:string>>")))
        joined = joined.withColumn("path", F.concat(steps(base, arity, step), F.col("path")))
        found = joined.withColumn("siblings", F.concat(F.concat_ws("", F.transform("x", lambda s: s["h"])), F.col("siblings"))).drop("x", "b")
        if base:
            found, _ = C.write_out(spark, found, "merkle-paths")
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, fields: list[str], group: str, key: str, other: Column | None = None, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """(key, leaf, other, subroot, root, siblings, path) of each row.

    leaf is the digest of all fields; other a further string's digest, null where it is, that is carried along (to be checked
    against the leaf's path); subroot is the group's root; siblings are the proof's digests from the leaf up, left to right.
    """
    spark = docs.sparkSession
    leaf = digest(F.concat(*(field(F.col(f)) for f in fields)))
    # The group as a string: null first, then by its UTF-8 bytes.
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = C.wide(docs.select(*dict.fromkeys([*fields, group, key]), (other if other is not None else F.lit(None).cast("string")).alias("_other")))
    rows, _ = C.write_out(spark, rows.select(g.alias("g"), F.col(key).alias("k"), leaf.alias("h"), digest(F.col("_other")).alias("other")), "merkle-leaves")
    leaves, _ = C.write_out(spark, placed(spark, rows, ["k", "h"]), "merkle-placed")
    nodes, depth = build(spark, leaves, arity, step)
    subroots, _ = C.write_out(spark, root_of(nodes, arity).select(F.lit("").alias("g"), F.col("g").alias("k"), "h"), "merkle-subroots")
    tops, _ = C.write_out(spark, placed(spark, subroots, ["k"]), "merkle-tops")
    upper, height = build(spark, tops, arity, step)
    over = root_of(upper, arity).select("g", F.array().cast(PATH).alias("path"), F.lit("").alias("siblings"), F.col("h").alias("root"))
    above = paths(spark, tops, upper, height, over, arity, step).select(F.col("k").alias("g"), F.col("h").alias("subroot"), "root", "path", "siblings")
    above, _ = C.write_out(spark, above, "merkle-above")
    found = paths(spark, leaves, nodes, depth, above, arity, step)
    return found.select(F.col("k").alias(key), F.col("h").alias("leaf"), "other", "subroot", "root", "siblings", "path")


def verified(rows: DataFrame) -> DataFrame:
    """manifest()'s rows with folded_root, from ``other`` where there is one, else from the leaf, and whether it is the root."""
    return rows.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.concat(*(field(F.col(f) + 1 if f == "n_chars" else F.col(f)) for f in FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    found = verified(manifest(docs, FIELDS, "lang", "doc_id", tampered))
    return found.select("doc_id", "leaf", "subroot", "root", digest(F.col("siblings")).alias("proof_sha256"), "folded_root", "verified")


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
#: The CRC-32 of a number's decimal form, unsigned: {} is the number.
CRC_SQL = f"xor({_CRC}, 4294967295)"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({{{f}}} AS VARCHAR)) || ':' || CAST({{{f}}} AS VARCHAR), '-')" for f in FIELDS) + ")"
OP11_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(**{f: f for f in FIELDS})} AS leaf,
    CASE WHEN {CRC_SQL.format("doc_id")} % 7 = 0 THEN {_LEAF.format(**{f: f for f in FIELDS} | {"n_chars": "n_chars + 1"})} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS level, pos, n, n AS w, leaf AS h FROM p
  UNION ALL SELECT g, level + 1, pos // 2, n, (w + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE w > 1 GROUP BY g, level, pos // 2, n, w),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE w = 1),
u AS (SELECT 0 AS level, pos, n AS w, subroot AS h FROM s
  UNION ALL SELECT level + 1, pos // 2, (w + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE w > 1 GROUP BY level, pos // 2, w),
e AS (
  SELECT p.doc_id, p.leaf, p.pos AS leaf_pos, p.g, t.level, t.pos >> 0 AS own, a.h AS sibling, a.pos AS spot FROM p JOIN t ON t.g = p.g AND t.w > 1 AND t.pos = p.pos >> t.level
    LEFT JOIN t a ON a.g = t.g AND a.level = t.level AND a.pos = xor(t.pos, 1)
  UNION ALL SELECT p.doc_id, p.leaf, p.pos, p.g, 100 + u.level, u.pos, a.h, a.pos FROM p JOIN s ON s.g = p.g JOIN u ON u.w > 1 AND u.pos = s.pos >> u.level
    LEFT JOIN u a ON a.level = u.level AND a.pos = xor(u.pos, 1)),
f AS (SELECT g, leaf_pos AS pos, coalesce(string_agg(sibling, '' ORDER BY level), '') AS proof,
    list(CASE WHEN sibling IS NULL THEN '' WHEN spot < own THEN 'l' || sibling ELSE 'r' || sibling END ORDER BY level) AS path FROM e GROUP BY ALL),
r AS (SELECT p.doc_id, leaf, subroot, (SELECT h FROM u WHERE w = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(other, leaf), coalesce(path, [])), lambda a, x: sha256(CASE WHEN x[1] = 'l' THEN x[2:] || a WHEN x[1] = 'r' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM p JOIN s USING (g) LEFT JOIN f ON f.g = p.g AND f.pos = p.pos)
SELECT *, folded_root = root AS verified FROM r
"""
