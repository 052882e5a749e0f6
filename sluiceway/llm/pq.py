"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, asymmetric distances, exact rerank.

Equal vectors become one class first. Vectors of each length are indexed on their own; the lists of all lengths are
numbered on. Coarse centroids (spherical k-means) and the codebooks of the residuals' subspaces are learned on a sample of
at most SAMPLE classes (those with the smallest hashes, shared out over the lengths); every class is then indexed: in the list of its nearest
centroid, with its code and the length of what the code misses. Two vectors within the threshold's distance, on either
side of the plane between two centroids, lie together no further from it than the difference's part along its normal; one
of them lies within half of that, and its search comes upon the other. So a class probes every list whose plane lies
within half of REACH standard deviations of a difference along the normal, as the sample's vectors and residuals spread along it (at
least LEAST_PROBES lists). Table lookups give asymmetric distances; a pair stays if its distance less the code's error
is within the threshold's, so the codes lose nothing; cosines in double precision, of the vectors as they came, decide.

Neighbouring lists form groups, and groups are cut into blocks of about BLOCK bytes of vectors: units of work, each of which holds
its vectors while the queries of its lists stream by. A query is sent to a unit once, however many of the group's lists
it probes. A list with a third of all vectors is many units. A unit gives, for each vector, its number of links, and a
spanning forest of the links found, never the pairs. A pair found from one side counts for both.

At most MAX_LISTS lists are made; beyond PER_LIST * MAX_LISTS vectors lists grow longer, and their groups are cut into more blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors
of different lengths link with each other never; equal vectors link with each other whatever their rows; a row without vec_id counts
as a partner, its component being that of its vector (null if no row of it has an id); repeated rows are rows of their own; vectors of any length are compared whole; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SAMPLE, PER_LIST, MAX_LISTS, BLOCK, SUBSPACES, CODES, REACH, LOCAL, LEAST_PROBES = 20_000, 128, 2048, 16 << 20, 8, 256, 2.6, 4, 2
SAMPLE_BYTES, GROUP, ROWS = 64 << 20, 24, 8192


def kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool, seed: int = 11) -> np.ndarray:
    """k centroids of x (fewer rows than k: all of them). Empty ones keep their place."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), (c * c).sum(1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (x[lo : lo + 4096] @ c.T - half).argmax(1)
    return out


def groups(c: np.ndarray, size: int = GROUP) -> np.ndarray:
    """A group for each centroid, of about ``size`` neighbours."""
    k = -(-len(c) // size)
    return nearest(c, kmeans(c, k, 6, True)) if k > 1 else np.zeros(len(c), np.int64)


class Index:
    """What all tasks need: centroids, codebooks and the reach of a probe. Bounded by MAX_LISTS and CODES."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.dim, self.cosine = x.shape[1], cosine
        self.centroids = kmeans(x, max(1, min(lists, len(x))), 8, True)
        self.delta = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        home = nearest(x, self.centroids)
        r = x - self.centroids[home]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.books = [kmeans(r[:, a:b], CODES, 6, False) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        gap = np.sqrt(np.maximum(0, 2 - 2 * self.centroids @ self.centroids.T))
        self.far = self.delta * gap * np.minimum(1.0, REACH / 2 * np.sqrt(self.shares(x, r, home, gap)))
        self.group = groups(self.centroids)

    def shares(self, x: np.ndarray, r: np.ndarray, home: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """For each list and other list, how much of a difference's square lies along the line between their centroids.

        The largest of three measures: the sample's about its mean, the residuals', and the list's own residuals' (as far as
        it has some). A dimension would have 1 / dim of it if all were alike.
        """
        c, square = self.centroids, np.maximum(gap * gap, 1e-12)
        r = r - (r * c[home]).sum(1, keepdims=True) * c[home]  # near vectors differ along the sphere

        def along(v: np.ndarray) -> np.ndarray:
            cov = v.T @ v / max(float((v * v).sum()), 1e-12)
            q = c @ cov @ c.T
            return np.maximum(0, np.diag(q)[:, None] + np.diag(q) - q - q.T) / square

        own, total, n = np.zeros(gap.shape), np.zeros(len(c)), np.bincount(home, minlength=len(c))
        for i in np.unique(home):
            mine = r[home == i]
            own[i] = (((mine @ c.T) - (mine @ c[i])[:, None]) ** 2).sum(0)
            total[i] = (mine * mine).sum()
        own /= square * np.maximum(total, 1e-12)[:, None]
        residuals = along(r)
        local = (n[:, None] * own + LOCAL * residuals) / (n[:, None] + LOCAL)
        return np.maximum(np.maximum(along(x - x.mean(0)), residuals), local)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """(list, codes, error, probes) of vectors."""
        x = v / np.linalg.norm(v, axis=1, keepdims=True)
        home = nearest(x, self.centroids)
        r = x - self.centroids[home]
        codes, miss = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            k = nearest(r[:, a:b], book)
            codes[:, m] = k
            miss += ((r[:, a:b] - book[k]) ** 2).sum(1)
        dots = x @ self.centroids.T
        lag = dots[np.arange(len(x)), home][:, None] - dots
        probe = lag <= self.far[home]
        if dots.shape[1] > LEAST_PROBES:
            probe[np.arange(len(x))[:, None], np.argpartition(lag, LEAST_PROBES - 1, axis=1)[:, :LEAST_PROBES]] = True
        else:
            probe[:] = True
        return home, codes, np.sqrt(miss), [np.flatnonzero(p).tolist() for p in probe]

    def candidates(self, q: np.ndarray, which: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Queries by vectors: whether the table-lookup distance, less the code's error, is within reach of the threshold."""
        x = q / np.linalg.norm(q, axis=1, keepdims=True) - self.centroids[which]
        d = np.zeros((len(q), len(codes)), np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            table = ((x[:, a:b] ** 2).sum(1)[:, None] - 2 * x[:, a:b] @ book.T + (book * book).sum(1)).astype(np.float32)
            d += table[:, codes[:, m]]
        return np.sqrt(np.maximum(d, 0)) <= (self.delta + 1e-3 + error).astype(np.float32)


def valid(v: str) -> F.Column:
    """A vector with finite components, not all zero."""
    x = F.col(v)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda e: e != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """(rep, m, embedding) of each distinct vector."""
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))


def sample_of(reps: DataFrame, sizes: dict[int, int], sample: int) -> dict[int, np.ndarray]:
    """By length, at most ``sample`` vectors in all and SAMPLE_BYTES of them, those with the smallest hashes; each length gets its part.

    One pass for all lengths: only hashes below a length's cut, which lets about twice its part through, are ranked. Lengths
    that come out short all the same are ranked whole in a second one.
    """
    whole = sum(sizes.values())
    rows = {d: max(1, min(n, sample * n // whole, SAMPLE_BYTES * n // whole // (8 * d))) for d, n in sizes.items()}
    hashed = reps.select("embedding", "no", F.size("embedding").alias("d"), F.xxhash64("embedding", "no").alias("h"))

    def smallest(part: dict[int, int], cut: bool) -> dict[int, list]:
        high = lambda d: min((1 << 63) - 1, int(min(1.0, (2 * part[d] + 40) / sizes[d]) * 2.0**64) - (1 << 63)) if cut else (1 << 63) - 1
        limits = C.table_of(reps.sparkSession, [(d, n, high(d)) for d, n in part.items()], "d int, most long, high long")
        ranked = hashed.join(F.broadcast(limits), "d").where("h <= high").withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("h", "no")))
        out: dict[int, list] = {d: [] for d in part}
        for r in ranked.where("k <= most").select("d", "k", "embedding").collect():
            out[r["d"]].append((r["k"], r["embedding"]))
        return out

    found = smallest(rows, True)
    short = {d: n for d, n in rows.items() if len(found[d]) < n}
    found |= smallest(short, False) if short else {}
    return {d: np.array([v for _, v in sorted(found[d])], np.float64) for d in sorted(sizes)}


def indexes(sample: dict[int, np.ndarray], sizes: dict[int, int], cosine: float) -> dict[int, tuple[int, int, Index]]:
    """By length: the number of its first list, that of its first group, and its index. MAX_LISTS lists at most, or one for each length."""
    whole, lists, groups_, out = sum(sizes.values()), 0, 0, {}
    for d, x in sample.items():
        index = Index(x, max(1, min(MAX_LISTS * sizes[d] // whole, sizes[d] // PER_LIST)), cosine)
        out[d] = (lists, groups_, index)
        lists, groups_ = lists + len(index.centroids), groups_ + int(index.group.max()) + 1
    return out


CODED = "no long, m long, vec binary, d int, grp int, home int, codes binary, error double, probes array<int>"


def indexed(reps: DataFrame, all_: dict[int, tuple[int, int, Index]], kind: str) -> DataFrame:
    """CODED's columns of each class. vec has the components as they came, of numpy's type ``kind``."""
    import pyarrow as pa

    shipped = reps.sparkSession.sparkContext.broadcast(all_)
    names = [c.split()[0] for c in CODED.split(", ")]

    def run(batches: Iterator) -> Iterator:
        all_ = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                length = np.diff(some.column(2).offsets.to_numpy())
                for d in np.unique(length).tolist():
                    part = some.take(pa.array(np.flatnonzero(length == d)))
                    base, first, index = all_[d]
                    v = np.array(part.column(2).flatten().to_numpy(zero_copy_only=False), kind).reshape(part.num_rows, -1)
                    home, codes, error, probes = index.encode(v.astype(np.float64))
                    grp = (first + index.group[home]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(np.full(len(v), d, np.int32)), pa.array(grp), pa.array((base + home).astype(np.int32)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(error), pa.array([[base + q for q in p] for p in probes], pa.list_(pa.int32()))], names)

    return reps.select("no", "m", "embedding").mapInArrow(run, CODED)


def _labels(i: np.ndarray, j: np.ndarray, n: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest block vector reachable from each query and block vector over the links (i, j)."""
    lab = np.arange(n)
    while True:
        of_q = np.full(q, n)
        np.minimum.at(of_q, i, lab[j])
        new = lab.copy()
        np.minimum.at(new, j, of_q[i])
        if (new == lab).all():
            return of_q, lab
        lab = new


class Unit:
    """The vectors of a block, by list, and the links that queries find."""

    def __init__(self, parts: list, all_: dict[int, tuple[int, int, Index]], kind: str):
        cat = lambda k: np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts])
        flat = lambda k, t: np.frombuffer(b"".join(x for p in parts for x in p.column(k).to_pylist()), t)
        self.no, self.m, self.home, self.error = cat(3), cat(4), cat(7), cat(9)
        self.base, _, self.index = all_[int(parts[0].column(6)[0].as_py())]
        self.v = flat(5, kind).reshape(len(self.no), -1)
        self.codes = flat(8, np.uint8).reshape(len(self.no), -1)
        self.norm = np.linalg.norm(self.v.astype(np.float64), axis=1)
        self.lists = {int(h): np.flatnonzero(self.home == h) for h in np.unique(self.home)}
        probes = [p for x in parts for p in x.column(10).to_pylist()]
        self.probes = np.full((len(self.no), max(map(len, probes))), -1, np.int32)
        for k, p in enumerate(probes):
            self.probes[k, : len(p)] = p

    def links(self, q: np.ndarray, qno: np.ndarray, probes: list) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, vector) of the pairs within the threshold."""
        at_i, at_j = [], []
        qn = np.linalg.norm(q, axis=1)
        by: dict[int, list[int]] = {}
        for k, p in enumerate(probes):
            for h in p:
                if h in self.lists:
                    by.setdefault(h, []).append(k)
        for h, asked in by.items():
            rows, asked = self.lists[h], np.array(asked)
            found = []
            for lo in range(0, len(rows), ROWS):
                some = rows[lo : lo + ROWS]
                i, j = np.nonzero(self.index.candidates(q[asked], h - self.base, self.codes[some], self.error[some]))
                found.append((asked[i], some[j]))
            i, j = (np.concatenate(x) for x in zip(*found))
            for c in range(0, len(i), 65536):
                a, b = i[c : c + 65536], j[c : c + 65536]
                cos = np.einsum("ij,ij->i", q[a], self.v[b].astype(np.float64)) / (qn[a] * self.norm[b])
                ok = (cos >= self.index.cosine) & (qno[a] != self.no[b])
                at_i.append(a[ok])
                at_j.append(b[ok])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *at_i]), np.concatenate([none, *at_j])


def search(coded: DataFrame, all_: dict[int, tuple[int, int, Index]], blocks: dict[int, int], kind: str) -> DataFrame:
    """(kind, a, b): kind 0 says that vector a has b more links, kind 1 that a and b are in one component."""
    import pyarrow as pa

    spark = coded.sparkSession
    shipped = spark.sparkContext.broadcast(all_)
    of = np.concatenate([first + index.group for _, first, index in all_.values()]).tolist()  # the group of each list, MAX_LISTS or so
    group_of = F.array(*map(F.lit, of))
    count = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])  # a row for each group
    block = F.pmod(F.xxhash64("no"), F.element_at(count, F.col("grp"))).cast("int")
    stored = coded.select("grp", block.alias("block"), F.lit(0).alias("side"), "no", "m", "vec", "d", "home", "codes", "error", "probes")
    wanted = F.array_distinct(F.transform("probes", lambda p: F.get(group_of, p)))
    asked = coded.withColumn("g", F.explode(wanted)).where(F.map_contains_key(count, F.col("g")))
    asked = asked.withColumn("mine", F.filter("probes", lambda p: F.get(group_of, p) == F.col("g")))
    asked = asked.select(F.col("g").alias("grp"), F.explode(F.sequence(F.lit(0), F.element_at(count, F.col("g")) - 1)).alias("block"), F.lit(1).alias("side"), "no", "m", "vec", "d", "home", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.col("mine").alias("probes"))

    def run(batches: Iterator) -> Iterator:
        all_ = shipped.value
        now, held, unit = None, [], None
        for batch in batches:
            grp, bl, side = (batch.column(k).to_numpy() for k in range(3))
            turn = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (bl[1:] != bl[:-1]) | (side[1:] != side[:-1]))))
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(turn, np.append(turn[1:], batch.num_rows)):
                part = batch.slice(int(lo), int(hi - lo))
                if side[lo] == 0:
                    if now != (grp[lo], bl[lo]):
                        now, held = (grp[lo], bl[lo]), []
                    held.append(part)
                    unit = None
                    continue
                if now != (grp[lo], bl[lo]) or not held:
                    continue  # a block without vectors
                unit = unit or Unit(held, all_, kind)
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    qno, qm, qhome = some.column(3).to_numpy(), some.column(4).to_numpy(), some.column(7).to_numpy()
                    q = np.frombuffer(b"".join(some.column(5).to_pylist()), kind).reshape(len(qno), -1).astype(np.float64)
                    i, j = unit.links(q, qno, some.column(10).to_pylist())
                    if not len(i):
                        continue
                    back = (unit.probes[j] == qhome[i][:, None]).any(1)  # whether j's own search comes upon i
                    for rows, add in ((qno, np.bincount(i, weights=unit.m[j], minlength=len(qno))), (unit.no, np.bincount(j[~back], weights=qm[i[~back]], minlength=len(unit.no)))):
                        has = np.flatnonzero(add)
                        out.append((0, rows[has], add[has].astype(np.int64)))
                    of_q, lab = _labels(i, j, len(unit.no), len(qno))
                    for rows, l in ((qno, of_q), (unit.no, lab)):
                        has = np.flatnonzero((l < len(unit.no)) & (rows != unit.no[np.minimum(l, len(unit.no) - 1)]))
                        out.append((1, rows[has], unit.no[l[has]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in out])), pa.array(np.concatenate([a for _, a, _ in out])), pa.array(np.concatenate([b for *_, b in out]))], ["kind", "a", "b"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored.unionByName(asked).repartition(4 * parts, "grp", "block").sortWithinPartitions("grp", "block", "side").mapInArrow(run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, embedding: str = "embedding", vec_id: str = "vec_id", sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors."""
    spark = vectors.sparkSession
    rows = C.wide(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")))
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    ok = valid("embedding")
    good, bad = rows.where(ok), rows.where(~ok)
    # Classes get numbers of their own: vec_id may be null or repeated. The smallest vec_id of a class is its name.
    reps, _ = C.write_out(spark, classes(good).withColumn("no", F.monotonically_increasing_id()), "classes")
    sizes = {r["d"]: r["count"] for r in reps.groupBy(F.size("embedding").alias("d")).count().collect()}  # a row for each length
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    if not sizes:
        return alone.select("*", kept)
    all_ = indexes(sample_of(reps, sizes, sample), sizes, cosine)
    coded, coded_at = C.write_out(spark, indexed(reps, all_, kind), "coded")
    size = int(kind[2])
    blocks = {r["grp"]: -(-r["count"] * r["d"] * size // BLOCK) for r in coded.groupBy("grp", "d").count().collect()}  # a row for each group
    found, found_at = C.write_out(spark, search(coded, all_, blocks, kind), "found")
    C.drop_path(spark, coded_at)
    links, _ = C.write_out(spark, found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")), "links")
    comp, _ = C.components(spark, found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    C.drop_path(spark, found_at)
    whole = reps.join(comp, F.col("no") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "no")).join(links, F.col("no") == F.col("a"), "left")
    least = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "comp").select(F.col("embedding").alias("e"), "m", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    # Classes are joined back by vector; a vector with a third of all rows is split by Spark's skew join.
    out = good.join(named, F.col("embedding") == F.col("e")).select("vec_id", (F.col("m") - 1 + F.col("links")).cast("long").alias("n_links"), "component_id")
    return out.unionByName(alone).select("*", kept)


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
