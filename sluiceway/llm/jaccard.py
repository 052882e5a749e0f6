"""N-gram Jaccard join by PartEnum signatures, exact.

A document's set holds its distinct n-word shingles. Equal sets become one class first; all that follows is about
classes, so copies cost nothing. Sets are cut into bands by size such that a set can only be similar enough to sets of
its own band and the next, and two such sets differ in at most k elements, k following from the larger band's end. The
shingle domain is partitioned by hash into n1 parts of three sub-parts each; n1 exceeds k / 2, so at least one part has at
most one difference, and then two of its three sub-parts agree. Enumerating the pairs of sub-parts of every part gives
signatures of which two similar sets share one for certain.

Agreement on an empty pair of sub-parts says nothing, and would put all small sets together. n1 has some parts more
than needed, so only a pair of sets that both have as many empty pairs or more can have nothing but empty agreements; such
sets get further signatures under other partitions, LEVELS in all, and only sets that are as empty under all of them
share a last signature.

Candidates: signatures are shuffled, sorted and streamed; sets that share some form a group. Within a group, sets are
compared by sketches: their elements counted in buckets, whose differences add up to at most the number of
elements in which the sets differ. A pair whose sketches differ by more than similar sets may is none; so sets that share
but a passage fall apart here, exactly, and none is lost. Not all pairs that are left are verified: first each set with
the first leader of its group that it may be similar to (a leader being a set that may be similar to no leader before it), on the
texts, each first partner's text being held while the others stream by; one with many partners is dealt to several tasks.
The links found are joined into components. Then, across components alone, no pairs are written: a group gives those of its sets that
may be similar to one of another component, their texts are dealt to the group, and it is settled there, by counting the elements that
its sets share; it gives a link for each two components that it joins. So no step writes more rows than groups have sets, whatever sets
may be similar to which. A pair that shares several groups counts in the first of them (as far as the LEAST first groups
of each set tell; in all if they don't), which is done twice, as the sets that are left have fewer groups. Sets of a group's largest component are compared with those of others alone. So a group of near copies
costs about a pair each, in sketches as in texts, and no link that joins two components is lost. Groups of over CELL sets (over WEIGHT
elements where texts are compared) are dealt in blocks; a group of many sets none of which is similar to another takes comparisons
with the square of its size, rows only beyond a block.

Shingles are compared by 64-bit hashes, as are whole sets: with 10**9 sets the chance of a mistake is a few per cent
over all of them.

Defined results: null, empty and blank texts have an empty set and link with nothing; texts of fewer than n words have
one shingle, the whole sequence; texts of any length are read whole; repeated rows link with each other; a row without doc_id has no id to link by and takes
part as any other, its component being null only if no row of it has an id; rows that share a doc_id, however many, are sets of their own;
an empty table gives an empty result; other columns, whatever their names, are ignored, and keep_first() hands them on as they were.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEVELS, SUB, SKETCH, LEAST, CELL, WEIGHT, PARTNERS = 3, 3, 128, 16, 8192, 1 << 21, 256


@lru_cache(None)
def band_ends(percent: int, top: int = 1 << 34) -> list[int]:
    """The largest size of each band: a set of size s is similar enough only to sets of up to 100 s / percent elements."""
    out, low = [], 1
    while low <= top:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return out


def differences(end: int, percent: int) -> int:
    """The most elements in which two similar sets of at most ``end`` elements differ: union - intersection with union at most 200 end / (100 + percent)."""
    union = 200 * end // (100 + percent)
    return union * (100 - percent) // 100


@lru_cache(None)
def layout(band: int, percent: int) -> tuple[int, int]:
    """(n1, parts more than needed) of a band: those for which its sets, from the smallest to the largest, give the fewest signatures."""
    ends = band_ends(percent)
    k, least, most = differences(ends[band], percent), (ends[band - 2] if band > 1 else 0) + 1, ends[band]
    best = None
    for need in range(1, k // 4 + 16):
        n1, cost = k // 2 + need, 0.0
        for size in {least + (most - least) * q // 4 for q in range(5)}:
            mean = n1 * SUB * (1 - (SUB - 1) / (SUB * n1)) ** size  # of the parts with an empty pair, about Poisson
            term, below = math.exp(-min(mean, 700)), 0.0
            for z in range(need):
                below += term
                term *= mean / (z + 1)
            again = max(0.0, 1 - below)
            cost += n1 * sum(again**j for j in range(LEVELS))
        if best is None or cost < best[0]:
            best = cost, n1, need
    return best[1], best[2]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set of hashes, for its own band and the next, in 48 bits: two that fall together cost a comparison."""
    ends = band_ends(percent)
    band = int(np.searchsorted(ends, len(s)))
    out = []
    with np.errstate(over="ignore"):
        for b in (band, band + 1):
            n1, need = layout(b, percent)
            tag = np.uint64(((b << 32) * 2654435761) & C.MASK)
            for level in range(LEVELS):
                h = C.mix(s + np.uint64(level * 0x51ED270B + 1))
                part = ((h >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)).astype(np.int64)
                cell = part * SUB + (h & np.uint64(0xFFFF)).astype(np.int64) % SUB
                content, size = np.zeros(n1 * SUB, np.uint64), np.bincount(cell, minlength=n1 * SUB)
                np.add.at(content, cell, C.mix(h))
                content, size = content.reshape(n1, SUB), size.reshape(n1, SUB)
                sig = content.sum(1, dtype=np.uint64)[:, None] - content
                full = (size.sum(1)[:, None] - size) > 0
                where = np.arange(n1 * SUB, dtype=np.uint64).reshape(n1, SUB) + np.uint64(level << 40) + tag
                out.append(C.mix(sig + C.mix(where))[full])
                if int((~full).any(1).sum()) < need:
                    break
            else:
                out.append(C.mix(np.array([tag + np.uint64(0xE11)], np.uint64)))
    return np.concatenate(out) >> np.uint64(16)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        return int(C.mix(np.array([C.mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) * C.K3], np.uint64)).view(np.int64)[0])


def _sets(batch, n: int) -> Iterator[tuple[object, np.ndarray]]:
    """(key, set) of each row of (key, text)."""
    text = batch.column(1)
    for i, key in enumerate(batch.column(0).to_pylist()):
        v = text[i]
        yield key, C.shingle_set(v.as_buffer().to_pybytes(), n) if v.is_valid else np.empty(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall into each bucket, 255 at most. SKETCH buckets, twice as many as often as there are over six elements to each."""
    buckets = SKETCH
    while 6 * buckets < len(s):
        buckets *= 2
    return np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


class Sketches:
    """The sketches of a group's sets; those of half as many buckets are compared after folding, others can't be similar."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(r) for r in raw])
        self.rows, self.at, self.full, self.half = {}, np.empty(len(raw), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            self.rows[w] = rows = np.flatnonzero(self.width == w)
            self.at[rows] = np.arange(len(rows))
            self.full[w] = np.frombuffer(b"".join(raw[r] for r in rows), np.uint8).reshape(len(rows), w).astype(np.int16)
            self.half[w] = self.full[w].reshape(len(rows), 2, w // 2).sum(1, dtype=np.int16)

    def differences(self, k: int, rows: np.ndarray) -> np.ndarray:
        """For each of the given sets a lower bound of the elements in which it differs from the k-th."""
        out = np.full(len(rows), np.iinfo(np.int64).max >> 16)
        w, width = int(self.width[k]), self.width[rows]
        for v, own, others in ((w, self.full, self.full), (2 * w, self.full, self.half), (w // 2, self.half, self.full)):
            at = np.flatnonzero(width == v)
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                out[some] = np.abs(others[v][self.at[rows[some]]] - own[w][self.at[k]]).sum(1)
        return out


def digests(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, sid, sketch): the last two are null for empty sets."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [(len(s), set_id(s), sketch(s)) if len(s) else (0, None, None) for _, s in _sets(batch, n)]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_shingles", "sid", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sid long, sketch binary")


def postings(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, sid) of each distinct set; a set that a task meets again is left out."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        met: set[int] = set()
        for batch in batches:
            sig, sid = [], []
            for _, s in _sets(batch, n):
                if len(s) and (x := set_id(s)) not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(x)
                    sig.append(signatures(s, percent).view(np.int64))
                    sid.append(np.full(len(sig[-1]), x, np.int64))
                if len(sig) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(sid))], ["sig", "sid"])
                    sig, sid = [], []
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(sid))], ["sig", "sid"])

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, sid long")


def shared(posts: DataFrame, hold: int = 1 << 16) -> DataFrame:
    """(grp, sid) of the sets that share a signature. Signatures with the same sets, as far as a task sees them, become one group."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        met: set[int] = set()
        rest_sig, rest_sid = np.empty(0, np.int64), np.empty(0, np.int64)

        def groups(sig: np.ndarray, sid: np.ndarray):
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])))
            sig, sid = sig[new], sid[new]
            at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(at, len(sig)))
            with np.errstate(over="ignore"):
                mark = C.mix(np.add.reduceat(C.mix(sid.view(np.uint64)), at) + size.astype(np.uint64))
            keep = []
            for g in np.flatnonzero(size > 1).tolist():
                if (x := int(mark[g])) not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(x)
                    keep.append(g)
            keep = np.array(keep, np.int64)
            rows = np.repeat(at[keep] - (np.cumsum(size[keep]) - size[keep]), size[keep]) + np.arange(int(size[keep].sum()))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(mark[keep].view(np.int64), size[keep])), pa.array(sid[rows])], ["grp", "sid"])

        long_sig, long_first = None, None  # a signature with more sets than are held is passed on under its own name
        for batch in batches:
            sig, sid = np.concatenate((rest_sig, batch.column(0).to_numpy())), np.concatenate((rest_sid, batch.column(1).to_numpy()))
            if not len(sig):
                continue
            cut = int(np.searchsorted(sig, sig[-1]))
            if long_sig is not None:
                k = int(np.searchsorted(sig, long_sig, side="right"))
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, long_sig)), pa.array(sid[:k])], ["grp", "sid"])
                    sig, sid, cut = sig[k:], sid[k:], max(0, cut - k)
                if len(sig):
                    long_sig = None
            if cut:
                yield groups(sig[:cut], sid[:cut])
            rest_sig, rest_sid = sig[cut:], sid[cut:]
            if len(rest_sig) > hold:
                long_sig = int(rest_sig[0])
                yield pa.RecordBatch.from_arrays([pa.array(rest_sig), pa.array(rest_sid)], ["grp", "sid"])
                rest_sig, rest_sid = rest_sig[:0], rest_sid[:0]
        if len(rest_sig):
            yield groups(rest_sig, rest_sid)

    parts = max(posts.sparkSession.sparkContext.defaultParallelism, int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return posts.repartition(parts, "sig").sortWithinPartitions("sig", "sid").mapInArrow(run, "grp long, sid long")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that are similar enough, as edges (u, v). texts: (sid, text)."""
    import pyarrow as pa

    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("deals")).where("deals > 1")
    deal = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("deals", F.lit(1))).cast("int").alias("salt"))
    deal, path = C.write_out(pairs.sparkSession, deal, "pairs")
    partner = deal.join(texts, F.col("b") == F.col("sid")).select("a", "salt", F.lit(1).alias("side"), "b", "text")
    pivot = deal.select("a", "salt").distinct().join(texts, F.col("a") == F.col("sid")).select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "text")

    def run(batches: Iterator) -> Iterator:
        own, have = None, None
        for batch in batches:
            u, v = [], []
            a, side, b, text = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for i in range(batch.num_rows):
                s = C.shingle_set(text[i].as_buffer().to_pybytes(), n)
                if side[i] == 0:
                    own, have = a[i], s
                    continue
                if own != a[i]:
                    raise RuntimeError("a partner came before its pivot")
                both = len(np.intersect1d(have, s, assume_unique=True))
                if 100 * both >= percent * (len(have) + len(s) - both):
                    u.append(a[i])
                    v.append(b[i])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pivot.unionByName(partner).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "side")
    return dealt.mapInArrow(run, "u long, v long")


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows (grp, sid, blocks, ...) with their block blk, once for each pair (i, j) of blocks that theirs is one of."""
    members = members.withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("blk", j).alias("i"), F.greatest("blk", j).alias("j")))
    return members.withColumn("c", F.explode(cells)).withColumn("i", F.col("c.i")).withColumn("j", F.col("c.j")).drop("c", "blocks")


def with_comp(groups: DataFrame, comp: DataFrame) -> DataFrame:
    return groups.join(comp, F.col("sid") == F.col("node"), "left").select("grp", "sid", F.coalesce("comp", "sid").alias("comp"))


def one_of_each(groups: DataFrame) -> DataFrame:
    """Of the groups (grp, sid) that hold the same sets one."""
    mark = groups.groupBy("grp").agg(F.sum(F.xxhash64("sid", F.lit(1)).cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64("sid", F.lit(2))).alias("two"))
    return groups.join(mark.groupBy("one", "two").agg(F.min("grp").alias("grp")).select("grp"), "grp")


def compare(groups: DataFrame, info: DataFrame, comp: DataFrame | None, percent: int) -> DataFrame:
    """Sets of groups (grp, sid) whose sketches allow similarity, by info (sid, n, sketch).

    Without comp, pairs (kind 0, a < b): each set with the first such leader of its group; and as kind 1 the rows (grp, sid) of sets that have any such partner.
    With comp (node, comp) only the latter, for partners of other components with which no earlier group is known to be shared.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = groups.sparkSession
    if comp is None:
        now = groups.select("grp", "sid", F.lit(0).cast("long").alias("comp"))
        size = now.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    else:
        now, _ = C.write_out(spark, with_comp(groups, comp), "members")
        size = now.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").drop("low", "high")
        least = groups.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("grp")), 1, LEAST).alias("least"))
        info = info.join(least, "sid")
    large = size.where(F.col("size") > CELL) if comp is None else size
    now = now.join(large, "grp", "left" if comp is None else "inner").withColumn("size", F.coalesce("size", F.lit(1)))
    now = in_blocks(now.withColumn("blocks", F.ceil(F.col("size") / CELL).cast("int")))

    first = comp is None

    def near_enough(apart: np.ndarray, m: np.ndarray, mine: int) -> np.ndarray:
        return (100 + percent) * apart <= (100 - percent) * (m + mine)

    def lead(grp, sid, n, sk, out: list[list[np.ndarray]]) -> None:
        """Each set with the first leader that it may be similar to. Every set that may be similar to any is marked."""
        x = Sketches(sk)
        any_ = np.zeros(len(sid), bool)
        leaders, others = [0], []
        for k in range(1, len(sid)):
            rows = np.array(leaders)
            ok = rows[near_enough(x.differences(k, rows), n[rows], n[k])]
            if len(ok):
                any_[ok] = any_[k] = True
                others.append(k)
                out.append([np.zeros(1, np.int32), sid[ok[:1]], sid[k : k + 1]])
                continue
            rows = np.array(others, np.int64)
            ok = rows[near_enough(x.differences(k, rows), n[rows], n[k])] if len(rows) else rows
            if len(ok):
                any_[ok] = any_[k] = True
                out.append([np.zeros(1, np.int32), sid[ok[:1]], sid[k : k + 1]])
            leaders.append(k)
        if any_.any():
            out.append([np.ones(int(any_.sum()), np.int32), np.full(int(any_.sum()), grp), sid[any_]])

    def cell(grp, sid, comp_, blk, n, sk, least, across: bool, out: list[list[np.ndarray]]) -> None:
        """The sets that may be similar to one of another component."""
        x = Sketches(sk)
        any_ = np.zeros(len(sid), bool)
        kinds, of, size = np.unique(comp_, return_inverse=True, return_counts=True)
        small = of != size.argmax()  # the largest component's sets are compared by those of others
        for k in np.flatnonzero(small).tolist():
            ok = comp_ != comp_[k]
            ok &= ~small | (np.arange(len(sid)) < k)  # each pair once
            if across:
                ok &= blk != blk[k]
            rows = np.flatnonzero(ok)
            before = least[k][least[k] < grp]
            if len(before):
                rows = rows[~np.isin(least[rows], before).any(1)]
            rows = rows[near_enough(x.differences(k, rows), n[rows], n[k])]
            if len(rows):
                any_[rows] = any_[k] = True
        if any_.any():
            out.append([np.ones(int(any_.sum()), np.int32), np.full(int(any_.sum()), grp), sid[any_]])

    def run(batches: Iterator) -> Iterator:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if rest is None:
                    return
                now, last = rest, True
            else:
                now, last = (batch if rest is None else pa.concat_batches([rest, batch])), False
            if not now.num_rows:
                continue
            grp, i, j = (now.column(k).to_numpy() for k in range(3))
            at = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            ends = np.append(at[1:], now.num_rows)
            if not last:
                rest, at, ends = now.slice(int(at[-1])), at[:-1], ends[:-1]
            sid, comp_, blk, n = (now.column(k).to_numpy() for k in range(3, 7))
            sk, out = now.column(7).to_pylist() if len(at) else [], []
            if not first:
                least = np.full((now.num_rows, LEAST), np.iinfo(np.int64).max)
                least[np.arange(LEAST) < pc.list_value_length(now.column(8)).to_numpy()[:, None]] = now.column(8).flatten().to_numpy()
            for lo, hi in zip(at.tolist(), ends.tolist()):
                if hi - lo > 1 and first:
                    lead(grp[lo], sid[lo:hi], n[lo:hi], sk[lo:hi], out)
                elif hi - lo > 1:
                    cell(grp[lo], sid[lo:hi], comp_[lo:hi], blk[lo:hi], n[lo:hi], sk[lo:hi], least[lo:hi], i[lo] != j[lo], out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["kind", "a", "b"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    full = now.join(info, "sid").select("grp", "i", "j", "sid", "comp", "blk", "n", "sketch", *([] if first else ["least"]))
    return full.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "sid").mapInArrow(run, "kind int, a long, b long")


def joins(sid: np.ndarray, comp: np.ndarray, blk: np.ndarray, sets: list[np.ndarray], across: bool, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components (across: of different blocks), one for each two components that come together."""
    size = np.array([len(s) for s in sets])
    elements, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(elements, kind="stable")
    new = np.concatenate(([True], np.diff(elements[order]) != 0))
    start, rank = np.flatnonzero(new), np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    count, holder = np.diff(np.append(start, len(order))), own[order]
    _, root, members = np.unique(comp, return_inverse=True, return_counts=True)
    most, out = int(members.argmax()), []
    for k, at in enumerate((np.cumsum(size) - size).tolist()):
        other = root != root[k]
        if across:
            other &= blk != blk[k]
        if root[k] == most or not other.any():  # the largest component's sets are compared by those of others
            continue
        element, both, lo = rank[at : at + size[k]], np.zeros(len(sets), np.int64), 0
        ends = np.cumsum(count[element])
        while lo < len(element):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")))
            some = count[element[lo:hi]]
            both += np.bincount(holder[np.repeat(start[element[lo:hi]] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))], minlength=len(sets))
            lo = hi
        for x in np.flatnonzero(other & (100 * both >= percent * (size + size[k] - both))).tolist():
            a, b = sorted((int(root[k]), int(root[x])), key=lambda r: r == most)
            if a != b:
                out.append((int(sid[k]), int(sid[x])))
                root[root == a] = b
    return out


def settle(groups: DataFrame, info: DataFrame, comp: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (u, v) that join the components (node, comp) of all sets that share a group (grp, sid) and are similar enough. texts: (sid, text)."""
    import pyarrow as pa

    spark = groups.sparkSession
    now, _ = C.write_out(spark, with_comp(groups, comp).join(info.select("sid", "n"), "sid"), "members")
    blocks = now.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n") / WEIGHT)).cast("int").alias("blocks"))
    now = in_blocks(now.join(blocks, "grp")).join(texts, "sid").select("grp", "i", "j", "sid", "comp", "blk", "text")

    def run(batches: Iterator) -> Iterator:
        key, held = None, []
        for batch in itertools.chain(batches, [None]):
            found = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6)) if batch is not None else [(None,) * 7]
            for grp, i, j, sid, comp_, blk, text in rows:
                if (grp, i, j) != key:
                    if len(held) > 1:
                        ids, comps, blks, sets = zip(*held)
                        found += joins(np.array(ids), np.array(comps), np.array(blks), list(sets), key[1] != key[2], percent)
                    key, held = (grp, i, j), []
                if text is not None:
                    held.append((sid, comp_, blk, C.shingle_set(text.as_buffer().to_pybytes(), n)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return now.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "sid").mapInArrow(run, "u long, v long")


def link_classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, sid) per row and (node, comp) per class that is linked with another."""
    spark = docs.sparkSession
    docs = C.wide(docs.select("doc_id", "text"))
    rows, _ = C.write_out(spark, digests(docs, n), "digests")
    groups, groups_at = C.write_out(spark, shared(postings(docs, n, percent)).distinct(), "groups")
    info = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
    info, info_at = C.write_out(spark, info.join(groups.select("sid").distinct(), "sid"), "info")
    found, found_at = C.write_out(spark, compare(groups, info.drop("doc_id"), None, percent), "pairs")
    C.drop_path(spark, groups_at)
    # Sets that may be similar to another; signatures whose sets are now the same become one group.
    left = found.where("kind = 1").select(F.col("a").alias("grp"), F.col("b").alias("sid"))
    groups, groups_at = C.write_out(spark, one_of_each(left), "groups")
    # One text for each class that is left.
    first, first_at = C.write_out(spark, info.select("sid", "doc_id").join(groups.select("sid").distinct(), "sid"), "first")
    texts, texts_at = C.write_out(spark, _texts(docs, first, n), "texts")
    C.drop_path(spark, first_at)
    edges, edges_at = C.write_out(spark, verify(found.where("kind = 0").select("a", "b").distinct(), texts, n, percent), "links")
    comp, comp_at = C.components(spark, edges)
    C.drop_path(spark, edges_at, found_at)
    for _ in range(2):
        found, found_at = C.write_out(spark, compare(groups, info.drop("doc_id"), comp, percent), "across")
        left, left_at = C.write_out(spark, one_of_each(found.select(F.col("a").alias("grp"), F.col("b").alias("sid")).distinct()), "left")
        C.drop_path(spark, found_at, groups_at)
        groups, groups_at = left, left_at
        if not left.limit(1).count():
            break
    else:
        edges, edges_at = C.write_out(spark, settle(groups, info, comp, texts, n, percent), "links")
        whole, _ = C.components(spark, edges.union(comp.select(F.col("node").alias("u"), F.col("comp").alias("v"))))
        C.drop_path(spark, edges_at, comp_at)
        comp = whole
    C.drop_path(spark, groups_at, info_at, texts_at)
    return rows, comp


def _marked(docs: DataFrame, n: int, name: str) -> DataFrame:
    """docs with the id of each text's set, null for empty ones."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sid = [set_id(s) if len(s) else None for _, s in _sets(batch.select(["text", "text"]), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sid, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _texts(docs: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """(sid, text): the text of one row of each class.

    An id of one class alone finds its row's text; rows of ids that name several classes, and rows without id, are
    marked with their set and found by that, so that no id, nor its absence, joins many rows with many classes.
    """
    ids = first.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("classes"), F.min("sid").alias("want"))
    own = docs.join(ids.where("classes = 1").drop("classes"), "doc_id").select("text", "want")
    out = _marked(own, n, "sid").where("sid = want").select("sid", "text")
    if first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1 OR doc_id IS NULL").limit(1).count():
        several = ids.where("classes > 1").select("doc_id")
        rest = docs.where("doc_id IS NULL").select("text").unionByName(docs.join(several, "doc_id", "left_semi").select("text"))
        named = first.join(several.withColumn("several", F.lit(True)), "doc_id", "left").where("several OR doc_id IS NULL").select("sid")
        out = out.unionByName(_marked(rest, n, "sid").where("sid IS NOT NULL").join(named, "sid", "left_semi").select("sid", "text"))
    return out.dropDuplicates(["sid"])


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) per row: the smallest doc_id reachable by links, and that among equal sets."""
    return _named(*link_classes(docs, n, percent)).drop("sid")


def _named(rows: DataFrame, comp: DataFrame) -> DataFrame:
    classes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("class_id"))
    whole = classes.join(comp, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = whole.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = whole.join(least, "comp").select("sid", "class_id", "component_id")
    out = rows.join(named, "sid", "left")
    own = lambda name: F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col(name)).alias(name)
    return out.select("sid", "doc_id", "n_shingles", own("component_id"), own("class_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: a row of the smallest doc_id; rows with empty sets all stay.

    Of rows that share the smallest doc_id the one with the smallest text stays. Rows without doc_id stay only where no row
    of their component has one. Texts are not shuffled unless ids are repeated: who goes is decided on ids.
    """
    rows, comp = link_classes(docs, n, percent)
    named = _named(rows, comp)
    # Ids of which some row goes, or whose row must be told apart from others of the same id.
    goes = F.max(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNotNull()))
    drop = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), goes.alias("goes"), F.max("n_shingles").alias("n"))
    odd, _ = C.write_out(docs.sparkSession, drop.where("goes OR (rows > 1 AND n > 0)"), "drops")
    if odd.where("rows > 1").limit(1).count():
        return _tell_apart(docs, rows, comp, n)
    if odd.where("doc_id IS NULL").limit(1).count():
        docs = docs.where("doc_id IS NOT NULL")
    return docs.join(odd.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def _tell_apart(docs: DataFrame, rows: DataFrame, comp: DataFrame, n: int) -> DataFrame:
    """keep_first() for tables in which doc_ids are repeated: rows are matched by id and set, texts being shuffled once."""
    names = docs.columns
    classes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("id"))
    whole = classes.join(comp, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "sid"))
    mark, key, own = (C.fresh(docs, x) for x in ("sid_of_row", "sid_kept", "id_kept"))
    first = whole.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sid")).alias("x")).select(F.col("x.sid").alias(key), F.col("x.id").alias(own))
    marked = _marked(docs, n, mark)
    kept = marked.where(F.col(mark).isNotNull()).join(first, (F.col(mark) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)))
    # Of a class's rows one: the least, found before the shuffle as well as after it.
    one = kept.groupBy(mark).agg(F.min(F.struct(*[F.col(c) for c in sorted(names, key=lambda c: c != "text")])).alias("x")).select(*[F.col("x")[c].alias(c) for c in names])
    return marked.where(F.col(mark).isNull()).select(*names).unionByName(one)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
