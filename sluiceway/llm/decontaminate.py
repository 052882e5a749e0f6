"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits of any script, lower-cased; characters of scripts that are written without spaces
(ideographs, kana, Thai and the like) are a token each, and all else separates. Documents and benchmark items that share
a run of MATCH tokens (found by their Karp-Rabin hashes) become pairs. A pair is tiled: the longest match of unmarked
tokens is marked, again and again, down to MATCH tokens; no token belongs to two tiles, and tiles may stand in any order,
so reordered passages are caught. A document is contaminated by an item if tiles cover at least COVER of the item's
tokens. Items of fewer than MATCH tokens are matched whole: their run is all their tokens. A pair whose shared runs
together hold too few of the item's tokens isn't tiled: no tiles could cover more.

The places where a pair's runs agree are walked an item's token at a time, diagonal by diagonal, so that what is held of
them are the maximal matches, at most a place of the document for each place of the item that isn't preceded by the same
token in both; tiling ends once no run of the item is free. So a document and an item that repeat themselves cost time
in proportion to their agreeing places, but no list of these.

The benchmark is a stated query set: it is cut into blocks of at most BLOCK bytes of text, and each block is sent to
all executors and tested against all documents in one pass without a shuffle. One block is the usual case.

Defined results: null and empty texts, of documents or items, have no tokens and match nothing; texts of any length are read whole; repeated rows of
documents are judged each, repeated item texts reported each; a column of docs named like the result's is replaced in overlaps(), and
clean() gives all columns as they were, whatever their names; an empty table or benchmark gives no hits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

HITS = T.ArrayType(T.StructType().add("item_id", "long").add("coverage", "double").add("tiles", "integer"))
MATCH, COVER, BLOCK, CHUNK = 5, 0.5, 16 << 20, 2 << 20
#: Scripts written without spaces, by the names of their characters: fixed values of Unicode.
SINGLE = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA", "THAI CHARACTER", "LAO ", "KHMER ", "MYANMAR ", "TIBETAN ", "BOPOMOFO")
CODES = 0x110000
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """By code point: 0 separates, 1 belongs to a run, 2 is a token of its own."""
    if not _kinds:
        import unicodedata

        out = np.zeros(CODES, np.uint8)
        for c in range(CODES):
            if 0xAC00 <= c < 0xD7A4 or 0x4E00 <= c < 0xA000 or 0x20000 <= c < 0x32000:
                out[c] = 1 if c > 0xABFF and c < 0xD7A4 else 2
                continue
            x = chr(c)
            if unicodedata.category(x)[0] in "LMN":
                out[c] = 2 if unicodedata.name(x, "").startswith(SINGLE) else 1
        _kinds.append(out)
    return _kinds[0]


_codes: list[np.ndarray] = []


def code_hashes() -> np.ndarray:
    """A 64-bit hash of each code point."""
    if not _codes:
        _codes.append(C.mix(np.arange(CODES, dtype=np.uint64) + C.K3))
    return _codes[0]


def hash_tokens(data: bytes, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the tokens of lower-cased texts that lie one after another; ``bounds`` has the end of each, in characters."""
    text = np.frombuffer(data, np.uint8) if data.isascii() else np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    what = kind[text]
    word = what > 0
    alone = what == 2
    run = np.concatenate(([False], word, [False]))
    starts, ends = (run[1:-1] & ~run[:-2]) | alone, (run[1:-1] & ~run[2:]) | alone
    if alone.any():
        starts[1:] |= word[1:] & alone[:-1]
        ends[:-1] |= word[:-1] & alone[1:]
    first = np.concatenate(([0], bounds[:-1]))
    first = first[first < len(text)]
    starts[first] = word[first]
    last = bounds[bounds > 0] - 1
    ends[last] = word[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(s):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = e - s
    at = np.flatnonzero(word)
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        h = np.add.reduceat(code_hashes()[text[at]] * C.powers(int(n.max()))[np.arange(len(at)) - np.repeat(first, n)], first)
        return C.mix(h + n.astype(np.uint64) * C.K1), np.searchsorted(bounds, s, side="right")


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of n tokens."""
    k = max(0, len(h) - n + 1)
    out = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * C.K2 + h[j : j + k]
        return C.mix(out)


class Places:
    """Where each hash stands in a text."""

    def __init__(self, r: np.ndarray, at: np.ndarray):
        order = np.argsort(r[at], kind="stable")
        self.at, self.keys = at[order], r[at][order]

    def __call__(self, key: np.uint64) -> np.ndarray:
        return self.at[np.searchsorted(self.keys, key) : np.searchsorted(self.keys, key, side="right")]


def maximal(a: np.ndarray, b: np.ndarray, ra: np.ndarray, places: Places, match: int) -> np.ndarray:
    """(length, place in a, place in b) of the longest common runs of ``match`` tokens and more, by falling length, then by place."""
    out, later = [], np.zeros(len(b) + 1, np.int64)  # runs that begin at a's next token, by place in b
    then = np.empty(0, np.int64)
    for i in range(len(ra) - 1, -1, -1):
        j = places(ra[i])
        size = later[j + 1] + 1  # counted in places where runs of ``match`` begin
        later[then] = 0
        later[j], then = size, j
        new = j if i == 0 else j[(j == 0) | (b[j - 1] != a[i - 1])]
        if len(new):
            out.append(np.stack((later[new] + match - 1, np.full(len(new), i), new), 1))
    if not out:
        return np.empty((0, 3), np.int64)
    out = np.concatenate(out)
    return out[np.lexsort((out[:, 2], out[:, 1], -out[:, 0]))]


def tile(a: np.ndarray, b: np.ndarray, ra: np.ndarray, places: Places, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token runs a and b: (place in a, place in b, length) of the tiles. ra: hashes of a's runs; places: where b's stand."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    whole, rest, at, tiles = maximal(a, b, ra, places, match), [], 0, []
    room = len(a)  # what is free in a, as far as runs of ``match`` go
    while (at < len(whole) or rest) and room:
        if at < len(whole) and (not rest or (-whole[at, 0], whole[at, 1], whole[at, 2]) <= rest[0]):
            k, i, j = map(int, whole[at])
            at += 1
        else:
            k, i, j = heapq.heappop(rest)
            k = -k
        fine = free_a[i : i + k] & free_b[j : j + k]
        if fine.all():
            free_a[i : i + k] = free_b[j : j + k] = False
            tiles.append((i, j, k))
            edge = np.diff(np.concatenate(([0], free_a.view(np.int8), [0])))
            gaps = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
            room = int(gaps[gaps >= match].sum())
            continue
        edge = np.diff(np.concatenate(([0], fine.view(np.int8), [0])))
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if hi - lo >= match:
                heapq.heappush(rest, (lo - hi, i + lo, j + lo))
    return tiles


class Items:
    """A block of the benchmark: tokens, hashes of runs, and the items that hold each, by the length of runs."""

    def __init__(self, rows: list[tuple[int, str]], match: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.kind, self.ids, self.tokens, self.runs, self.match = kinds(), [r[0] for r in rows], [], [], []
        low = pc.fill_null(pc.utf8_lower(pa.array([r[1] for r in rows], pa.string())), "").to_pylist()
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for no, text in enumerate(low):
            h, _ = hash_tokens(text.encode(), np.array([len(text)]), self.kind)
            m = min(match, len(h))
            self.tokens.append(h)
            self.match.append(m)
            self.runs.append(rolling(h, m))
            if m:
                by.setdefault(m, []).append((self.runs[-1], no))
        #: By length of runs: (hashes, the item of each, sorted by hash; a filter by their first bits).
        self.tables = {}
        for m, found in by.items():
            key, item = np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), no) for r, no in found])
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[key >> np.uint64(44)] = True
            self.tables[m] = key[order], item[order], maybe

    def hits(self, h: np.ndarray, m: int, cover: float) -> Iterator[tuple[int, float, int]]:
        """(item, coverage, tiles) of the items with runs of m tokens that contaminate a document of these tokens."""
        key, item, maybe = self.tables[m]
        r = rolling(h, m)
        at = np.flatnonzero(maybe[r >> np.uint64(44)])
        lo, hi = np.searchsorted(key, r[at]), np.searchsorted(key, r[at], side="right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return
        places = Places(r, at)
        ranges = np.unique(np.stack((lo, hi), 1), axis=0)
        for no in np.unique(np.concatenate([item[a:b] for a, b in ranges])).tolist():
            a, ra = self.tokens[no], self.runs[no]
            near = np.minimum(np.searchsorted(places.keys, ra), len(places.keys) - 1)
            step = np.zeros(len(a) + 1, np.int64)
            begins = np.flatnonzero(places.keys[near] == ra)
            np.add.at(step, begins, 1)
            np.add.at(step, begins + m, -1)
            if (np.cumsum(step)[:-1] > 0).sum() / len(a) < cover:
                continue
            tiles = tile(a, h, ra, places, m)
            share = sum(k for *_, k in tiles) / len(a)
            if share >= cover:
                yield self.ids[no], share, len(tiles)


def overlaps(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, cover: float = COVER, name: str = "hits") -> DataFrame:
    """docs' columns with the array ``name`` of (item_id, coverage, tiles), empty for clean documents."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    bench = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    blocks = max(1, -(-int(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    names = [c for c in docs.columns if c != name]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))
    out = C.wide(docs).select(*names)
    for block in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shipped = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id").collect()], match))  # BLOCK bytes or so

        def run(batches: Iterator, shipped=shipped) -> Iterator:
            items = shipped.value
            for batch in batches:
                low = pc.fill_null(pc.utf8_lower(batch.column(batch.schema.get_field_index("text"))), "")
                size, hits, lo = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)), [], 0
                chars = np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
                while lo < batch.num_rows:
                    base = size[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(size, base + CHUNK, side="right")))
                    data = b"".join(v.as_buffer().to_pybytes() for v in low[lo:hi])
                    h, doc = hash_tokens(data, chars[lo:hi] - (chars[lo - 1] if lo else 0), items.kind)
                    ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                    mine: list[list] = [[] for _ in range(hi - lo)]
                    for m, (_, _, maybe) in items.tables.items():
                        r = rolling(h, m)
                        for d in np.unique(doc[np.flatnonzero(maybe[r >> np.uint64(44)])]) if len(r) else ():
                            mine[d] += [{"item_id": i, "coverage": c, "tiles": t} for i, c, t in items.hits(h[ends[d] : ends[d + 1]], m, cover)]
                    hits += mine
                    lo = hi
                cols, said = [*batch.columns], [*batch.schema.names]
                if name in said:
                    k = said.index(name)
                    hits = [(a or []) + b for a, b in zip(cols.pop(k).to_pylist(), hits)]
                    said.pop(k)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hits, kind)], [*said, name])

        schema = docs.select(*names).schema.add(name, HITS)
        out = out.mapInArrow(run, schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of each contaminated document and item."""
    found = overlaps(docs.select("doc_id", "text"), benchmark, match, cover)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, cover: float = COVER) -> DataFrame:
    """The documents without contamination, their columns unchanged."""
    name = C.fresh(docs, "hits")
    return overlaps(docs, benchmark, match, cover, name).where(F.size(name) == 0).select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
