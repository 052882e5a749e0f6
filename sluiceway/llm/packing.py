"""Mixture-controlled packing: deficit round-robin over source queues, cut into sequences of fixed length.

Each source is a queue of tokens. A round of the scheduler is a window of a sequence's tokens, of which every queue
gets its target share; what a share's fraction leaves is carried into the next window (the deficit), so after w windows a
queue has been served floor(w * quantum) tokens or is empty. Queues with a share under BURST tokens are served BURST at a
time, each at a turn that follows from its name, so that their documents don't fall into single tokens; their deficit is
under BURST. That is a closed form: a token's window follows from its place in its queue and its queue's quantum alone,
so windows and partitions need no order of execution and the deficits carry over both. Within a window queues are
served in order of name. Documents are cut where windows or sequences end; the stream has no gaps, so no sequence is
padded. What is left after the last full sequence becomes sequences whose lengths are powers of two.

Places in a queue are a two-level prefix sum: within the written chunk of a task, then over the chunks' totals (a row
for each chunk and queue). Where a window begins in the stream is known in closed form too, from all queues' totals:
with up to TABLE queues every task holds these, and packing shuffles the chunks' totals alone. With more queues no task
holds them all: the pieces are sorted by window and queue over the cluster, and the stream's places are a prefix sum over
them. Both ways give the same pieces (tested); neither joins sources or leaves a target out. Token ids go to the shared
folder once (2 bytes each); a piece has its own. sequences() shuffles the pieces' ids and puts sequences together.

Sources without a target among given targets have the least share there is: their documents come, BURST tokens at a time, as the
others' queues empty.

Defined results: null text is a document of id 1 alone; null source is a queue of its own; documents of any length are cut whole; repeated rows are packed each; an empty table gives
no pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LENGTH, END, TABLE, UNIT, BURST = 2048, 1, 4096, 16, 32
#: Texts of these characters alone take the faster of two libraries that have the same vocabulary and rules.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


class Encoder:
    """Ids of texts under a byte-level BPE file in the tokenizers library's format, special strings included."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and "<|" not in text:
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def tokenized(docs: DataFrame, paths: tuple[str, str | None], queue) -> DataFrame:
    """(doc_id, chunk, queue, qoff, n, ids): qoff is the document's place in its queue within the chunk."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if paths not in _encoders:
            _encoders[paths] = Encoder(*paths)
        encode, chunk, seen = _encoders[paths], TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                queues, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                off, size, out = [], [], []
                for q, t in zip(queues, texts):
                    ids = np.array([*(encode(t) if t else ()), END], "<u4")
                    off.append(seen.get(q, 0))
                    seen[q] = off[-1] + len(ids)
                    size.append(len(ids))
                    out.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, chunk, np.int32)), part.column(1), pa.array(off, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "chunk", "queue", "qoff", "n", "ids"])

    return docs.select("doc_id", queue.alias("queue"), C.text_of().alias("text")).mapInArrow(run, "doc_id long, chunk int, queue string, qoff long, n long, ids binary")


class Shares:
    """How many tokens a window each queue is due, in units of 2**-UNIT: its part of all targets, or of all tokens."""

    def __init__(self, whole: float, targets: dict[str, float] | None, window: int):
        self.whole, self.targets, self.window = whole or 1.0, targets, window

    def __call__(self, names: list[str], totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quantum, burst, phase) of queues."""
        share = [float(self.targets.get(q, 0)) for q in names] if self.targets else totals.astype(float).tolist()
        quantum = np.array([max(1, -int(-(self.window << UNIT) * x // self.whole)) for x in share], np.int64)
        small = quantum < BURST << UNIT
        turn = np.array([zlib.crc32(q.encode("utf-8", "surrogatepass")) * (BURST << UNIT) >> 32 for q in names], np.int64)
        return quantum, np.where(small, BURST, 1).astype(np.int64), np.where(small, turn, 0).astype(np.int64)


def runs(quantum: int, burst: int, phase: int, total: int, at: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, window) of the runs in which n tokens from place ``at`` of a queue are served."""
    start = 0
    while start < n:
        i = at + start
        w = -(-(((i // burst + 1) * burst << UNIT) - phase) // quantum) - 1
        stop = min(at + n, total, ((w + 1) * quantum + phase >> UNIT) // burst * burst)
        if stop <= i:  # the queue's last burst, which its total cuts short
            stop = min(at + n, total)
        yield start, stop - i, w
        start = stop - at


class Sequences:
    """The sequences of a stream of ``end`` tokens."""

    def __init__(self, end: int, length: int):
        self.end, self.length, self.tail = end, length, end - end % length

    def sequence(self, pos: int) -> tuple[int, int, int]:
        """(sequence, offset, room) of a place in the stream. The tail's sequences are the binary digits of its length."""
        seq = pos // self.length
        if pos < self.tail:
            return seq, pos % self.length, self.length - pos % self.length
        at, left = pos - self.tail, self.end - self.tail
        size = self.length
        while True:
            if left & size:
                if at < size:
                    return seq, at, size - at
                at, seq = at - size, seq + 1
            size >>= 1

    def cut(self, start: int, size: int, pos: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a run."""
        while size:
            seq, off, room = self.sequence(pos)
            k = min(size, room)
            yield start, k, seq, off
            start, pos, size = start + k, pos + k, size - k


class Schedule(Sequences):
    """Where each queue's tokens go, from a table of all queues' totals."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = LENGTH, length: int = LENGTH):
        self.names = sorted(totals)
        self.no = {q: i for i, q in enumerate(self.names)}
        self.total = np.array([totals[q] for q in self.names], np.int64)
        super().__init__(int(self.total.sum()), length)
        whole = math.fsum(targets.get(q, 0) for q in self.names) if targets else float(self.end)
        self.quantum, self.burst, self.phase = Shares(whole, targets, window)(self.names, self.total)
        self.last = -(-((self.total + BURST) << UNIT) // self.quantum)  # a window by which a queue is empty
        self.kept: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}

    def window(self, w: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Tokens served to each queue before the window; their sum; each queue's place within the window."""
        if w not in self.kept:
            if len(self.kept) * len(self.names) > 1 << 20:
                self.kept.clear()
            a, b = (np.minimum(self.total, ((np.minimum(x, self.last) * self.quantum + self.phase) >> UNIT) // self.burst * self.burst) for x in (w, w + 1))
            got = b - a
            self.kept[w] = a, int(a.sum()), np.cumsum(got) - got
        return self.kept[w]

    def place(self, queue: str, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of n tokens from place ``at`` of a queue."""
        q = self.no[queue]
        for start, size, w in runs(int(self.quantum[q]), int(self.burst[q]), int(self.phase[q]), int(self.total[q]), at, n):
            served, base, before = self.window(w)
            yield from self.cut(start, size, base + int(before[q]) + at + start - int(served[q]))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids array<int>"


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def _pieces(cols: list[list]):
    import pyarrow as pa

    ends = pa.array(np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32))
    flat = pa.array(np.concatenate([np.empty(0, "<u4"), *cols[8]]).astype(np.int32))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:7]], pa.array(cols[7], pa.string()), pa.ListArray.from_arrays(ends, flat)], NAMES)


def pack(docs: DataFrame, targets: dict[str, float] | None = None, source: str = "source", paths: tuple[str, str | None] | None = None, window: int | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids) per piece; queue is its source. targets: token proportions by source (None for the null one); by default those of the corpus."""
    spark: SparkSession = docs.sparkSession
    # The null source's queue is the empty string; a sign before all others keeps an empty source from it.
    queue = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    targets = {"" if k is None else f"={k}": v for k, v in targets.items()} if targets else None
    tokens, _ = C.write_out(spark, tokenized(C.wide(docs), paths or default_paths(), queue), "tokens")
    sums = tokens.groupBy("chunk", "queue").agg(F.sum("n").alias("n"))
    bases, _ = C.write_out(spark, sums.select("chunk", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("chunk")) - F.col("n")).alias("base"), "n"), "bases")
    totals = bases.groupBy("queue").agg(F.sum("n").alias("total"))
    placed = tokens.join(bases.drop("n"), ["chunk", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("qoff")).alias("at"), "n", "ids")
    few = totals.limit(TABLE + 1).collect()
    if len(few) <= TABLE:
        out = by_table(placed, Schedule({r["queue"]: r["total"] for r in few}, targets, window or length, length))
    else:
        out = by_sort(placed, totals, targets, window or length, length)
    return out.withColumn("queue", F.when(F.col("queue") != "", F.expr("substr(queue, 2)")))


def by_table(placed: DataFrame, plan: Schedule) -> DataFrame:
    """The pieces of documents placed in their queues, each task holding the schedule."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                cols: list[list] = [[] for _ in NAMES]
                for doc, q, at, n, raw in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns)):
                    ids = _ids(raw, n)
                    for start, k, seq, off in plan.place(q, at, n):
                        mine = ids[start : start + k]
                        for c, v in zip(cols, (doc, start, k, zlib.crc32(mine.tobytes()), n, seq, off, q, mine)):
                            c.append(v)
                yield _pieces(cols)

    return placed.mapInArrow(run, PIECES)


def by_sort(placed: DataFrame, totals: DataFrame, targets: dict[str, float] | None, window: int, length: int) -> DataFrame:
    """The same pieces for any number of queues: runs sorted by window and queue, their places a prefix sum."""
    import pyarrow as pa

    spark = placed.sparkSession
    end = int(totals.agg(F.sum("total")).first()[0])
    whole = float(end)
    if targets:
        named = spark.createDataFrame([(q,) for q in targets], "queue string")
        whole = math.fsum(targets[r["queue"]] for r in totals.join(F.broadcast(named), "queue", "left_semi").select("queue").collect())  # a row for each given target at most
    shares = Shares(whole, targets, window)

    def due(batches: Iterator) -> Iterator:
        for batch in batches:
            quantum, burst, phase = shares(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (quantum, burst, phase))], ["queue", "total", "quantum", "burst", "phase"])

    dues, _ = C.write_out(spark, totals.select("queue", "total").mapInArrow(due, "queue string, total long, quantum long, burst long, phase long"), "dues")

    def split(batches: Iterator) -> Iterator:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                out: list[list] = [[] for _ in range(8)]
                for q, doc, at, n, raw, total, quantum, burst, phase in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns)):
                    wide = len(raw) // n
                    for start, k, w in runs(quantum, burst, phase, total, at, n):
                        for c, v in zip(out, (w, q, at + start, doc, start, k, n, raw[start * wide : (start + k) * wide])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    names = ["w", "queue", "at", "doc_id", "start", "k", "n", "ids"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
    schema = "w long, queue string, at long, doc_id long, start long, k long, n long, ids binary"
    cut, cut_at = C.write_out(spark, placed.join(dues, "queue").select("queue", "doc_id", "at", "n", "ids", "total", "quantum", "burst", "phase").mapInArrow(split, schema), "runs")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def number(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.column(5).to_numpy()
            off = seen + np.cumsum(k) - k
            seen += int(k.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(off)], [*names, "part", "off"])

    ordered = cut.repartitionByRange(parts, "w", "queue", "at").sortWithinPartitions("w", "queue", "at")
    numbered, _ = C.write_out(spark, ordered.mapInArrow(number, f"{schema}, part int, off long"), "stream")
    C.drop_path(spark, cut_at)
    size = {r["part"]: r["k"] for r in numbered.groupBy("part").agg(F.sum("k").alias("k")).collect()}  # a row for each partition
    base, at = {}, 0
    for part in sorted(size):
        base[part], at = at, at + size[part]
    plan = Sequences(end, length)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                cols: list[list] = [[] for _ in NAMES]
                for _, q, _, doc, start, k, n, raw, part, off in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns)):
                    ids = _ids(raw, k)
                    for begin, m, seq, o in plan.cut(0, k, base[part] + off):
                        mine = ids[begin : begin + m]
                        for c, v in zip(cols, (doc, start + begin, m, zlib.crc32(mine.tobytes()), n, seq, o, q, mine)):
                            c.append(v)
                yield _pieces(cols)

    return numbered.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces: each sequence put together. None has padding."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
