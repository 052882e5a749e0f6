"""Token ids in files of fixed-width bits: every id takes the fewest bits that hold the vocabulary, and blocks have offsets.

A file, all numbers little-endian:

    blocks    ids of BLOCK each (the last: fewer), id i of a block in bits i * width to (i + 1) * width, lowest bit first
    index     doc ids (int64 each), a byte for each that is 1 if the id is null, starts (uint64: the document's ids before it in
              this file, and one more for the end), block offsets (uint64: bytes before it, and one more for the end)
    trailer   TRAILER: magic, width, ids a block, number of documents, of ids, of blocks, the file's place in the order, and a line feed

So any run of ids is found by its blocks' offsets without reading others, and a block is unpacked by numpy at once: each id is
cut out of the eight bytes that begin where it does.

Spark writes the files: rows (a file each, of at most about FILE ids unless one document has more) go through its text
sink, whose committer leaves no file of a task that failed or ran twice, on any file system Spark knows; the sink's line
feed is the trailer's last byte. Spark reads them as binaryFile rows.

Documents are encoded where they are read and dealt by range of doc_id, the bounds being quantiles of all doc_ids; where one
doc_id is several quantiles, its rows are dealt over the ranges between. Ids are shuffled once, sorted within a range and packed as they
stream by. Where a file's ids begin among all ids is a prefix sum over the files' trailers, one row a file.

The tokenizer drops white space and the case of letters and encodes words by themselves (see ``by_word``), so a task
encodes each word it meets once, keeps the first WORDS of them, and puts texts together by number; tests hold that against
encoding whole texts.

Defined results: null or empty text has the end id alone; a null doc_id comes first; documents that share a doc_id lie next to each
other, each with ids of its own, repeated rows as well; texts of any length are encoded whole; an empty table has no files and gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: What a null key counts as.
NONE = -(1 << 63)
MAGIC, BLOCK, FILE, END, WORDS, LONG = b"SLWBITS1", 1 << 16, 1 << 23, 2, 1 << 18, 64
#: magic, width, block, documents, ids, blocks, place, line feed
TRAILER = "<8sIIQQQqc"
TAIL = struct.calcsize(TRAILER)
#: Stands between words that are encoded together: a character that is a token of its own. Bytes of texts, words, and rows at a time.
BETWEEN, AT_ONCE, TOGETHER, ROWS = "\x1f", 1 << 22, 2000, 2000


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack_bits(data: bytes | np.ndarray, n: int, width: int, first: int = 0) -> np.ndarray:
    """n ids from the first-th on."""
    at = (np.arange(first, first + n, dtype=np.int64)) * width
    low, high = (int(at[0]) >> 3, (int(at[-1]) + width + 7) >> 3) if n else (0, 0)
    part = np.zeros(high - low + 8, np.uint8)
    part[: high - low] = np.frombuffer(data, np.uint8)[low:high]
    eight = np.ndarray((high - low + 1,), "<u8", part, strides=(1,))
    return ((eight[(at >> 3) - low] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


def pack_file(keys: list[int | None], sizes: list[int], ids: np.ndarray, width: int, place: int, block: int = BLOCK) -> bytes:
    """The bytes of a file but for its last, the line feed."""
    blocks = [pack_bits(ids[lo : lo + block], width) for lo in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    starts = np.cumsum([0, *sizes]).astype("<u8")
    none = np.array([k is None for k in keys], np.uint8)
    index = np.array([0 if k is None else k for k in keys], "<i8").tobytes() + none.tobytes() + starts.tobytes() + offsets.tobytes()
    return b"".join([*blocks, index, struct.pack(TRAILER, MAGIC, width, block, len(keys), len(ids), len(blocks), place, b"\n")[:-1]])


class BitFile:
    """A file's documents: ``doc(k)`` reads the blocks that hold it and no others. Takes bytes, or a memory map of them."""

    def __init__(self, data):
        self.data = np.frombuffer(data, np.uint8)
        magic, self.width, self.block, docs, self.n_ids, blocks, self.place, end = struct.unpack(TRAILER, self.data[-TAIL :].tobytes())
        if magic != MAGIC or end != b"\n":
            raise ValueError("not a file of packed ids")
        index = self.data[len(self.data) - TAIL - 17 * docs - 8 * (blocks + 2) : -TAIL].tobytes()
        self.keys, self.none = np.frombuffer(index, "<i8", docs), np.frombuffer(index, np.uint8, docs, 8 * docs) == 1
        self.starts = np.frombuffer(index, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 17 * docs + 8).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places lo to hi of the file."""
        out = [np.empty(0, "<u4")]
        while lo < hi:
            b = lo // self.block
            n = min(hi, (b + 1) * self.block) - lo
            out.append(unpack_bits(self.data[self.offsets[b] : self.offsets[b + 1]], n, self.width, lo - b * self.block))
            lo += n
        return np.concatenate(out)

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def docs(self) -> Iterator[np.ndarray]:
        """All documents in order; a block is unpacked once."""
        held, base, b = np.empty(0, "<u4"), 0, 0
        for lo, hi in zip(self.starts[:-1], self.starts[1:]):
            more, have = [held[lo - base :]], base + len(held)
            while have < hi:
                more.append(self.ids(b * self.block, min((b + 1) * self.block, self.n_ids)))
                have, b = have + len(more[-1]), b + 1
            held, base = np.concatenate(more) if len(more) > 1 else more[0], lo
            yield held[: hi - lo]


def by_word(spec: dict) -> bool:
    """Whether a tokenizer's file says that it encodes each word between blanks by itself: BPE with word ends over pieces that hold no white space, and special tokens that take none with them."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split, plain = steps[0], {"NFC", "Lowercase", "Replace"}
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    bare = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens", []))
    lower = "Lowercase" in {n["type"] for n in norms}
    return lower and bool(spec["model"].get("end_of_word_suffix")) and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and "\\s" in str(split.get("pattern")) and {n["type"] for n in norms} <= plain and bare


#: A letter and what other signs end its word, but for apostrophes, which may begin a piece of their own.
ENDING = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(\s|$)"


def apart(texts):
    """Texts whose words are fewer and have the same ids: A-Z in lower case, signs after a word's last letter as words. Those with special tokens, perhaps, stay as they are."""
    import pyarrow.compute as pc

    return pc.if_else(pc.match_substring(texts, "<|"), texts, pc.replace_substring_regex(pc.ascii_lower(texts), ENDING, r"\1 \2\3"))


class Encoder:
    """Ids of texts, as the bytes of uint16 or uint32 numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.words = {} if by_word(json.load(f)) else None
        self.tok = Tokenizer.from_file(path)
        self.vocabulary = self.tok.get_vocab_size()
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """As _encode(), of words that are one text for the library, which saves its cost of a call for each."""
        size = np.dtype(self.kind).itemsize
        mark = self._encode([BETWEEN])[0]
        for lo in range(0, len(words), TOGETHER):
            part = words[lo : lo + TOGETHER]
            (raw,) = self._encode([f" {BETWEEN} ".join(part)])
            ends = np.flatnonzero(np.frombuffer(raw, self.kind) == np.frombuffer(mark, self.kind)[0]) * size if len(mark) == size else ()
            if len(ends) != len(part) - 1:  # a word holds the character itself
                yield from self._encode(part)
                continue
            for a, b in zip([0, *(ends + size).tolist()], [*ends.tolist(), len(raw)]):
                yield raw[a:b]

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, one after the other, and how many each has."""
        import pyarrow.compute as pc

        if self.words is None:
            raw = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(raw), self.kind), np.array([len(x) for x in raw], np.int64) // np.dtype(self.kind).itemsize
        split = pc.ascii_split_whitespace(apart(texts))
        coded = split.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in pieces], np.int64) // np.dtype(self.kind).itemsize
        table, first, word = np.frombuffer(b"".join(pieces), self.kind), np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[word]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((first[word] - ends[:-1]).astype(np.int32), n)  # a batch has far fewer ids than 1 << 31
        at += np.arange(len(at), dtype=np.int32)
        ids = table[at]
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))])

    def _pieces(self, words: list[str]) -> list[bytes]:
        known = self.words
        new = [w for w in words if w not in known]
        full = len(known) >= WORDS
        known.update(zip(new, self._encode_words(new)))
        out = [known[w] for w in words]
        for w in new:
            if full or len(w) > LONG:
                del known[w]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, bounds: list[int], end: int = END, key: str = "doc_id") -> DataFrame:
    """(doc_id, bucket, n_tokens, ids): each document's ids and the end id, as bytes; bucket is the range between bounds that its doc_id is in, or one of several."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, seen, edges = encoder(path), 0, np.array(bounds, np.int64)
        size = np.dtype(encode.kind).itemsize
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                part, lo = batch.slice(lo, hi - lo), hi
                ids, n = encode(part.column(1))
                raw = np.insert(ids, np.cumsum(n), end).astype(encode.kind)
                offsets = np.concatenate(([0], np.cumsum((n + 1) * size))).astype(np.int32)
                keys = pc.fill_null(part.column(0), NONE).to_numpy()
                low, high = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
                bucket = low + (seen + np.arange(len(keys))) % (high - low + 1)
                seen += len(keys)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bucket, pa.int64()), pa.array(n + 1), pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])], ["doc_id", "bucket", "n_tokens", "ids"])

    return C.wide(docs.select(F.col(key).cast("long").alias("doc_id"), C.text_of().alias("text"))).mapInArrow(run, "doc_id long, bucket long, n_tokens long, ids binary")


def bounds_of(docs: DataFrame, key: str = "doc_id") -> list[int]:
    """Quantiles of a key that cut a table in as many ranges as a shuffle has partitions; null is the least value."""
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    return docs.agg(F.percentile_approx(F.coalesce(F.col(key).cast("long"), F.lit(NONE)), at, F.lit(10_000)).alias("q")).first()["q"] or []


def write_files(tokens: DataFrame, path: str, width: int, file_ids: int = FILE, block: int = BLOCK) -> None:
    """Writes files of packed ids in ascending doc_id order from encoded()'s rows."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        place, keys, sizes, raws, have = None, [], [], [], 0

        def done():
            kind = "<u2" if sum(map(len, raws)) == 2 * have else "<u4"
            value = pack_file(keys, sizes, np.frombuffer(b"".join(raws), kind), width, place, block)
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for batch in batches:
            for k, bucket, n, raw in zip(*(batch.column(c).to_pylist() for c in range(4))):
                other = place is not None and bucket != place >> 32
                if keys and (other or have + n > file_ids):
                    yield done()
                    place, keys, sizes, raws, have = None if other else place + 1, [], [], [], 0
                place = bucket << 32 if place is None else place
                keys.append(k)
                sizes.append(n)
                raws.append(raw)
                have += n
        if keys:
            yield done()

    rows = tokens.repartition(F.col("bucket")).sortWithinPartitions(F.col("bucket"), F.col("doc_id").asc_nulls_first())
    files = rows.select("doc_id", "bucket", "n_tokens", "ids").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents of all files; start counts the ids of all documents before."""
    import pyarrow as pa

    def trailers(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [struct.unpack(TRAILER, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[6] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], ["place", "n_ids"])

    def rows(batches: Iterator) -> Iterator:
        _encoders.clear()  # a worker that has encoded holds words that it needs no more
        for batch in batches:
            for content in batch.column(0):
                file, lo = BitFile(content.as_buffer()), 0
                docs = file.docs()
                while lo < len(file):
                    hi = min(len(file), lo + 1024)
                    size = np.diff(file.starts[lo : hi + 1])
                    out, sums = [], []
                    for x in (next(docs) for _ in range(lo, hi)):
                        sums.append(zlib.crc32(x.astype("<u4").tobytes()))
                        if with_ids:
                            out.append(x.astype(np.int32))
                    cols = [pa.array(np.full(hi - lo, file.place)), pa.array(file.keys[lo:hi], pa.int64(), mask=file.none[lo:hi]), pa.array(file.starts[lo:hi]), pa.array(size), pa.array(sums, pa.int64())]
                    if with_ids:
                        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out))))
                    yield pa.RecordBatch.from_arrays(cols, ["place", "doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    lo = hi

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    tails = files.select(F.substring("content", -TAIL, TAIL).alias("tail")).mapInArrow(trailers, "place long, n_ids long")
    # A row a file: the window sorts these, not documents.
    bases = tails.select("place", (F.sum("n_ids").over(Window.orderBy("place")) - F.col("n_ids")).alias("base"))
    found = files.select("content").mapInArrow(rows, "place long, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return found.join(bases, "place").withColumn("start", F.col("base") + F.col("start")).drop("place", "base")


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows that go to Python at a time, in what is run within: whole texts, of which thousands are too much for a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def token_files(docs: DataFrame, tokenizer: str, path: str, end: int = END, file_ids: int = FILE) -> None:
    """Encodes docs and writes their files to path."""
    with batches_of(docs.sparkSession, ROWS):
        write_files(encoded(docs, tokenizer, bounds_of(docs), end), path, width_of(max(encoder(tokenizer).vocabulary, end + 1)), file_ids)


def op12_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers as P

    path = f"{C.scratch_dir(spark)}/bits-{uuid.uuid4().hex}"
    token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json"), path)
    return read_files(spark, path)
