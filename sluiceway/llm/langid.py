"""Language ID: per-language unigram piece probabilities over a fixed public vocabulary, marginalised over segmentations.

The vocabulary is that of a public byte-level BPE file: all its pieces that can stand in a word (every single byte is one
of them). A word is a run of letters (a-z and all bytes beyond ASCII but those of punctuation, lower-cased by Unicode)
with a space before it; no piece crosses words, so a text's probability is the product of its words', and a word's is
summed over all its segmentations by the forward algorithm, whatever its length: sums are rescaled as they fall, and
words of over MATRIX bytes go through products of transfer matrices, which are the same sum.

Learning: expectation-maximisation (forward-backward) over the words of at most ROWS rows of each language, the rows
with the smallest hashes, and of their first CHARS characters: these bounds are the parameters ``rows`` and ``chars``. To learn from, words of over LEARN
bytes are cut between characters. Prediction runs over whole texts, in Arrow batches cut by bytes; each distinct word of a
batch is scored once for all languages, and a task keeps the scores of CACHE words.

Defined results: null text or text without a letter: ``und`` with score 0. Equal posteriors: the language first in
order. Without labelled rows every document is ``und``. Rows with null doc_id are predicted and never learned from.
Repeated rows are predicted each. Columns of docs named like the result's are replaced; others come out as they were.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEARN, MATRIX, SEGMENT, ROWS, CHARS, CHUNK, CACHE = 32, 2048, 32, 300, 1 << 15, 2 << 20, 1 << 18
TINY, HUGE = 1e-120, 1e120
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a .tiktoken file (base64 and rank on each line) that words may hold, and all single bytes."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return sorted({p for p in pieces if len(p) == 1 or re.fullmatch(rb" ?[a-z\x80-\xff]+", p)})


class Lookup:
    """Piece numbers by 64-bit hashes of pieces, in hash tables; the last is free of collisions."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.sizes = len(pieces), sorted({len(p) for p in pieces})
        keys = np.zeros(self.n, np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(BASE) + c + 1) & C.MASK
            keys[i] = h
        rng = np.random.Generator(np.random.PCG64(7))
        rest = np.arange(self.n)
        self.tables = []
        while len(rest):
            best = None
            for _ in range(12):
                k = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
                with np.errstate(over="ignore"):
                    _, first = np.unique((keys[rest] * k) >> np.uint64(46), return_index=True)
                if best is None or len(first) > len(best[1]):
                    best = (k, first)
            k, first = best
            took = rest[first]
            slot_key, slot_id = np.zeros(1 << 18, np.uint64), np.full(1 << 18, self.n, np.int32)
            with np.errstate(over="ignore"):
                at = (keys[took] * k) >> np.uint64(46)
            slot_key[at], slot_id[at] = keys[took], took
            self.tables.append((k, slot_key, slot_id))
            rest = np.delete(rest, first)

    def pieces(self, buf: np.ndarray, left: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that begins at each place of a buffer; ``left`` has the bytes up to the word's end. Lengths without a piece are left out."""
        out, key = {}, np.zeros(len(buf), np.uint64)
        at = np.arange(len(buf))
        for m in range(1, self.sizes[-1] + 1):
            ok = left[at] >= m
            at, key = at[ok], key[ok]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                key = key * BASE + buf[at + m - 1].astype(np.uint64) + np.uint64(1)
            if m in self.sizes:
                ids = self(key)
                if (ids < self.n).any():
                    out[m] = np.full(len(buf), self.n, np.int32)
                    out[m][at] = ids
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The piece of each key; n where there is none."""
        out = np.full(len(x), self.n, np.int32)
        with np.errstate(over="ignore"):
            for k, slot_key, slot_id in self.tables:
                at = ((x * k) >> np.uint64(46)).astype(np.int64)
                hit = slot_key[at] == x
                out[hit] = slot_id[at[hit]]
        return out


class Lattice:
    """All segmentations of distinct words: piece numbers by position and length. Words are sorted by falling length."""

    def __init__(self, words: list[bytes] | tuple[np.ndarray, np.ndarray], lookup: Lookup):
        buf, size = words if isinstance(words, tuple) else (np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.at = (np.cumsum(size) - size)[self.order]  # where each word begins
        self.long = int(np.searchsorted(-self.size, -MATRIX, side="left"))  # words for transfer matrices
        self.top = int(self.size[self.long]) if len(size) > self.long else 0
        #: How many words have over j bytes.
        self.active = np.searchsorted(-self.size, -np.arange(self.top + 1), side="left")
        left = np.repeat(np.cumsum(size), size) - np.arange(len(buf))  # bytes up to the word's end
        self.ids = lookup.pieces(buf, left)
        # Slots: a word of n bytes has n + 1 of them; the words before it in the buffer come first.
        self.slot = self.at + self.order  # buffer offset plus the number of words before

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots by language: the sum over segmentations of a word's first bytes; and by word and language the logarithm of what they were scaled down by."""
        a, scale = np.zeros((int(self.size.sum()) + len(self.size), p.shape[1])), np.zeros((len(self.size), p.shape[1]))
        a[self.slot] = 1
        for j in range(1, self.top + 1):
            k = self.active[j - 1]  # words of at least j bytes
            s, b = self.slot[self.long : k], self.at[self.long : k]
            acc = np.zeros((len(s), p.shape[1]))
            for m, ids in self.ids.items():
                if m > j:
                    break
                acc += a[s + (j - m)] * p[ids[b + (j - m)]]
            a[s + j] = acc
            if j % 4 == 0:
                w, lang = np.nonzero((acc < TINY) & (acc > 0))
                if len(w):
                    for t in range(min(j, max(self.ids)) + 1):
                        a[s[w] + j - t, lang] *= HUGE
                    scale[self.long + w, lang] += np.log(HUGE)
        return a, scale

    def backward(self, p: np.ndarray) -> np.ndarray:
        z = np.zeros((int(self.size.sum()) + len(self.size), p.shape[1]))
        z[self.slot + self.size] = 1
        for j in range(self.top - 1, -1, -1):
            k = self.active[j]
            s, b = self.slot[:k], self.at[:k]
            acc = np.zeros((k, p.shape[1]))
            for m, ids in self.ids.items():
                r = np.searchsorted(-self.size[:k], -(j + m), side="right")
                acc[:r] += p[ids[b[:r] + j]] * z[s[:r] + j + m]
            z[s + j] = acc
        return z

    def matrix(self, which: int, p: np.ndarray) -> np.ndarray:
        """The log-probability of one long word, by language. The last ``reach`` sums are a state; a segment of the word is a matrix that takes one state to a later one."""
        n, begin, langs = int(self.size[which]), int(self.at[which]), p.shape[1]
        mine = {m: ids[begin : begin + n] for m, ids in self.ids.items() if (ids[begin : begin + n] < len(p) - 1).any()}
        reach = max(mine, default=1)
        state, log = np.zeros((reach, langs)), np.zeros(langs)
        state[-1] = 1  # the empty prefix; states end with the latest sum
        step = max(1, (1 << 21) // (reach * (reach + SEGMENT) * langs))
        for lo in range(0, n, SEGMENT * step):
            starts = np.arange(lo, min(n, lo + SEGMENT * step), SEGMENT)
            a = np.zeros((len(starts), reach, reach + SEGMENT, langs))
            a[:, np.arange(reach), np.arange(reach)] = 1
            for t in range(SEGMENT):
                for m, ids in mine.items():
                    if m > reach + t:
                        break
                    # Beyond the word's end nothing is added; before its start the state has zeros.
                    at = starts + t + 1 - m
                    ok = (at >= 0) & (starts + t < n)
                    a[ok, :, reach + t] += a[ok, :, reach + t - m] * p[ids[at[ok]]][:, None, :]
            for g, at in enumerate(starts):
                done = min(SEGMENT, n - at)
                state = np.einsum("il,ikl->kl", state, a[g, :, done : done + reach])
                top = np.maximum(state.max(0), 1e-300)
                state, log = state / top, log + np.log(top)
        return log + np.log(np.maximum(state[-1], 1e-300))

    def log_prob(self, p: np.ndarray) -> np.ndarray:
        """Of each word, in the order given, by language."""
        out = np.empty((len(self.size), p.shape[1]))
        a, scale = self.forward(p)
        out[self.order] = np.log(np.maximum(a[self.slot + self.size], 1e-300)) - scale
        for w in range(self.long):
            out[self.order[w]] = self.matrix(w, p)
        return out


def letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word: U+0080-U+00BF, U+2000-U+206F and U+3000-U+303F are punctuation, as are U+FF01-U+FF0F."""
    word = LETTER[data]
    if not (data >= 128).any():
        return word
    b = np.concatenate((data, np.zeros(2, np.uint8)))
    one = np.flatnonzero(data == 0xC2)
    three = np.flatnonzero(((data == 0xE2) & ((b[1:-1] == 0x80) | (b[1:-1] == 0x81))) | ((data == 0xE3) & (b[1:-1] == 0x80)) | ((data == 0xEF) & (b[1:-1] == 0xBC) & (b[2:] < 0x90)))
    off = np.concatenate((one, one + 1, three, three + 1, three + 2))
    word[off[off < len(data)]] = False
    return word


def cut_words(data: np.ndarray, bounds: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, text number) of the words of lower-cased texts that lie one after another; bounds has each text's end. Words of over ``most`` bytes are cut between characters."""
    word = letters(data)
    if most:
        head = (data & 0xC0) != 0x80  # where a character begins
        run = np.arange(len(data)) - np.maximum.accumulate(np.where(word & np.concatenate(([True], ~word[:-1])), np.arange(len(data)), 0))
        block = run // most
        new = word & np.concatenate(([False], (block[1:] != block[:-1]) & word[:-1]))
        # A cut within a character moves to the next one's beginning.
        heads = np.flatnonzero(head)
        cuts = np.flatnonzero(new)
        to = np.searchsorted(heads, cuts)
        cuts = heads[to[to < len(heads)]]
    run = np.concatenate(([False], word, [False]))
    starts = run[1:-1] & ~run[:-2]
    first = np.concatenate(([0], bounds[:-1]))
    first = first[first < len(data)]
    starts[first] = word[first]  # no word goes on into the next text
    ends = run[1:-1] & ~run[2:]
    last = bounds[(bounds > 0)] - 1
    ends[last] = word[last]
    if most and len(cuts):
        cuts = cuts[word[cuts] & word[cuts - 1]]
        starts[cuts] = ends[cuts - 1] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e - s, np.searchsorted(bounds, s, side="right")


def word_keys(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    first = np.cumsum(n) - n
    at = np.repeat(s - first, n) + np.arange(int(n.sum()))
    pos = np.arange(len(at)) - np.repeat(first, n)
    with np.errstate(over="ignore"):
        return C.mix(np.add.reduceat(C.BYTE[data[at]] * C.powers(int(n.max()))[pos], first) + n.astype(np.uint64) * C.K1)


def spaced(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, sizes) of words, each with a space before it."""
    size, first = n + 1, np.cumsum(n) - n
    buf = np.full(int(size.sum()), 32, np.uint8)
    within = np.arange(int(n.sum()))
    buf[np.repeat(np.cumsum(size) - n - first, n) + within] = data[np.repeat(s - first, n) + within]
    return buf, size


def distinct_words(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, sizes) of the distinct words, each with a space before it, and each word's number among them."""
    _, pick, which = np.unique(word_keys(data, s, n), return_index=True, return_inverse=True)
    return *spaced(data, s[pick], n[pick]), which


class Model:
    def __init__(self, langs: list[str], lookup: Lookup, p: np.ndarray, prior: np.ndarray):
        self.langs, self.lookup, self.p, self.prior = langs, lookup, p, prior


class Scorer:
    """A model with the scores of words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.empty(0, np.uint64), np.empty((0, len(model.langs)))

    def words(self, data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log-probabilities of words, by language."""
        keys, pick, which = np.unique(word_keys(data, s, n), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        had = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), len(self.model.langs)))
        out[had] = self.values[at[had]]
        new = np.flatnonzero(~had)
        if len(new):
            out[new] = Lattice(spaced(data, s[pick[new]], n[pick[new]]), self.model.lookup).log_prob(self.model.p)
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.values = self.keys[:0], self.values[:0]
            both = np.concatenate((self.keys, keys[new]))
            order = np.argsort(both, kind="stable")
            self.keys, self.values = both[order], np.concatenate((self.values, out[new]))[order]
        return out[which]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log posterior up to a constant, text by language, and each text's bytes in words; the texts are lower-cased."""
        out, size = np.tile(self.model.prior, (len(texts), 1)), np.zeros(len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return out, size
        s, n, doc = cut_words(data, np.cumsum([len(t) for t in texts]))
        if len(s):
            lp = self.words(data, s, n)
            for k in range(len(self.model.langs)):
                out[:, k] += np.bincount(doc, weights=lp[:, k], minlength=len(texts))
            size = np.bincount(doc, weights=n + 1, minlength=len(texts))
        return out, size


def learn(texts: list[tuple[str, str]], pieces: list[bytes], rounds: int = 3, alpha: float = 0.1) -> Model:
    """Expectation-maximisation over (text, lang); alpha is added to every piece's expected count."""
    langs = sorted({lang for _, lang in texts})
    lookup = Lookup(pieces)
    raw = [t.lower().encode("utf-8", "replace") for t, _ in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    s, n, doc = cut_words(data, np.cumsum([len(t) for t in raw]), LEARN)
    p = np.full((len(pieces) + 1, len(langs)), 1 / max(1, len(pieces)))
    share = np.array([sum(x == lang for _, x in texts) for lang in langs], float)
    if len(s):
        buf, size, which = distinct_words(data, s, n)
        lang_no = np.array([langs.index(x) for _, x in texts])[doc]
        count = np.zeros((len(size), len(langs)))
        np.add.at(count, (which, lang_no), 1)
        lat = Lattice((buf, size), lookup)
        owner = np.repeat(np.arange(len(size)), size)
        for r in range(rounds):
            p[-1] = 0
            if r:
                a, z = lat.forward(p)[0], lat.backward(p)  # words are short enough to need no scale
                total = a[lat.slot + lat.size]
                weight = np.empty_like(count)
                weight[lat.order] = count[lat.order] / np.maximum(total, 1e-300)
            expect = np.zeros_like(p)
            for m, ids in lat.ids.items():
                i = np.flatnonzero(ids < len(pieces))
                slot = i + owner[i]
                for k in range(len(langs)):
                    w = count[owner[i], k] if not r else a[slot, k] * p[ids[i], k] * z[slot + m, k] * weight[owner[i], k]
                    expect[:, k] += np.bincount(ids[i], weights=w, minlength=len(p))
            p = (expect + alpha) / (expect[:-1].sum(0) + alpha * len(pieces))
    p[-1] = 0
    return Model(langs, lookup, p, np.log(share / share.sum()))


def sample(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled training rows of each language, those with the smallest hashes; of each the first ``chars`` characters, so that bytes have a bound as well.

    Rows are counted by language first, so that only hashes below a cut that lets about twice as many rows through are
    sorted, however many partitions there are. A language that comes out short all the same (as one whose rows all have
    one hash may) is sorted without a cut: the sample is that of the definition in any case.
    """
    keep = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    keep = keep.select(F.left("text", F.lit(chars)).alias("text"), "lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    counts = {r["lang"]: r["count"] for r in keep.groupBy("lang").count().collect()}
    if not counts:
        return []

    def first(df: DataFrame) -> list[tuple[str, str]]:
        ranked = df.select("text", "lang", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")).alias("n"))
        return [(r["text"], r["lang"]) for r in ranked.where(F.col("n") <= rows).collect()]

    cut = lambda n: min((1 << 63) - 1, int(min(1.0, (2 * rows + 40) / n) * 2.0**64) - (1 << 63))
    cuts = docs.sparkSession.createDataFrame([(lang, cut(n)) for lang, n in counts.items()], "lang string, cut long")
    found = first(keep.join(F.broadcast(cuts), "lang").where("h <= cut"))
    got = Counter(lang for _, lang in found)
    short = [lang for lang, n in counts.items() if got[lang] < min(rows, n)]
    if short:
        found = [x for x in found if x[1] not in short] + first(keep.where(F.col("lang").isin(short)))
    return found


def identify(docs: DataFrame, model: Model | None, fit: str | None = None, pred: str = "lang_pred", mark: str = "score") -> DataFrame:
    """The rows of docs with the columns ``pred`` and ``mark`` beside their own; ``fit`` names a column for the mean log-probability of a byte under the predicted language (null for ``und``)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [c for c in docs.columns if c not in (pred, mark, fit)]
    if model is None:
        return docs.select(*names, F.lit("und").alias(pred), F.lit(0.0).alias(mark), *([F.lit(None).cast("double").alias(fit)] if fit else []))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        model = shipped.value
        scorer = Scorer(model)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            has = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            low = pc.fill_null(pc.utf8_lower(text), "")
            size = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
            best, score, mean, lo = np.zeros(len(has), np.int64), np.zeros(len(has)), np.zeros(len(has)), 0
            while lo < len(has):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, side="right")))
                x, n = scorer([v.as_buffer().to_pybytes() for v in low[lo:hi]])
                best[lo:hi] = b = x.argmax(1)
                score[lo:hi] = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
                mean[lo:hi] = (x.max(1) - model.prior[b]) / np.maximum(n, 1)
                lo = hi
            lang = [model.langs[b] if h else "und" for b, h in zip(best, has)]
            more = [pa.array(mean, mask=~has)] if fit else []
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, c in enumerate(batch.schema.names) if c in names], pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0)), *more], [*[c for c in batch.schema.names if c in names], pred, mark, *([fit] if fit else [])])

    schema = docs.select(*names).schema.add(pred, "string").add(mark, "double")
    return docs.select(*names).mapInArrow(run, schema.add(fit, "double") if fit else schema)


def language_id(docs: DataFrame, train: DataFrame | None = None, rows: int = ROWS, vocabulary_path: str | None = None, **names: str) -> DataFrame:
    """Learns from the labelled training rows of ``train`` (docs by default) and adds identify()'s columns to docs', under other names if given."""
    texts = sample(docs if train is None else train, rows)
    return identify(docs, learn(texts, vocabulary(vocabulary_path)) if texts else None, **names)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
