"""The manifest, packed ids and the prefix trie against plain Python, and on odd tables."""

import hashlib
import math
import mmap
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.llm import common, merkle, prefixtrie, tokenbin

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
BPE = public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    """Nulls, blanks, repeats, ties, a long text."""
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "", "a", 3), (None, "some words", "en", "b", 5), (14, "same text", "en", "b", 5), (14, "same text", "en", "b", 5), (14, "other", "en", "b", 5), (6, "ünï 日本", "fr", None, 5), (7, long, "en", "-", 9), (-7, "x", "é", "a", None)]


def odd_table(spark, rows, schema, *clash):
    """The rows with columns named like the operators' own."""
    return spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], ", ".join([schema, *(f"{c} string" for c in clash)]))


# --- 11 ------------------------------------------------------------------------------------------------------


def plain_levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([H(*now[i : i + arity]) for i in range(0, len(now), arity)])
    return out


def plain_proof(levels, pos, arity):
    """(left, right) by level."""
    out = []
    for now in levels[:-1]:
        lo = pos // arity * arity
        out.append(("".join(now[lo:pos]), "".join(now[pos + 1 : lo + arity])))
        pos //= arity
    return out


def plain_manifest(rows, arity=2):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(f(r[0]), f(r[3]), f(r[2]), f(None if r[4] is None else r[4] + more), f(r[1]))
    groups = {}
    for r in rows:
        groups.setdefault(b"0" if r[2] is None else b"1" + r[2].encode(), []).append(r)
    trees, order = {}, sorted(groups)
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_levels([leaf(r) for r in groups[g]], arity)
    top = plain_levels([trees[g][-1][0] for g in order], arity)
    out = []
    for k, g in enumerate(order):
        for pos, r in enumerate(groups[g]):
            path = plain_proof(trees[g], pos, arity) + plain_proof(top, k, arity)
            now = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in path:
                now = H(a, now, b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*(x for p in path for x in p)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def proofs(docs, arity=2, step=merkle.STEP):
    from pyspark.sql import functions as F

    changed = F.concat(*(merkle.field(F.col(f) + 1 if f == "n_chars" else F.col(f)) for f in merkle.FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    found = merkle.verified(merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", tampered, arity, step))
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("siblings")), "folded_root", "verified").collect()), key=repr)


def test_manifest_odd(spark):
    rows = odd_rows()
    got = proofs(odd_table(spark, rows, DOCS, "g", "k", "h", "pos", "n", "row", "other", "path", "root"))
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("arity", "step"), [(2, 2), (3, 2), (4, 1)])
def test_manifest_levels(spark, arity, step):
    """Trees of several stations, groups of every size up to runs cut short at more than one level."""
    rows = [(i, f"t{i}", lang, "s", i) for lang, n in (("a", 1), ("b", 2), ("c", 9), ("d", 70), (None, 17)) for i in range(n)]
    assert proofs(spark.createDataFrame(rows, DOCS), arity, step) == plain_manifest(rows, arity)


def test_manifest_single_and_empty(spark):
    one = [(5, "x", "en", None, 1)]
    got = proofs(spark.createDataFrame(one, DOCS))
    assert got == plain_manifest(one) and got[0][4] == H() and got[0][1] == got[0][2] == got[0][3]
    assert proofs(spark.createDataFrame([], DOCS)) == []


def test_manifest_hot_group_spreads(spark):
    """Rows of one group and key are dealt over tasks, as they are sorted by more than those."""
    rows = spark.range(4000).selectExpr("'1en' AS g", "7L AS k", "sha2('x', 256) AS h", "CAST(NULL AS STRING) AS other")
    rows, _ = common.write_out(spark, rows.repartition(8))
    before = common.tables(spark)
    got = merkle.placed(spark, rows, ["k", "h"])
    (path,) = common.tables(spark) - before
    assert spark.read.parquet(path).select("part").distinct().count() > 4
    assert sorted(r.pos for r in got.select("pos").collect()) == list(range(4000))


# --- 12 ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=200)), "<u4")
    raw = tokenbin.pack_bits(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    assert (tokenbin.unpack_bits(raw, len(ids), width) == ids).all()
    lo = data.draw(st.integers(0, len(ids)))
    assert (tokenbin.unpack_bits(raw, len(ids) - lo, width, lo) == ids[lo:]).all()


def test_width():
    assert [tokenbin.width_of(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    sizes = [1, 0, 700, 3, 64, 64, 1, 999]
    ids = rng.integers(0, 1 << 11, sum(sizes)).astype("<u4")
    raw = tokenbin.pack_file([5, None, -3, 4, 5, 5, 6, 1 << 40], sizes, ids, 11, 9, block=64) + b"\n"
    path = tmp_path / "x.bits"
    path.write_bytes(raw)
    with open(path, "rb") as f:
        file = tokenbin.BitFile(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        ends = np.cumsum([0, *sizes])
        assert len(file) == 8 and file.place == 9 and file.n_ids == len(ids) and list(np.flatnonzero(file.none)) == [1]
        assert all((file.doc(k) == ids[ends[k] : ends[k + 1]]).all() for k in (7, 0, 2, 5, 1))
        assert all((a == ids[x:y]).all() for a, x, y in zip(file.docs(), ends, ends[1:]))
        assert (file.ids(60, 70) == ids[60:70]).all()
        del file
    with pytest.raises(ValueError):
        tokenbin.BitFile(raw[:-1] + b"x")


ODD_TEXTS = ["á b", "́x   y\x1cz\x0b q", "İstanbul ΣΑΣ ς", "<|endoftext|> hi<|startoftext|>x", "it's we'll", "日本語 テキスト", "각 ̈́", "a\xa0b　c", "", "  ", "x" * 2000 + " y", "ﬁ ﷺ 🎉🏽\r\n\ta"]


def test_words_by_themselves(spark, monkeypatch):
    """Encoding words gives the ids of whole texts, with words kept and without; other tokenizers take whole texts."""
    import pyarrow as pa

    encode = tokenbin.Encoder(BPE)
    assert encode.words is not None
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").collect()]

    def ids(e, texts):
        flat, n = e(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]

    want = [e.ids for e in encode.tok.encode_batch(texts, add_special_tokens=False)]
    assert ids(encode, texts) == ids(encode, texts) == want
    assert max(map(len, encode.words)) <= tokenbin.LONG
    monkeypatch.setattr(tokenbin, "WORDS", 10)
    small = tokenbin.Encoder(BPE)
    assert [ids(small, [t])[0] for t in texts] == want and len(small.words) < 1000
    assert len(encode(pa.array([], pa.string()))[0]) == 0
    whole = tokenbin.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert whole.words is None and ids(whole, texts) == [e.ids for e in whole.tok.encode_batch(texts, add_special_tokens=False)]


SIGNS = [*"aAbB'sstTréÉßİΣςǅ.,;:!?%$_-<|>()[]{}\"`~0129 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2028\u0301\u0327…—日が🎉ﬁ", "<|endoftext|>", "<|STARTOFTEXT|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SIGNS), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_any_text_by_words(text):
    import pyarrow as pa

    encode = tokenbin.encoder(BPE)
    assert encode(pa.array([text], pa.string()))[0].tolist() == encode.tok.encode(text, add_special_tokens=False).ids


def plain_ids(text, tok):
    return [*tok.encode(text or "", add_special_tokens=False).ids, tokenbin.END]


@pytest.mark.parametrize("file_ids", [tokenbin.FILE, 20])
def test_files_round_trip(spark, tmp_path, file_ids):
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(BPE), odd_rows() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(ODD_TEXTS)]
    path = str(tmp_path / "bits")
    tokenbin.token_files(odd_table(spark, rows, DOCS, "n_tokens", "ids", "mark", "row", "place", "start"), BPE, path, file_ids=file_ids)
    got = tokenbin.read_files(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((r[0] or 0, plain_ids(r[1], tok)) for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    if file_ids == 20:
        files = [p for p in (tmp_path / "bits").iterdir() if p.name.startswith("part-") and p.stat().st_size]
        heads = [tokenbin.BitFile(p.read_bytes()) for p in files]
        assert len(files) > 7 and all(f.n_ids <= 20 or len(f) == 1 for f in heads) and {f.width for f in heads} == {16}


def test_hot_doc_id_spreads(spark, tmp_path):
    """A doc_id of most rows takes several ranges, and its documents still lie next to each other."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN id WHEN id % 10 = 1 THEN NULL ELSE 777 END AS doc_id", "concat('text ', id) AS text").repartition(4)
    bounds = tokenbin.bounds_of(rows)
    assert len(set(bounds)) < len(bounds)
    buckets = {r.bucket: r["count"] for r in tokenbin.encoded(rows, BPE, bounds).where("doc_id = 777").groupBy("bucket").count().collect()}
    assert len(buckets) >= 4 and max(buckets.values()) < 1000
    path = str(tmp_path / "bits")
    tokenbin.token_files(rows, BPE, path, file_ids=500)
    got = tokenbin.read_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + sorted([i for i in range(0, 3000, 10)] + [777] * 2400)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_files_empty(spark, tmp_path):
    path = str(tmp_path / "bits")
    tokenbin.token_files(spark.createDataFrame([], DOCS), BPE, path)
    assert tokenbin.read_files(spark, path).collect() == []


# --- 13 ------------------------------------------------------------------------------------------------------


def plain_trie(rows, base=100, heads=6):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            h = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            turns.setdefault(c, []).append(((t is not None, t or 0), h, (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(turns.get(c - int(math.fmod(c, base)), [])[:h] + turns[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        parts = [below(k) for k in kids.get(p, [])]
        return sum(x for x, _ in parts) or 1, own + sum(y for _, y in parts)

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below(p), H(ends)))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def nodes_of(df):
    return sorted(map(tuple, prefixtrie.trie(df).drop("digest").collect()), key=repr)


def test_trie_odd(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "b"), (0, 2, "assistant", "é日"), (0, 2, "assistant", "é日"), (7, 0, "user", "x" * 50_000)]
    rows += [(c, t, "user", f"q{t}") for c in (3, 4, 5, 99) for t in range(8)]
    rows += [(301, 0, "user", "no head"), (302, 0, "user", "no head either"), (-5, 0, "r", "negative"), (-5, 1, "r", "y")]
    assert nodes_of(odd_table(spark, rows, TURNS, "h", "n", "no", "depth", "digest", "part", "of", "last")) == plain_trie(rows)


def test_trie_copies_and_turnless(spark, monkeypatch):
    """A hot group of copies, whose ids are hashed in several strings; conversations that lose all their turns; one of many turns."""
    monkeypatch.setattr(prefixtrie, "CHUNK", 16)
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1300) for t in range(3)] + [(c, 0, "u", "single") for c in range(2001, 2040)]
    rows += [(2500, t, "u", f"long {t % 7}") for t in range(600)]
    got = nodes_of(spark.createDataFrame(rows, TURNS))
    assert got == plain_trie(rows) and any(r[1] == 0 and r[7] != H() for r in got)


def test_trie_role_and_text_apart(spark):
    """A turn's role and text are told apart wherever the border lies."""
    rows = [(100, 0, "ab", "c"), (100, 1, "x", ""), (200, 0, "a", "bc"), (200, 1, "x", "")]
    assert nodes_of(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_trie_empty(spark):
    assert nodes_of(spark.createDataFrame([], TURNS)) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 250), st.integers(0, 2), st.sampled_from("ab"), st.sampled_from(["", "x", "yy"])), max_size=60))
def test_trie_random(spark, rows):
    assert nodes_of(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
