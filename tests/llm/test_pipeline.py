import collections
import itertools
import re

import pytest

from oracle import DATA
from test_ops import check_pieces, sets_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_near(docs):
    """The smallest doc_id of each group of similar texts. Only sets that share a shingle are compared: no others can be similar."""
    ids = sorted(docs)
    sets, by, up = dict(zip(ids, sets_of([docs[i] for i in ids], 5))), collections.defaultdict(list), {i: i for i in ids}
    for i in ids:
        for x in sets[i]:
            by[x].append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {pair for l in by.values() for pair in itertools.combinations(l, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i for i in ids if top(i) == i}


def plain_leaks(docs, items, n=5):
    """The documents of which half an item's tokens lie under greedy tiles."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs, out = collections.defaultdict(set), set()
    items = [w for t in items if (w := tokens(t))]
    assert min(map(len, items)) >= n
    for k, w in enumerate(items):
        for i in range(len(w) - n + 1):
            runs[tuple(w[i : i + n])].add(k)
    for doc, text in docs.items():
        d = tokens(text)
        at = collections.defaultdict(list)
        for j in range(len(d) - n + 1):
            if (g := tuple(d[j : j + n])) in runs:
                at[g].append(j)
        for k in set().union(*(runs[g] for g in at)) if at else ():
            w = items[k]
            free_w, free_d, tiled = [True] * len(w), [True] * len(d), 0
            while True:
                best = (n - 1, 0, 0)
                for i in range(len(w) - n + 1):
                    for j in at.get(tuple(w[i : i + n]), ()):
                        m = 0
                        while i + m < len(w) and j + m < len(d) and w[i + m] == d[j + m] and free_w[i + m] and free_d[j + m]:
                            m += 1
                        if m > best[0]:
                            best = (m, i, j)
                m, i, j = best
                if m < n:
                    break
                free_w[i : i + m] = free_d[j : j + m] = [False] * m
                tiled += m
            if 2 * tiled >= len(w):
                out.add(doc)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's rows against plain Python on what the stage before it left."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    personal = re.compile(r"[\w.]+@[\w.]+|(?<![\w.])\d+\.\d+\.\d+\.\d+|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        texts = {i: r.text for i, r in before.items()}
        if name == "packing":
            check_pieces(docs.collect(), texts)
            break
        assert docs.columns == columns, name
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "language_id":
            want = {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
        elif name == "ngram_jaccard":
            want = plain_near(texts)
        elif name == "decontamination":
            want = set(texts) - plain_leaks(texts, items)
        else:
            want = set(texts)
            for i, r in after.items():
                found = set(personal.findall(texts[i]))
                assert (not found and r.text == texts[i]) or (found and not any(f in r.text for f in found))
                assert r.n_chars == len(r.text)
        assert set(after) == want, name
        if name != "pii":
            assert all(after[i] == before[i] for i in after), name
            assert name == "language_id" or len(after) < len(before)
        before = after


def test_near_copies_leave_the_first(spark):
    text = " ".join(f"w{k}" for k in range(200))
    near = text.replace("w100 ", "x100 ")
    rows = [(3, text), (1, near), (2, "another text altogether, not like any other one"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, DATA)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, docs, to=len(corpus_pipeline.STAGES)):
    for _, stage in corpus_pipeline.STAGES[:to]:
        docs = stage(spark, docs, DATA)
    return docs


def test_language_rejects_what_no_language_explains(spark):
    train = [(k, f"the people of the land and the sea number {k}", "en", "s", 1) for k in range(40)]
    rows = [(100, "the sea and the people", None, "s", 1), (101, "xkq zzvw pqrj wvxz kkqj zxcv qqzx", None, "s", 1), (102, "我们今天去公园看花", None, "s", 1), (103, "12 34 !!", None, "s", 1), (104, None, "en", "s", 1), (105, "", "en", "s", 1)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(train + rows, SCHEMA), DATA).collect()}
    assert 100 in kept and set(range(40)) <= kept and not kept & {101, 102, 103, 104, 105}


def test_odd_tables(spark):
    """Nulls in every column, repeated rows, a long text, and columns named like the stages' own."""
    text = "the people of the land and the sea went on and on, as they say, number %s"
    rows = [(k, text % k, "en", "s", 1) for k in range(1, 30)] + [(None, "the other people of the hill, none of them known", None, None, None), (40, None, "en", None, 1), (41, "the same once and again, word for word, and no more", "en", "s", 1), (41, "the same once and again, word for word, and no more", "en", "s", 1), (42, " ".join(f"the sea{k * 7919 % 10007}" for k in range(30_000)), None, "s", 9)]
    extra = "lang_pred string, score string, fit string, hits string, sid long, queue string, map string, row long, parts string"
    docs = spark.createDataFrame([(*r, "p", "q", "f", "h", 1, "u", "m", 2, "t") for r in rows], f"{SCHEMA}, {extra}")
    got = through(spark, docs, 4)
    assert got.columns == docs.columns
    out = got.collect()
    assert {(r.lang_pred, r.score, r.fit, r.hits, r.sid, r.queue, r.map, r.row, r.parts) for r in out} == {("p", "q", "f", "h", 1, "u", "m", 2, "t")}
    ids = [r.doc_id for r in out]
    assert ids.count(None) == 1 and ids.count(41) == 1 and ids.count(42) == 1 and 40 not in ids
    assert through(spark, docs).where("start = 0").count() == len(out)
    assert through(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_run_leaves_no_tables_but_its_result(spark, tmp_path):
    from sluiceway.llm import common

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = common.tables(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = common.tables(spark) - before
    assert out.count() > 0 and len(left) == 1
